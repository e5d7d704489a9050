"""loomspan: retrieval, training-data and evaluation operators over code and text, as PySpark DataFrame plans."""
