"""Where a model comes in: prompts in, prediction rows out, batch by batch. The model itself is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame

from loomspan.operators.labels import first_rows

PREDICTION = "task_id string, pred string, sample_latency double"


def generate(prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 16) -> DataFrame:
    """(task_id, pred, sample_latency) of prompts (task_id, prompt). `load` runs once per task and gives a function of a batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                began = time.time_ns()
                texts = model(part["prompt"].tolist())
                yield pd.DataFrame({"task_id": part["task_id"].to_numpy(), "pred": texts, "sample_latency": (time.time_ns() - began) / 1e9 / len(part)})

    return prompts.select("task_id", "prompt").mapInPandas(run, PREDICTION)


def encoded(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """(text, vector) of texts (text). `load` runs once per task and gives a function from a batch of texts to their vectors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame["text"].iloc[at : at + batch].tolist()
                yield pd.DataFrame({"text": part, "vector": [[float(x) for x in v] for v in model(part)]})

    return texts.select("text").mapInPandas(run, "text string, vector array<double>")


def one_per_task(predictions: DataFrame, order: list[Column]) -> DataFrame:
    """Predictions that came twice, as from padded last batches: the first by the order."""
    return first_rows(predictions, "task_id", order)


def warm_up(rows: DataFrame, n: int = 60) -> DataFrame:
    return rows.limit(n)
