"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from a bounded sample of its labelled documents. A text is
lower-cased and compressed with every dictionary, and the language of the smallest result wins; a narrow margin rejects
the text. The whole text is compressed, in blocks that each start from the dictionary alone: else a long text would find
itself in its own past and the dictionary would hardly matter.

Training sample (the documented bound): of every language the `SAMPLE_DOCS` documents with the smallest hash in as many
equal hash classes, and of these texts the first `DICT_BYTES` bytes together; with more than `ALL_DICT_BYTES` / `DICT_BYTES`
languages each has an equal part of `ALL_DICT_BYTES`, so that all dictionaries together stay below that. Prediction never
sees labels, ids or sources.

Defined results: null text or text without a letter is `und`, score 0, rejected; ties go to the code-point-least
language; null labels don't train; without labelled documents every text is `und`; repeated rows are predicted each by
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from loomspan.llm._shared import small_batches, spread

SAMPLE_DOCS = 96
DICT_BYTES = 112_640
ALL_DICT_BYTES = 48 << 20
#: zstandard's level and block: level 6 tells 99.0 % of held-out texts at sf0.1, levels 1 and 3 only 92.8 % and 95.2 %.
LEVEL = 6
BLOCK_BYTES = 1_024
#: A text is rejected if the second-best language needs less than this share more bytes than the best.
REJECT_MARGIN = 0.005
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id):
    """Documents whose crc32 of the id as text is a multiple of 5 never train."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content by language; `docs` holds training rows only. A pass over labels, one over ids, one over the sampled texts."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL AND t <> ''")
    langs = rows.select("l").distinct().count()
    dict_bytes = min(dict_bytes, max(1_024, ALL_DICT_BYTES // max(1, langs)))
    sample_docs = min(sample_docs, max(1, dict_bytes // 256))
    order = F.xxhash64("i")
    picked = rows.groupBy("l", F.pmod(order, F.lit(sample_docs)).alias("c")).agg(F.min(F.struct(order.alias("h"), F.col("i"))).alias("m")).select("l", F.col("m.i").alias("i"))
    # At most sample_docs ids for each language: a bound that the data's size doesn't move.
    sample = rows.join(F.broadcast(picked), ["i", "l"], "left_semi").groupBy("l", "i").agg(F.substring(F.min("t"), 1, dict_bytes).alias("t"))
    found: dict[str, list] = {}
    for row in sample.toLocalIterator():
        found.setdefault(row.l, []).append((row.i, row.t.lower().encode("utf-8", "replace")))
    share = max(1, dict_bytes // max(1, sample_docs))
    out = {}
    for lang in sorted(found):
        texts = [t for _, t in sorted(found[lang], key=lambda x: x[0])]
        short = b"\n".join(t[:share] for t in texts)
        out[lang] = (b"\n".join(t[share:] for t in texts)[: max(0, dict_bytes - len(short) - 1)] + b"\n" + short)[-dict_bytes:]
    return out


class Compressors:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        def of(content: bytes):
            data = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.langs = sorted(dictionaries)
        self.compress = [of(dictionaries[x]) for x in self.langs]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). margin: how many more bytes the second best needs, as a share; score: that against 10 %, at most 1."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(map(len, map(compress, blocks))) for compress in self.compress]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.langs[0], 1.0, 1.0
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[0]]
        return self.langs[order[0]], min(1.0, margin / 0.1), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", reject_margin: float = REJECT_MARGIN) -> DataFrame:
    """`docs` with lang_pred, score and rejected (no letter, or margin below `reject_margin`) in place of columns so named."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*kept)
    at = kept.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(dictionaries)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == "und" or x[2] < reject_margin for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, "lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return docs.mapInArrow(predict, schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionaries = train_dictionaries(docs.where(~held_out("doc_id")))
    return identify(spread(docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")
