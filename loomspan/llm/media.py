"""Media columns: baseline JPEG in a binary column, its dimensions and thumbnail hashes.

`store_payload` turns texts into JPEGs that hold their bytes losslessly; `media_features` reads any baseline JPEG column:
width, height and hashes of the DC-only luminance thumbnail. Both are narrow: no shuffle, one pass, bounded batches.

Defined results: a null text is an empty one (a payload of 576 bytes 255); null or damaged images and other formats give
null features; equal rows give equal rows; an empty table gives none; columns beyond the named ones are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm import jpeg
from loomspan.llm._shared import small_batches, spread

#: Texts and images handled together in a worker.
BATCH_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch, values: list[bytes]) -> Iterator[tuple[int, int]]:
    at = total = 0
    for k, v in enumerate(values):
        total += len(v)
        if total >= BATCH_BYTES:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(values):
        yield at, len(values)


def store_payload(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the text's UTF-8 bytes, filled up with bytes 255, as a JPEG."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for a, b in _slices(batch, texts):
                media = [jpeg.store(t + b"\xff" * (jpeg.UNIT - len(t) % jpeg.UNIT if len(t) % jpeg.UNIT or not t else 0)) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(map(len, texts[a:b])), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(store, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def media_features(images: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns `keep`, then what the stored bytes say: width, height, feature, media_bytes, media_sha256, and of a payload read back payload_bytes, payload_sha256, tail_crc32."""
    names = ["width", "height", "feature", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def row(raw: bytes | None, found: jpeg.Decoded | None) -> list:
        if raw is None:
            return [None] * 8
        stored = [len(raw), hashlib.sha256(raw).hexdigest()]
        if found is None:
            return [None, None, None, *stored, None, None, None]
        try:
            payload = jpeg.stored_payload(found)
            read = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])]
        except jpeg.BadImage:
            read = [None, None, None]
        return [found.image.width, found.image.height, jpeg.feature(found), *stored, *read]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(len(keep)).to_pylist()
            for a, b in _slices(batch, [m or b"" for m in media]):
                rows = [row(m, d) for m, d in zip(media[a:b], jpeg.decode([m or b"" for m in media[a:b]]), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *columns], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep) + ", width int, height int, feature string, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long"
    small_batches(images.sparkSession)
    return images.select(*keep, media_col).mapInArrow(read, schema)


def op1_media(spark, sf_dir: str) -> DataFrame:
    stored = store_payload(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return media_features(stored, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
