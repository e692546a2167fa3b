"""Media columns: payloads kept as baseline JPEGs, read back through their DC-only luminance thumbnails, with dimensions and hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm import jpeg
from gridlogic.llm.common import ready, table

UNIT = jpeg.ROW
#: Bytes of payload that are coded together; a longer one comes alone.
BATCH = 2_000_000


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, payload): spaces up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT))


def _grouped(values: Iterator, size) -> Iterator[list]:
    group, total = [], 0
    for v in values:
        n = size(v)
        if group and total + n > BATCH:
            yield group
            group, total = [], 0
        group.append(v)
        total += n
    if group:
        yield group


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = ((i, *padded(x.as_py())) for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for group in _grouped(rows, lambda r: len(r[2])):
            media = jpeg.encode([r[2] for r in group])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in group], pa.int64()), pa.array([r[1] for r in group], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media: binary) for each row of docs: its text, padded with spaces, as a JPEG whose thumbnail's samples are the bytes.

    Null and empty texts are one unit of spaces; a text over the format's height becomes several JPEGs in one value; a null doc_id stays null; repeated rows
    each give their row; other columns are ignored. One pass without a shuffle.
    """
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_hash string"


def describe(media: list[bytes]) -> list[tuple]:
    out = []
    for data, found in zip(media, jpeg.thumbnails(media), strict=True):
        own = len(data), hashlib.sha256(data).hexdigest()
        if found is None:
            out.append((None, None, None, *own, None, None, None))
            continue
        image, thumbnail = found
        samples = np.ascontiguousarray(thumbnail).tobytes()
        out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), *own, image.width, 8 * thumbnail.shape[0] if thumbnail.shape[0] > -(-image.height // 8) else image.height, jpeg.average_hash(thumbnail)))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = [x.split(" ")[0] for x in FEATURES.split(", ")]
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (x.as_py() or b"" for x in batch.column(2)), strict=True)
        for group in _grouped(rows, lambda r: len(r[2])):
            found = describe([r[2] for r in group])
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in group], pa.int64()), pa.array([r[1] for r in group], pa.int64()), *columns], names=["doc_id", "n_bytes", *names])


def media_features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, FEATURES) of (doc_id, n_bytes, media): from the stored bytes alone. Media that is null or no baseline JPEG has null
    payload, dimensions and hash."""
    ready(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, f"doc_id long, n_bytes long, {FEATURES}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all of `documents`, stored and read back."""
    found = media_features(encode_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.concat("width", F.lit("x"), "height"), "thumbnail_hash")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
