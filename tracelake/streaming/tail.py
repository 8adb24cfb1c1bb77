"""Log lines as a stream.

Logs are landed as chunk files by whatever ships them (every log shipper rotates): ``<file>.<epoch>.<offset>`` holds the
bytes of ``<file>`` from ``<offset>`` on, ends at a line end, and never changes.  The epoch goes up when a file was
truncated, so state kept by (file, epoch) starts over.  A chunk written by a job lies in folders instead:
``file=<file>/epoch=<epoch>/offset=<offset>/part``.  A file that is neither is its own first chunk.  Spark's file
source finds new chunks; executors read them, and nothing is read on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.sources.files import plain_path

_CHUNK = "^(.*)\\.(\\d+)\\.(\\d+)$"
_FOLDERS = "/file=([^/]+)/epoch=(\\d+)/offset=(\\d+)/[^/]+$"
LINES = "file string, epoch int, ord bigint, value string, mtime bigint"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = row["value"].encode("utf-8", "surrogatepass").split(b"\n")
            sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
            begin = row["ord"] + np.cumsum(sizes) - sizes
            if raw and not raw[-1]:
                raw, begin = raw[:-1], begin[:-1]  # what follows the last line end
            for at in range(0, len(raw), 10_000):
                part = [r.removesuffix(b"\r").decode("utf-8", "replace") for r in raw[at : at + 10_000]]
                n = len(part)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([row["file"]] * n, pa.string()), "epoch": pa.array([row["epoch"]] * n, pa.int32()), "ord": pa.array(begin[at : at + n], pa.int64()),
                        "value": pa.array(part, pa.string()), "mtime": pa.array([row["mtime"]] * n, pa.int64()),
                    }
                )


def read_chunks(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``file, epoch, ord, value, mtime`` of landed chunks as a stream; ``ord`` is the byte offset in ``file``."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    name = plain_path(F.col("_metadata.file_path"))
    chunk, folders = name.rlike(_CHUNK), name.rlike(_FOLDERS)
    part = lambda g: F.when(folders, F.regexp_extract(name, _FOLDERS, g)).when(chunk, F.regexp_extract(name, _CHUNK, g))
    number = lambda g: F.coalesce(part(g), F.lit("0"))
    rows = reader.text(path, wholetext=True).select(
        F.coalesce(part(1), name).alias("file"), number(2).cast("int").alias("epoch"), number(3).cast("bigint").alias("ord"),
        "value", F.unix_millis("_metadata.file_modification_time").alias("mtime"),
    )
    return rows.mapInArrow(_lines, LINES)
