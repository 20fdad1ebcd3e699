"""What the operators share: the shared scratch folder, Arrow helpers and row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer single text is handled alone.
CHUNK_BYTES = 2 << 20
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset one of our own, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="loomgraph-"))
    return "file://" + _LOCAL[0].name


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomgraph/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read again; what was shuffled for it is deleted when it is written, not when the driver's garbage is collected."""
        was = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, was) if was else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Deletes one table, or everything."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; the folder belongs to its owner
            if name:
                raise


def text_key() -> Column:
    """Tells rows with equal doc_id and other texts apart; equal rows share all verdicts."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th")


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, th and _row, which holds all columns of docs, so that their names can't clash with an operator's own."""
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)))
    return docs.select("doc_id", "text", text_key(), row.alias("_row"))


def restored(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs out of carried() rows, with another text if given."""
    each = [text if text is not None and c == "text" else F.col("_row").getField(f"_{k}") for k, c in enumerate(docs.columns)]
    return rows.select(*(v.alias(c) for v, c in zip(each, docs.columns)))


def docs_view(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and th, whatever else the table has."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), text_key(), *more)


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column holds about `most` bytes in each."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        start, n = 0, batch.num_rows
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
            end = min(max(end, start + 1), n)
            yield batch.slice(start, end - start)
            start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and n + 1 offsets into them."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of neighbouring rows with equal integer keys, from batches sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
