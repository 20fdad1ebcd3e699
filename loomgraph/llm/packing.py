"""Packing into fixed-size sequences by minimum bin slack.

Pieces of equal length are alike, so bins are planned on the histogram of lengths, which has at most `size` rows
whatever the corpus. Each bin takes the longest piece left and, by a subset-sum dynamic programme over the lengths
left (a bitset of reachable fills), the combination that leaves the least slack; that combination is then removed, as
often as the counts allow. Pieces find their places by their rank among those of equal length; ranks are counted in
salted groups, so a length that very many pieces share is spread.

Defined results: a null or empty text is one piece that holds the end id alone; a text whose ids (with the end id)
exceed the size is cut into pieces of exactly that size, the last of which may be shorter; repeated rows are packed each;
an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, sliced
from loomgraph.llm._tokens import default_path, encode, forget

SIZE, END = 4096, 1
#: Pieces of one length that are ranked together.
RANK_GROUP = 20_000


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids (little-endian unsigned 32-bit) of each piece."""
    path = path or default_path()
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        for batch in sliced(batches):
            where, piece, start, ids = [], [], [], []
            for k, got in enumerate(encode(batch.column(1).to_pylist(), path)):
                got += last
                for n, a in enumerate(range(0, len(got), 4 * size)):
                    where.append(k)
                    piece.append(n)
                    start.append(a // 4)
                    ids.append(got[a : a + 4 * size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])
        forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths (descending, with repeats) of pieces left whose sum is the largest up to room. lengths: descending, all those left."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        copies, unit = min(counts[n], room // n), 1
        while copies:  # binary splitting: any number up to copies
            take = min(unit, copies)
            wider = (reach | reach << (n * take)) & mask
            if wider != reach:
                steps.append((n, take, reach))
                reach = wider
            copies -= take
            unit *= 2
        if reach >> room & 1:
            break
    fill, out = reach.bit_length() - 1, []
    for n, take, before in reversed(steps):
        if not before >> fill & 1:
            out += [n] * take
            fill -= n * take
    return sorted(out, reverse=True)


def plan(hist: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, per bin, first bin, offset in the bin) for each run of equal bins and length."""
    counts = {n: c for n, c in hist.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, bins = [], 0
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        chosen = [top, *fullest(counts, lengths, size - top)] if size > top else [top]
        counts[top] += 1
        need: dict[int, int] = {}
        for n in chosen:
            need[n] = need.get(n, 0) + 1
        times, offset = min(counts[n] // m for n, m in need.items()), 0
        for n, m in need.items():
            rows.append((n, used[n], times * m, m, bins, offset))
            used[n] += times * m
            counts[n] -= times * m
            offset += n * m
        bins += times
        lengths = [n for n in lengths if counts[n]]
    return rows


def pack(cut: DataFrame, size: int = SIZE, scratch: Scratch | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (and any other columns)."""
    spark = cut.sparkSession
    cut = (scratch or Scratch(spark, "packing")).keep(cut, "pieces")
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    rows = sorted(plan(hist, size))
    shared = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 6))
    salts = max(1, -(-sum(hist.values()) // RANK_GROUP))
    others = [c for c in cut.columns]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("long"))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = groups.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    order = [c for c in others if c not in ("length", "ids")]
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).select(*others, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches):
        table = shared.value
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            rank = batch.column(len(others)).to_numpy()
            length = batch.column(others.index("length")).to_numpy()
            at = table[np.searchsorted(key, length << 44 | rank, "right") - 1] if batch.num_rows else np.zeros((0, 6), np.int64)
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(at[:, 4] + k // np.maximum(at[:, 3], 1)), pa.array(at[:, 5] + k % np.maximum(at[:, 3], 1) * length)], names=[*others, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (of at most the bin's size) and doc_ids, for pieces that were packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; the ids stay behind."""
    return pack(pieces(docs, path, size, end).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), size)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
