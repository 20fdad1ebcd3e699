"""Removal of repeated word sequences, by super-k-mers.

A window is `window` consecutive words. Of the word groups (`minimiser` words) in it, the one with the least hash is its
minimiser; consecutive windows that share one form a super-k-mer. Equal windows have equal minimisers, so
1. minimisers are counted, and only super-k-mers whose minimiser occurs more than once go on;
2. each of these travels as one packed string to the bucket of its minimiser, where sorting counts its windows exactly;
3. a minimiser with over `hot` occurrences would fill one bucket: its equal strings are put together before the shuffle,
   and the windows of the different ones go to buckets of their own content;
4. the word ranges of repeated windows return to their documents.

Minimisers are compared by 64-bit hashes, which can only add candidates; windows by their words.

Defined results: null and empty texts have no words; texts of fewer words than a window lose none; repeated rows are
occurrences of their own, so all of them lose the words they share; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, docs_view, runs, sliced, utf8
from loomgraph.llm._words import ngram_hashes, spans, window_hashes

WINDOW, MINIMISER, HOT = 35, 5, 10_000
#: Hot minimisers that are broadcast at most.
MOST_HOT = 1_000_000
#: Occurrences of a hot string that travel in one row.
SPREAD = 16


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the (first) least of each `width` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(values)), 1
    while size * 2 <= width:
        a, b = at[:-size], at[size:]
        at = np.where(values[b] < values[a], b, a)
        size *= 2
    a, b = at[:n], at[width - size :][:n]
    return np.where(values[b] < values[a], b, a)


def super_kmers(text: pa.Array, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, number of windows and minimiser hash of each super-k-mer of a column without nulls."""
    raw, offsets = utf8(text)
    starts, ends, first = spans(raw, offsets)
    n = len(starts) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    groups = ngram_hashes(window_hashes(raw, starts, ends), minimiser)
    least = sliding_argmin(groups, window - minimiser + 1)
    doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    valid = doc[:n] == doc[window - 1 :]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    begin = np.flatnonzero(fresh)
    left = np.flatnonzero(valid & np.append(~valid[1:] | (least[1:] != least[:-1]), True))
    return doc[begin], begin - first[doc[begin]], left - begin + 1, groups[least[begin]].view(np.int64)


def _minimisers(docs: DataFrame, window: int, minimiser: int, with_place: bool) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            row, pos, n, mh = super_kmers(batch.column(1), window, minimiser)
            if with_place:
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mh)], names=["doc_id", "th", "pos", "n", "mh"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(mh)], names=["mh"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, th long, pos int, n int, mh long" if with_place else "mh long")


def _marked(places: DataFrame, counts: DataFrame) -> DataFrame:
    """The places whose minimiser is counted, with hot. Hot minimisers are few, so they are known before the shuffle, where their places
    go by a hash of their own; with more than MOST_HOT of them the join alone tells."""
    often = counts.where("hot").select(F.col("mh").alias("_often"))
    if often.count() > MOST_HOT:
        return places.join(counts, "mh")
    known = places.join(F.broadcast(often), F.col("mh") == F.col("_often"), "left").withColumn("_by", F.when(F.col("_often").isNull(), F.col("mh")).otherwise(F.xxhash64("doc_id", "th", "pos")))
    cold = counts.where("not hot").select(F.col("mh").alias("_cold"))
    met = known.join(cold, F.col("_by") == F.col("_cold"), "left").where("_often is not null or _cold is not null")
    return met.select(*places.columns, F.col("_often").isNotNull().alias("hot"))


def _packed(joined: DataFrame, window: int) -> DataFrame:
    """bucket, hot, packed (words parted by single spaces) and occ (array of doc_id, th, pos) from rows with text and their
    super-k-mers. A chunk's equal strings are one row, so a string that very many documents share is a row per chunk."""
    def run(batches):
        for batch in batches:
            for part in sliced([batch]):
                held: dict[tuple[int, bool, bytes], tuple[list[int], list[int]]] = {}
                for k, (text, marks) in enumerate(zip(part.column(1).to_pylist(), part.column(3).to_pylist())):
                    words = text.encode("utf-8", "surrogatepass").split()
                    for m in marks:
                        rows, at = held.setdefault((m["mh"], m["hot"], b" ".join(words[m["pos"] : m["pos"] + m["n"] + window - 1])), ([], []))
                        rows.append(k)
                        at.append(m["pos"])
                row = pa.array([k for rows, _ in held.values() for k in rows], pa.int32())
                each = pa.StructArray.from_arrays([part.column(0).take(row), part.column(2).take(row), pa.array([p for _, at in held.values() for p in at], pa.int32())], ["doc_id", "th", "pos"])
                occ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(rows) for rows, _ in held.values()])), pa.int32()), each)
                out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.bool_()), pa.array([x[2] for x in held], pa.binary()), occ], names=["bucket", "hot", "packed", "occ"])
                for k in range(0, out.num_rows, 10_000):
                    yield out.slice(k, 10_000)

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"bucket long, hot boolean, packed binary, occ array<struct<doc_id: {kind}, th: long, pos: int>>")


def cuts_of(packed: bytes) -> list[int]:
    """Where each word of a packed string begins, and where one more would."""
    cuts = [0]
    while (at := packed.find(b" ", cuts[-1])) >= 0:
        cuts.append(at + 1)
    cuts.append(len(packed) + 1)
    return cuts


def _hot(packed: DataFrame, window: int) -> DataFrame:
    """Ranges for super-k-mers of minimisers that occur too often for one bucket. Equal strings are put together before the
    shuffle; a string that comes twice repeats as a whole. The windows of the different strings go to buckets of their own
    content, where their counts are summed, and only those in strings that come once return to them."""
    single = packed.where("hot")
    strings = single.groupBy("packed").agg(F.sum(F.size("occ")).alias("c"))

    def run(batches):
        for batch in batches:
            for part in sliced([batch], "packed"):
                one, row, at = [], [], []
                for k, p in enumerate(part.column(0).to_pylist()):
                    cuts = cuts_of(p)
                    for i in range(len(cuts) - window):
                        one.append(p[cuts[i] : cuts[i + window] - 1])
                        row.append(k)
                        at.append(i)
                row = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), part.column(1).take(row), part.column(2).take(row), pa.array(at, pa.int32())], names=["one", "c", "sid", "i"])

    windows = strings.select("packed", "c", F.md5("packed").alias("sid")).mapInArrow(run, "one binary, c long, sid string, i int")
    again = windows.groupBy("one").agg(F.sum("c").alias("n"), F.min("c").alias("least")).where("n > 1 and least = 1").select(F.col("one").alias("_one"))
    parts = windows.where("c = 1").join(again, F.col("one") == F.col("_one")).groupBy("sid").agg(F.collect_list(F.struct(F.col("i").alias("s"), (F.col("i") + window).alias("e"))).alias("ranges"))
    words = F.size(F.split(F.col("packed").cast("string"), " "))
    whole = strings.where("c > 1").select(F.md5("packed").alias("sid"), F.array(F.struct(F.lit(0).alias("s"), words.alias("e"))).alias("ranges"))
    found = whole.unionByName(parts).withColumnRenamed("sid", "_sid")
    # rows of a chunk's equal strings meet their ranges; cut into short lists and dealt out evenly, they become a row per document
    lists = F.explode(F.transform(F.sequence(F.lit(0), F.size("occ") - 1, F.lit(SPREAD)), lambda k: F.slice("occ", k + 1, F.lit(SPREAD)))).alias("occ")
    met = single.select(F.md5("packed").alias("sid"), "occ").join(found, F.col("sid") == F.col("_sid")).select("ranges", lists)
    spread = met.repartition(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("ranges", F.inline("occ")).select("doc_id", "th", "pos", F.inline("ranges"))
    return spread.select("doc_id", "th", (F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e")).alias("e"))


def repeated_in_bucket(packed: list[bytes], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each string of a bucket, the word ranges [start, end) of those of its windows that the bucket holds more than once."""
    copies: dict[bytes, int] = {}
    for p in packed:
        copies[p] = copies.get(p, 0) + 1
    whole: dict[bytes, list[tuple[int, int]]] = {p: [(0, p.count(b" ") + 1)] for p, c in copies.items() if c > 1}
    if len(copies) > 1:
        every = []
        for p in copies:
            cuts = cuts_of(p)
            every += [(p[cuts[i] : cuts[i + window] - 1], p, i) for i in range(len(cuts) - window)]
        every.sort()
        found: dict[bytes, list[int]] = {}
        for k, (w, p, i) in enumerate(every):
            if p not in whole and (k and every[k - 1][0] == w or k + 1 < len(every) and every[k + 1][0] == w):
                found.setdefault(p, []).append(i)
        for p, at in found.items():
            ranges: list[tuple[int, int]] = []
            for i in sorted(at):
                if ranges and i <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], i + window)
                else:
                    ranges.append((i, i + window))
            whole[p] = ranges
    return [whole.get(p, []) for p in packed]


def _cold(packed: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for group in runs(batches, ["bucket"]):
            occ = group.column("occ").combine_chunks()
            times = np.diff(occ.offsets.to_numpy())
            if times.sum() < 2:
                continue
            each, row, a, b = occ.flatten(), [], [], []
            pos = each.field("pos").to_pylist()
            strings = [p for p, n in zip(group.column("packed").to_pylist(), times.tolist()) for _ in range(n)]
            for k, ranges in enumerate(repeated_in_bucket(strings, window)):
                for s, e in ranges:
                    row.append(k)
                    a.append(pos[k] + s)
                    b.append(pos[k] + e)
            if row:
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([each.field("doc_id").take(at), each.field("th").take(at), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "th", "s", "e"])

    kind = packed.schema["occ"].dataType.elementType["doc_id"].dataType.simpleString()
    return packed.where("not hot").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"doc_id {kind}, th long, s int, e int")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot: int = HOT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th and ranges (array of s, e; they may overlap) of documents that have words in repeated windows."""
    docs = docs_view(docs)
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    counts = _minimisers(docs, window, minimiser, False).groupBy("mh").agg(F.count("*").alias("c")).where("c > 1").select("mh", (F.col("c") > hot).alias("hot"))
    marks = _marked(_minimisers(docs, window, minimiser, True), scratch.keep(counts, "counts")).groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "n", "mh", "hot")).alias("marks")).withColumnRenamed("doc_id", "_doc").withColumnRenamed("th", "_th")
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_doc"]) & (docs["th"] == marks["_th"])).select("doc_id", "text", "th", "marks")
    packed = scratch.keep(_packed(joined, window), "packed")
    ranges = _cold(packed, window).unionByName(_hot(packed, window))
    return ranges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by single spaces) of each row."""
    view = docs_view(docs)
    found = repeated_ranges(docs, window, minimiser, hot).withColumnRenamed("doc_id", "_doc").withColumnRenamed("th", "_th")
    joined = view.join(found, view["doc_id"].eqNullSafe(found["_doc"]) & (view["th"] == found["_th"]), "left").select("doc_id", "text", "ranges")

    def run(batches):
        for batch in sliced(batches):
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                last, out = 0, []
                for r in sorted(ranges or (), key=lambda r: r["s"]):
                    out += words[last : max(r["s"], last)]
                    last = max(last, r["e"])
                out += words[last:]
                n_removed.append(len(words) - len(out))
                kept.append(b" ".join(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
