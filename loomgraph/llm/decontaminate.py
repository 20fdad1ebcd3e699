"""Benchmark decontamination with a generalised suffix automaton over the words of all test items.

A document's words stream through the automaton, which keeps the longest match that ends at each word. A window of
`window` words of an item (or a whole item of fewer words) that ends there is an occurrence; its words are hit.

Items are cut into pieces that share all but one word of a window, and pieces are dealt to blocks of bounded size by a hash. Tasks build the blocks' automata and
write them to the shared folder; the driver hands them on one at a time, and a scanning task has one in memory at a time, whatever the benchmark's size.

Defined results: null or empty texts have no words and are clean; an item with a null or wordless text has no windows;
repeated documents are judged alike, row by row; repeated item ids count once; a null item id is no item; an empty
benchmark leaves all clean.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, runs, sliced, table

WINDOW = 13
#: Words of test items in one automaton, some 500 bytes a word in memory, about; more items take several automata. Words of a piece of an item.
MOST_WORDS, PIECE_WORDS = 200_000, 20_000
#: Bytes of texts that a task holds while it takes one automaton after the other.
SCAN_BYTES = 32 << 20
#: ASCII letters to lower case; all other ASCII but digits parts words. Bytes of other characters stay as they are.
_FOLD = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Of several word sequences. `ends[state]`: the items one of whose windows ends where the state is reached, by the
    window's length; `due[state]`: the shortest match length for which any window ends there (0: none)."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        windows: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            size = min(window, len(words))
            state, length = 0, 0
            for k, w in enumerate(words):
                state, length = self.next[state][w], length + 1
                if k + 1 < size:
                    continue
                while self.len[self.link[state]] >= size:
                    state = self.link[state]
                length = min(length, self.len[state])
                windows.setdefault(state, {}).setdefault(size, set()).add(item)
        self.ends: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.len)
        self.due = [0] * len(self.len)
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            own = tuple((n, frozenset(x)) for n, x in sorted(windows.get(state, {}).items()))
            self.ends[state] = self.ends[self.link[state]] + own
            self.due[state] = self.ends[state][0][0] if self.ends[state] else 0

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        twin = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def occurrences(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [start, end) inside occurrences, and the items they come from."""
        nxt, link, lens, due = self.next, self.link, self.len, self.due
        state = length = 0
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        at = nxt[0]
        for k, w in enumerate(words):
            to = at.get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    length, at = 0, nxt[0]
                    continue
                length = lens[state]
            state, length = to, length + 1
            at = nxt[to]
            if due[to] and length >= due[to]:
                longest = 0
                for size, names in self.ends[to]:
                    if size <= length:
                        longest = max(longest, size)
                        items |= names
                start = k + 1 - longest
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, k + 1))
        return found, items


    def packed(self) -> bytes:
        return zlib.compress(pickle.dumps((self.next, self.link, self.len, self.ends, self.due), pickle.HIGHEST_PROTOCOL), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> SuffixAutomaton:
        made = object.__new__(cls)
        made.next, made.link, made.len, made.ends, made.due = pickle.loads(zlib.decompress(data))
        return made


def pieces(benchmark: DataFrame, window: int, piece_words: int = PIECE_WORDS) -> DataFrame:
    """item, nth, n and words (parted by spaces) of pieces of the items: every window of an item stands in one of them."""
    def run(batches):
        for batch in sliced(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                step = max(piece_words, window)
                starts = range(0, max(len(words) - window + 1, 1), step) if words else []
                cut = [words[k : k + step + window - 1] for k in starts]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(range(len(cut)), pa.int32()), pa.array([len(w) for w in cut], pa.int64()), pa.array([b" ".join(w) for w in cut], pa.binary())], names=["item", "nth", "n", "words"])

    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    return known.mapInArrow(run, "item string, nth int, n long, words binary")


def automata(benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, most_words: int = MOST_WORDS) -> tuple[DataFrame, int]:
    """block and data (a packed automaton) of all blocks, built in tasks, and the number of blocks."""
    cut = scratch.keep(pieces(benchmark, window, min(PIECE_WORDS, most_words)), "pieces")
    blocks = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // most_words))

    def run(batches):
        for block in runs(batches, ["block"]):
            items = [(i, w.split(b" ")) for i, w in zip(block.column("item").to_pylist(), block.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([block.column("block").combine_chunks()[:1], pa.array([SuffixAutomaton(items, window).packed()], pa.binary())], names=["block", "data"])

    dealt = cut.select(F.pmod(F.xxhash64("item", "nth"), F.lit(blocks)).cast("int").alias("block"), "item", "words")
    return scratch.keep(dealt.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(run, "block int, data binary"), "automata"), blocks


def _taken(shared) -> bytes:
    """A broadcast's value, which the worker doesn't keep."""
    value = shared.value
    shared.__dict__.pop("_value", None)
    return value


_FOUND = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = MOST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs with n_words, spans (merged [start, end) word ranges that are hit) and items (sorted ids)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontamination")
    names = [c for c in docs.columns if c not in _FOUND.names]
    plain = docs.select(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields] + ["n_words long, spans array<array<long>>, items array<string>"])
    built, blocks = automata(benchmark, scratch, window, most_words)
    shared = []
    for k in range(blocks):  # a block at a time; one that no piece was dealt to has no row
        row = built.where(F.col("block") == k).select("data").first()
        if row is not None:
            shared.append(spark.sparkContext.broadcast(bytes(row["data"])))
        del row
    at = names.index("text")

    def scan(batches):
        known: list[SuffixAutomaton] = []  # if it is the only one

        def answer(held):
            texts = [words_of(t.as_py()) for batch in held for t in batch.column(at)]
            found: list[tuple[list, set]] = [([], set()) for _ in texts]
            for one in shared or [None]:
                automaton = known[0] if known else SuffixAutomaton.unpacked(_taken(one)) if one is not None else SuffixAutomaton([], window)
                if len(shared) < 2 and not known:
                    known.append(automaton)
                for k, words in enumerate(texts):
                    got, who = automaton.occurrences(words)
                    if got:
                        before, names_before = found[k]
                        found[k] = (merged([*before, *got]) if before else got, names_before | who)
                del automaton
            own = table(_FOUND, n_words=[len(w) for w in texts], spans=[[list(x) for x in got] for got, _ in found], items=[sorted(who, key=lambda s: s.encode()) for _, who in found])
            start = 0
            for batch in held:
                part = own.slice(start, batch.num_rows)
                start += batch.num_rows
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *part.columns], names=[*names, *_FOUND.names])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if len(shared) < 2 or size >= SCAN_BYTES:
                yield from answer(held)
                held, size = [], 0
        if held:
            yield from answer(held)

    return plain.mapInArrow(scan, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def verdicts(found: DataFrame, min_hits: int = 1, coverage: int = 20) -> DataFrame:
    """Adds n_hit, n_items and contaminated: at least min_hits words hit, and coverage * n_hit >= n_words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", (F.col("n_hit") >= min_hits) & (F.col("n_hit") * coverage >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20, cut_words: int | None = None) -> DataFrame:
    """docs without contaminated documents. Others stay as they are, or with cut_words lose hit spans of at least so
    many words (the text between the span's first and last word goes)."""
    others = {c: f"_{k}" for k, c in enumerate(docs.columns) if c != "text"}  # in a struct, as they may be named like our own columns
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(k) for c, k in others.items())).alias("_row"), "text")
    kept = verdicts(find_spans(rows, benchmark, window), coverage=coverage).where(~F.col("contaminated"))
    if cut_words:
        kept = kept.withColumn("text", F.pandas_udf(_cutter(cut_words), "string")("text", "spans"))
    return kept.select(*(F.col("_row").getField(others[c]).alias(c) if c in others else c for c in docs.columns))


_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text: str, spans, cut_words: int) -> str:
    """text without the spans of at least cut_words words."""
    spans = [s for s in spans if s[1] - s[0] >= cut_words]
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return "".join([*out, text[last:]])


def _cutter(cut_words: int):
    import pandas as pd

    def udf(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t, s, cut_words) for t, s in zip(text, spans)])

    return udf


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    return verdicts(found).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
