"""Where the tokens of two tokenizers end together, and which of them correspond throughout a corpus.

A and B spell the same bytes (a space and the text). The union of both kinds of ends cuts the bytes into elementary intervals; a
search in either array of ends gives an interval's A and B token, so each interval is the overlap of two tokens, and those where
both end close a group. Tokens that end together are linked.

A text is cut into units before each space that follows no white space; neither tokenizer joins characters over such a place,
so both end there and a unit's tokens, groups and links don't depend on what stands around it. A task keeps the units that it has
seen, tokenizes only new ones, many at once, and puts texts together from units.

Of two tokens that end together one's bytes are the ending of the other's. So the pairs that can ever be linked are bounded by the two
vocabularies (each token has at most as many endings as bytes; some 300,000 pairs for these), however large the corpus, and
their counts are broadcast. Texts are tokenized once: each document's links are written with it and read again with the counts.

Defined results: texts that are null or empty, or that a tokenizer doesn't spell byte by byte (U+2581 reads as a space), have no tokens;
equal rows each count, and both count for the corpus; a null doc_id is kept; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, sliced

#: Units that a task keeps, and characters of the longest one kept; beyond either, units are only looked at when they come.
CACHE_UNITS, CACHE_CHARS = 250_000, 64
#: Characters of new units that are tokenized in one call.
CALL_CHARS = 100_000
_LOOSE = re.compile(r"\s |^ | $")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ends of the elementary intervals, the A token and the B token over each, and whether both end there. ends_a, ends_b: byte
    offsets at which tokens end, rising, over the same bytes."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def units(text: str) -> list[str]:
    """Space and text in units, each without its first space."""
    parts = text.split(" ")
    if not _LOOSE.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        before = out[-1]
        if p and before and not before[-1].isspace():
            out.append(p)
        else:
            out[-1] = f"{before} {p}"
    return out


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        from loomgraph.llm._tokens import _byte_letters

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in _byte_letters().items()}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(byte[c] for c in names.get(i, "") if c in byte) for i in range(max(names) + 1)]
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.n_b = len(self.bytes_b)
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # a token's number and what follows it in a group: 0 one of its own kind, 1 the end of its kind
        self.said = [np.array([f"{i}{c}" for i in range(n)], object) for n, c in ((len(self.bytes_a), ","), (len(self.bytes_a), "|"), (self.n_b, ","), (self.n_b, ";"))]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of space and text by either tokenizer; None where one doesn't spell it."""
        ids_a = self.a.encode(" " + text, add_special_tokens=False).ids
        ids_b = self.b.encode(text, num_threads=1)
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            return None
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)


class Units:
    """What is known of the units seen so far, by number: counts of tokens and groups, the groups' text and the links."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.links: list[bytes] = []
        self.sizes: list[np.ndarray] = []  # n_a, n_b, n_groups; -1: a unit that isn't spelled

    def add(self, new: list[str]) -> None:
        """Tokenizes new units together: they are joined by the spaces that they begin with."""
        alone = [u for u in new if not u or u[-1].isspace()]
        joined = [u for u in new if u and not u[-1].isspace()]
        k = 0
        while k < len(joined):
            n, size = k, 0
            while n < len(joined) and (n == k or size + len(joined[n]) < CALL_CHARS):
                size += len(joined[n]) + 1
                n += 1
            self._call(joined[k:n])
            k = n
        for u in alone:
            self._call([u])

    def _call(self, some: list[str]) -> None:
        pair = self.pair
        ids = pair.encode(" ".join(some))
        if ids is None:
            if len(some) > 1:
                for u in some:
                    self._call([u])
            else:
                self._put(some, [""], [b""], np.array([[-1, 0, 0]]))
            return
        ids_a, ids_b = ids
        ends_a, ends_b = np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b])
        ends, of_a, of_b, both = elementary(ends_a, ends_b)
        closes = ends[both]
        codes = (ids_a[of_a[both]] * pair.n_b + ids_b[of_b[both]]).astype(np.uint32)
        # the groups' text: A tokens before B tokens, all in order; what follows a token tells whether its kind ends there
        group_a, group_b = np.searchsorted(closes, ends_a), np.searchsorted(closes, ends_b)
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        last_a, last_b = np.isin(ends_a, closes, assume_unique=True), np.isin(ends_b, closes, assume_unique=True)
        words = np.concatenate([np.where(last_a, pair.said[1][ids_a], pair.said[0][ids_a]), np.where(last_b, pair.said[3][ids_b], pair.said[2][ids_b])])[order].tolist()
        cuts = np.cumsum([len(u.encode()) + 1 for u in some])
        upto_a, upto_b, upto = (np.searchsorted(e, cuts, "right") for e in (ends_a, ends_b, closes))
        per = np.diff(np.stack([upto_a, upto_b, upto], 1), axis=0, prepend=0)
        at = [0, *(upto_a + upto_b).tolist()]
        raw, link = codes.tobytes(), [0, *(upto * 4).tolist()]
        self._put(some, ["".join(words[x:y])[:-1] for x, y in zip(at, at[1:])], [raw[x:y] for x, y in zip(link, link[1:])], per)

    def _put(self, some: list[str], text: list[str], links: list[bytes], sizes: np.ndarray) -> None:
        self.number.update(zip(some, range(len(self.text), len(self.text) + len(some))))
        self.text += text
        self.links += links
        self.sizes.append(sizes)


class Tally:
    """Counts of links, as sorted pair codes and their counts; never more than the vocabularies have pairs."""

    def __init__(self):
        self.codes, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, known: Units, seen: np.ndarray) -> None:
        """seen: how often each unit came."""
        codes = np.frombuffer(b"".join(known.links), np.uint32)
        times = np.repeat(seen, [len(x) // 4 for x in known.links])
        codes, times = codes[times > 0], times[times > 0]
        self.codes, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, times]), len(self.codes)).astype(np.int64)


_pairs: dict[tuple[str, str], Pair] = {}


def align_batches(batches: Iterable[pa.RecordBatch], paths: tuple[str, str], groups: bool) -> Iterator[pa.RecordBatch]:
    """A row per document (doc_id, text): its counts, the digest of its groups, its links, with `groups` their text; and a last row with the task's counts of links."""
    if paths not in _pairs:
        _pairs[paths] = Pair(*paths)
    known, tally = Units(_pairs[paths]), Tally()
    seen = np.zeros(0, np.int64)

    def settle():
        tally.add(known, seen)
        known.clear()

    kind = None
    for batch in sliced(batches):
        kind = batch.column(0).type
        parts = [units(t) if t else [] for t in batch.column(1).to_pylist()]
        flat = [u for p in parts for u in p]
        new = set(flat).difference(known.number)
        if len(known.text) + len(new) > CACHE_UNITS and len(known.text):
            settle()
            seen = np.zeros(0, np.int64)
            new = set(flat)
        known.add(sorted(new))
        sizes = np.concatenate(known.sizes) if known.sizes else np.zeros((0, 3), np.int64)
        known.sizes = [sizes]
        number = np.fromiter(map(known.number.__getitem__, flat), np.int64, len(flat))
        bound = np.cumsum([0, *map(len, parts)])
        bad = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(sizes[number, 0] < 0, out=bad[1:])
        spelled = bad[bound[1:]] == bad[bound[:-1]]
        if not spelled.all():  # rare: such documents have no tokens
            parts = [p if ok else [] for p, ok in zip(parts, spelled)]
            number = number[np.repeat(spelled, np.diff(bound))]
            bound = np.cumsum([0, *map(len, parts)])
        total = np.zeros((len(number) + 1, 3), np.int64)
        np.cumsum(sizes[number], axis=0, out=total[1:])
        per = total[bound[1:]] - total[bound[:-1]]
        numbers = number.tolist()
        said = [";".join(map(known.text.__getitem__, numbers[x:y])) for x, y in zip(bound.tolist(), bound[1:].tolist())]
        links = [b"".join(map(known.links.__getitem__, numbers[x:y])) for x, y in zip(bound.tolist(), bound[1:].tolist())]
        grown = np.zeros(len(sizes), np.int64)
        grown[: len(seen)] = seen
        seen = grown + np.bincount(number, minlength=len(sizes))
        digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
        yield _row(kind, batch.column(0), per, digest, links, None, said if groups else None)
        if any(len(u) > CACHE_CHARS for u in new):
            settle()
            seen = np.zeros(0, np.int64)
    if kind is not None:
        settle()
        yield _row(kind, pa.nulls(1, kind), np.zeros((1, 3), np.int64), [""], [tally.codes.tobytes()], [tally.counts.tobytes()], None)


def _row(kind, doc_id, per, digest, links, counts, said) -> pa.RecordBatch:
    n = len(digest)
    text = pa.array(said, pa.large_string()).cast(pa.string()) if said is not None else pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array(per[:, 0]), pa.array(per[:, 1]), pa.array(per[:, 2]), pa.array(digest), text, pa.array(links, pa.binary()), pa.array(counts, pa.binary()) if counts else pa.nulls(n, pa.binary())],
        names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links", "counts"])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes, counts = np.frombuffer(codes, np.uint32), np.frombuffer(counts, np.int64)
            for k in range(0, len(codes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + 50_000].astype(np.int64)), pa.array(counts[k : k + 50_000])], names=["code", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code (A id times the size of B's vocabulary, plus B id) and n of all linked pairs; no more rows than the vocabularies allow."""
    return aligned.where("counts is not null").select("links", "counts").mapInArrow(_unpacked, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, groups: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row; with `groups` their text too."""
    spark, paths = docs.sparkSession, paths or default_paths()
    scratch = scratch or Scratch(spark, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = plain.mapInArrow(lambda b: align_batches(b, paths, groups), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links binary, counts binary")
    aligned = scratch.keep(made, "aligned")
    counted = pair_counts(aligned).toArrow()
    code, n = counted["code"].to_numpy(), counted["n"].to_numpy()
    order = np.argsort(code)
    code, n = code[order].astype(np.uint32), n[order]
    n_b = len(Pair(*paths).bytes_b)
    most = np.zeros(n_b, np.int64)
    np.maximum.at(most, code % n_b, n)
    shared = spark.sparkContext.broadcast((code, n, n == most[code % n_b]))

    def look(batches):
        code, n, best = shared.value
        for batch in batches:
            links = batch.column("links").to_pylist()
            at = np.searchsorted(code, np.frombuffer(b"".join(links), np.uint32))
            bound = np.cumsum([0, *(len(x) // 4 for x in links)])
            sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, n)]
            n_best, count_sum = (pa.array(s[bound[1:]] - s[bound[:-1]]) for s in sums)
            own = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(bound)), n_best, count_sum, batch.column("groups_sha256"), batch.column("groups")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])

    rows = aligned.where("counts is null").drop("counts").mapInArrow(look, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    return rows if groups else rows.drop("groups")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
