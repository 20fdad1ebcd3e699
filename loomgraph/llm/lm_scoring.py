"""Marginal likelihood of texts over all segmentations into the pieces of an existing subword vocabulary.

A word is a lattice of vocabulary pieces (word-initial ones carry the vocabulary's mark, and single bytes stand in for
characters that no piece has); a forward recursion in log space sums all segmentations. Piece scores start from the
vocabulary's own order and are re-estimated from the training part by one expectation step over its word counts. A
text's probability is the product of its words' and the end's.

Words are counted over the whole corpus; those that take over 1/65,536 of it are at most 65,536, whatever the corpus, and
are broadcast. All others meet their counts in a shuffle join, one row per document and word.

Defined results: null and empty texts have the end token alone; a null doc_id counts as training; repeated rows are
scored each; without training rows the counts are 0 and the vocabulary's own scores hold; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, docs_view, sliced
from loomgraph.llm._words import window_hashes

FREQUENT = 65_536
#: Different words that a worker counts before it passes their counts on.
FLUSH_WORDS = 400_000
#: Characters of words that go through the lattice at once.
LATTICE_CHARS = 120_000
#: Longer words go through the lattice alone, in pieces of about the square root of their length at once.
LONG_CHARS = 1_000
MARK = "▁"
_UPPER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_UPPER).split()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _steps(seeds: np.ndarray, lps: np.ndarray) -> np.ndarray:
    """The recursion a[j] = log(sum over s of exp(a[j - s] + lps[s - 1, j - s])) along many stretches at once. seeds: ... x stretch x L, the
    values before each stretch, the last one last; lps: L x stretch x (L + n), by where a piece begins. Gives ... x stretch x (L + n)."""
    longest, n = len(lps), lps.shape[2] - len(lps)
    out = np.full((*seeds.shape[:-1], longest + n), -np.inf)
    out[..., :longest] = seeds
    for j in range(longest, longest + n):
        got = out[..., j - 1] + lps[0, :, j - 1]
        for s in range(2, longest + 1):
            got = np.logaddexp(got, out[..., j - s] + lps[s - 1, :, j - s])
        out[..., j] = got
    return out


def forward(lps: np.ndarray) -> np.ndarray:
    """alpha[j], the log probability of a word's first j characters, from lps[s - 1, i], that of the piece of s characters at i (-inf: none).

    The word is cut into stretches. What a stretch makes of the values before it is linear (in probabilities), so all stretches are
    run at once from unit vectors, their effects are applied one after the other, and all are run again from the true values."""
    longest, size = lps.shape
    n = max(math.isqrt(size), longest)
    count = -(-size // n)
    padded = np.full((longest, longest + count * n), -np.inf)
    padded[:, longest - 1 : longest - 1 + size] = lps
    cut = np.lib.stride_tricks.sliding_window_view(padded, longest + n, axis=1)[:, ::n]
    unit = np.full((longest, count, longest), -np.inf)
    unit[np.arange(longest), :, np.arange(longest)] = 0
    made = np.concatenate([_steps(unit[:, k : k + 64], cut[:, k : k + 64])[..., -longest:] for k in range(0, count, 64)], axis=1)
    seeds = np.full((count, longest), -np.inf)
    seeds[0, -1] = 0
    for k in range(1, count):
        seeds[k] = np.logaddexp.reduce(seeds[k - 1][:, None] + made[:, k - 1], axis=0)
    return np.append(0.0, _steps(seeds, cut)[:, longest:].reshape(-1))[: size + 1]


class Lattice:
    """Pieces as hashes of their characters, with natural-log probabilities; the last entry is the end."""

    def __init__(self, pieces: list[str], byte_ids: list[int], logp: np.ndarray):
        self.byte_ids = np.array(byte_ids)
        units = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        keys = window_hashes(units, starts, ends)
        keys[self.byte_ids] = 0  # "<0x41>" as text is not a piece
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.longest = max((len(p) for k, p in enumerate(pieces) if k not in set(byte_ids)), default=1)
        self.logp = logp

    def with_logp(self, logp: np.ndarray) -> Lattice:
        twin = object.__new__(Lattice)
        twin.__dict__ |= self.__dict__ | {"logp": logp}
        return twin

    def _edges(self, units: np.ndarray, room: np.ndarray):
        """For each piece length, the piece at each place (-1: none) and its log probability; room: characters to the word's end."""
        n = len(units)
        for size in range(1, self.longest + 1):
            at = np.flatnonzero(room >= size)
            if not len(at):
                return
            h = window_hashes(units, at, at + size)
            k = np.searchsorted(self.keys, h)
            k[k == len(self.keys)] = 0
            hit = self.keys[k] == h
            piece = np.full(n, -1)
            piece[at[hit]] = self.ids[k[hit]]
            lp = np.full(n, -np.inf)
            lp[at[hit]] = self.logp[piece[at[hit]]]
            yield piece, lp

    def _bytes(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Of each character: the number of its kind, and the log probability of its bytes; the bytes' pieces of each kind."""
        kinds, which = np.unique(units, return_inverse=True)
        spelled = [[int(self.byte_ids[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
        return which, np.array([sum(self.logp[i] for i in s) for s in spelled])[which] if len(kinds) else np.zeros(0), spelled

    def marginals(self, words: list[bytes], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The log probability of each word, and with weights the expected count of each piece."""
        out, expected = np.empty(len(words)), None if weights is None else np.zeros(len(self.logp))
        texts = [MARK + w.decode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        k = 0
        while k < len(order):
            total = np.cumsum(size[order[k : k + LATTICE_CHARS]])
            n = 1 if size[order[k]] > LONG_CHARS else max(int(np.searchsorted(total, LATTICE_CHARS, "right")), 1)
            some = order[k : k + n]
            out[some] = self._run([texts[i] for i in some], size[some], None if weights is None else weights[some], expected)
            k += n
        return out, expected

    def _run(self, texts: list[str], size: np.ndarray, weights, expected) -> np.ndarray:
        """texts: longest first."""
        units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        start = np.cumsum(size) - size
        room = np.repeat(start + size, size) - np.arange(len(units))
        edges = list(self._edges(units, room))
        kind, byte_lp, spelled = self._bytes(units)
        one = np.logaddexp(edges[0][1], byte_lp)
        lps = [one, *(lp for _, lp in edges[1:])]
        # alpha[start + j + word]: of the first j characters of a word; words of at least j characters come first
        first = start + np.arange(len(texts))
        alpha = np.full(len(units) + len(texts), -np.inf)
        alpha[first] = 0
        longest = int(size[0]) if len(size) else 0
        if longest > LONG_CHARS:
            alpha = forward(np.stack(lps))
            longest = 0
        reach = np.searchsorted(-size, -np.arange(longest + 1), "right")
        for j in range(1, longest + 1):
            n = reach[j]
            got = np.full(n, -np.inf)
            for s in range(1, min(j, len(lps)) + 1):
                got = np.logaddexp(got, alpha[first[:n] + j - s] + lps[s - 1][start[:n] + j - s])
            alpha[first[:n] + j] = got
        whole = alpha[first + size]
        if expected is not None:
            beta = np.full(len(alpha), -np.inf)
            beta[first + size] = 0
            if len(texts) == 1 and size[0] > LONG_CHARS:
                turned = np.full((len(lps), int(size[0])), -np.inf)
                for s, lp in enumerate(lps, 1):
                    turned[s - 1, : size[0] - s + 1] = lp[: size[0] - s + 1][::-1]
                beta = forward(turned)[::-1]
            for j in range(longest - 1, -1, -1):
                n = reach[j + 1]
                got = np.full(n, -np.inf)
                for s in range(1, len(lps) + 1):
                    m = reach[j + s] if j + s <= longest else 0
                    if not m:
                        break
                    got[:m] = np.logaddexp(got[:m], beta[first[:m] + j + s] + lps[s - 1][start[:m] + j])
                beta[first[:n] + j] = got
            word = np.repeat(np.arange(len(texts)), size)
            place = np.arange(len(units)) + word
            for s, (piece, lp) in enumerate(edges, 1):
                at = np.flatnonzero(piece >= 0)
                share = np.exp(alpha[place[at]] + lp[at] + beta[place[at] + s] - whole[word[at]]) * weights[word[at]]
                expected += np.bincount(piece[at], share, len(expected))
            share = np.exp(alpha[place] + byte_lp + beta[place + 1] - whole[word]) * weights[word]
            for k, total in enumerate(np.bincount(kind, share, len(spelled))):
                for i in spelled[k]:
                    expected[i] += total
        return whole


def vocabulary(path: str) -> Lattice:
    """The file's pieces; its scores order them, and stand for probabilities by Zipf's law."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    used = [i for i in range(n) if not sp.is_control(i) and not sp.is_unknown(i)]
    pieces = [sp.id_to_piece(i) for i in used]
    place = {sp.id_to_piece(i): k for k, i in enumerate(used) if sp.is_byte(i)}
    byte_ids = [place[f"<0x{b:02X}>"] for b in range(256)]
    score = np.array([sp.get_score(i) for i in used])
    rank = np.empty(len(used))
    rank[np.argsort(-score, kind="stable")] = np.arange(len(used))
    weight = 1 / (rank + 10)
    weight[byte_ids] = weight.min() / 16
    weight = np.append(weight, weight.max())  # the end
    return Lattice(pieces, byte_ids, np.log(weight / weight.sum()))


def count_words(view: DataFrame) -> DataFrame:
    """word, c_all and c (in training rows) from rows with text and train; summed in the worker first."""
    def run(batches):
        every: Counter = Counter()
        train: Counter = Counter()

        def flush():
            words = list(every)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(every.values(), pa.int64()), pa.array([train[w] for w in words], pa.int64())], names=["word", "c_all", "c"])
            every.clear()
            train.clear()
            for k in range(0, out.num_rows, 20_000):
                yield out.slice(k, 20_000)

        for batch in sliced(batches):
            for text, is_train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                every.update(words)
                if is_train:
                    train.update(words)
                if len(every) > FLUSH_WORDS:
                    yield from flush()
        yield from flush()

    made = view.select("text", "train").mapInArrow(run, "word binary, c_all long, c long")
    return made.groupBy("word").agg(F.sum("c_all").alias("c_all"), F.sum("c").alias("c"))


def train(counts: DataFrame, lattice: Lattice, ends: int) -> Lattice:
    """Piece scores after one expectation step over the training words' counts; the sums are one row per piece."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        total = None
        for batch in batches:
            got = shared.value.marginals(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))[1]
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    sums = counts.where("c > 0").select("word", "c").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    expected = np.zeros(len(lattice.logp))
    for r in sums:
        expected[r["piece"]] = r["n"]
    expected[-1] = ends
    if not expected.any():
        return lattice
    weight = expected + 100 * np.exp(lattice.logp)  # the vocabulary's own scores weigh as much as 100 pieces
    return lattice.with_logp(np.log(weight / weight.sum()))


def word_scores(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """word, c and lp (log10 of its marginal probability)."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        for batch in batches:
            lp = shared.value.marginals(batch.column(0).to_pylist())[0] / math.log(10) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], names=["word", "c", "lp"])

    return counts.select("word", "c").mapInArrow(run, "word binary, c long, lp double")


def score(docs: DataFrame, train_when, path: str | None = None, frequent: int = FREQUENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of each row; train_when: a condition on docs."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    view = docs_view(docs.select("doc_id", "text", F.coalesce(train_when, F.lit(True)).alias("train")), "train")
    counts = scratch.keep(count_words(view), "counts")
    sums = counts.agg(F.sum("c_all").alias("all"), F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = view.where("train").count()
    n, v = (sums["c"] or 0) + ends, sums["v"] + (ends > 0)
    lattice = train(counts, vocabulary(path or default_path()), ends)
    unit, last = math.log10(n + v + 1), lattice.logp[-1] / math.log(10)
    often = F.col("c_all") > (sums["all"] or 0) / frequent
    common = {bytes(r["word"]): (math.log10(r["c"] + 1) - unit, int(r["c"] > 0), r["lp"]) for r in word_scores(counts.where(often), lattice).toLocalIterator()}
    shared = spark.sparkContext.broadcast(common)
    end = (math.log10(ends + 1) - unit, int(ends > 0), last)

    def run(batches):
        """A row with the sums of the common words of each text, and one per other word; the first has a key that no word has."""
        known = shared.value
        for batch in sliced(batches):
            row, key, tf, n_tokens, n_known, base, model = [], [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                b, c, m = end
                for w, n in Counter(words).items():
                    if (got := known.get(w)) is None:
                        row.append(k)
                        key.append(w)
                        tf.append(n)
                    else:
                        b += n * got[0]
                        c += n * got[1]
                        m += n * got[2]
                more = len(row) - len(base)
                n_tokens += [0] * more
                n_known += [0] * more
                base += [0.0] * more
                model += [0.0] * more
                row.append(k)
                key.append(b" %d" % (hash((k, len(words))) & 0xFFFFFFFF))
                tf.append(0)
                n_tokens.append(len(words) + 1)
                n_known.append(c)
                base.append(b)
                model.append(m)
            row = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(2).take(row), batch.column(3).take(row), pa.array(key, pa.binary()), pa.array(tf, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())],
                names=["doc_id", "th", "train", "key", "tf", "n_tokens", "n_known", "base", "model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = view.select("doc_id", "text", "th", "train").mapInArrow(run, f"doc_id {kind}, th long, train boolean, key binary, tf long, n_tokens long, n_known long, base double, model double")
    rare = word_scores(counts.where(~often), lattice)
    joined = parts.join(rare, parts["key"] == rare["word"], "left")
    term = lambda x: F.coalesce(F.col("tf") * x, F.lit(0.0))
    summed = joined.groupBy("doc_id", "th", "train").agg(
        F.count(F.when(F.col("n_tokens") > 0, 1)).alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + term(F.log10(F.col("c") + 1) - unit)).alias("base"), F.sum(F.col("model") + term(F.col("lp"))).alias("model"))
    # equal rows were summed together
    each = lambda c: (F.col(c) / F.col("copies")).cast("long").alias(c)
    return summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "train", each("n_tokens"), each("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("copies")).alias("base_score"), (F.col("model") / F.col("copies")).alias("score"))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(docs, ~held_out).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
