"""Toxicity by a subsequence string kernel, a Nyström map and a linear support vector machine.

The kernel of two windows sums, over the symbol triples that both hold in order (not only side by side), the product of their
weights: `decay` to the power of the symbols that a triple spans, at most `reach`. So gaps and inserted characters lower
a similarity and don't end it. A window is a word of a sentence, between two marks for its ends, with what isn't a letter
taken out; letters that stand one by one ("b a d") make a window together, a token's longer runs of letters are windows
beside the whole, and words of over `PIECE` letters are cut into overlapping windows. Triples are hashed into `BUCKETS`
columns, so letters of every script count.

The machine is trained on the sentences of labelled texts, whose labels belong to the texts (multiple instances). At first
all windows of toxic texts count, each by the odds that its texts' share of toxic ones isn't chance among so many windows.
Then, in rounds, a toxic text's worst sentence is toxic, and others of its that the machine takes for such; a sentence stands
for itself by its worst window; clean sentences give theirs, of this round and the ones before. As a clean text must not hold
one bad window among many, clean sentences together weigh `CLEAN` times as much as toxic ones. Features are a window's kernels
with landmark windows, whitened (Nyström); landmarks are drawn from the labelled sentences, at first by that departure and by
frequency, then those that most sentences are judged by. As the machine is linear and the kernel an inner product over
triples, its decision collapses into one weight per column, so scoring a word costs nothing that grows with the landmarks.

A text's score is a logistic curve of its two worst windows and the logarithm of the number of its tokens. The curve is
fitted on a quarter of the sampled texts, which the machine doesn't see.

Training takes at most `most` labelled texts of either kind, the first by a hash of their ids; everything else covers all
rows. The curve weighs a sampled text by the texts of its kind that it stands for, so its scores follow the share of toxic
texts among all labelled ones.

Defined results: null, empty and letterless texts have no windows and get the score of a text without bad words; labels
that are null are no labels, and a text with several counts as toxic if one says so; without labelled texts of both kinds that
hold windows the score is 0 for all; repeated rows are scored each; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, sliced
from loomgraph.llm._words import mix

#: Labelled texts of either kind that training takes at most.
MOST = 3000
LANDMARKS, ROUNDS, STEPS = 256, 5, 4
#: What a toxic text costs, and how many times as much as all toxic sentences the clean ones weigh in the rounds.
COST, CLEAN = 10.0, 30.0
DECAY, REACH, BUCKETS = 0.7, 8, 1 << 16
#: Letters of a window at most.
PIECE = 64
#: A sampled text in so many is kept for the curve.
FOLDS = 4
#: Tokens whose decisions a task keeps, windows that a task takes up at once, and tasks that sum up a training step.
CACHE_WORDS, BLOCK, TASKS = 200_000, 2048, 16
#: Decisions beyond these say no more about a text.
LOW, HIGH = -1.5, 2.0

_NO_LETTERS = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"[.!?]+\s+|\n")
#: Single letters in a row, as in "b a d": one window with gaps.
_SPREAD = re.compile(r"(?<!\S)[^\W\d_](?:[\W_]{1,3}[^\W\d_]){2,}(?!\S)")
_FIRST, _MIDDLE, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def tokens_of(text: str) -> list[str]:
    """What white space parts, and spread-out letters as one token."""
    out = text.split()
    if _SPREAD.search(text):
        out += [_NO_LETTERS.sub("", m[0]) for m in _SPREAD.finditer(text)]
    return out


def windows_of(token: str) -> list[str]:
    """The windows of one token: its letters together, and its runs of three letters and more if there are several runs."""
    runs = [r for r in _NO_LETTERS.split(token.lower()) if r]
    if not runs:
        return []
    out = ["".join(runs)] + ([r for r in runs if len(r) > 2] if len(runs) > 1 else [])
    if max(map(len, out)) > PIECE:
        out = [w[k : k + PIECE] for w in out for k in range(0, max(len(w) - PIECE // 2, 1), PIECE // 2)]
    return out


def triples(windows: list[str], decay: float = DECAY, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, column, weight) of all symbol triples of the windows, in order and each column of a window once; every window has length 1."""
    units = np.frombuffer("".join(f"\x02{w}\x03" for w in windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in windows], np.int64)
    codes, owner = mix(units.astype(np.uint64) + np.uint64(1)), np.repeat(np.arange(len(windows)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(units))
    first, middle, last = codes * _FIRST, codes * _MIDDLE, codes * _LAST
    keys, weights = [], []
    for d2 in range(2, reach):  # a triple spans d2 + 1 symbols, its middle one stands at d1
        at = np.flatnonzero(room > d2)
        ends = first[at] + last[at + d2]
        for d1 in range(1, d2):
            keys.append(owner[at] * BUCKETS + (mix(ends + middle[at + d1]) % np.uint64(BUCKETS)).astype(np.int64))
            weights.append(np.full(len(at), decay ** (d2 + 1)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    key, weight = key[cut], np.add.reduceat(weight[order], cut) if len(cut) else weight
    own, column = key // BUCKETS, key % BUCKETS
    return own, column, weight / np.sqrt(np.bincount(own, weight * weight, len(windows)))[own]


class Landmarks:
    """The Nyström map: kernels with landmark windows, whitened."""

    def __init__(self, windows: list[str]):
        own, column, weight = triples(windows)
        order = np.argsort(column, kind="stable")
        self.owner, self.column, self.weight, self.n = own[order], column[order], weight[order], len(windows)
        self.start = np.searchsorted(self.column, np.arange(BUCKETS + 1))
        values, vectors = np.linalg.eigh(self.kernel(windows).astype(float))
        keep = values > 1e-6 * values.max()
        self.whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def kernel(self, windows: list[str]) -> np.ndarray:
        """windows x landmarks. A triple meets only the landmarks that hold its column."""
        own, column, weight = triples(windows)
        n = self.start[column + 1] - self.start[column]
        hit = np.flatnonzero(n)
        n = n[hit]
        place = np.arange(n.sum()) + np.repeat(self.start[column[hit]] - np.cumsum(n) + n, n)
        out = np.bincount(np.repeat(own[hit], n) * self.n + self.owner[place], self.weight[place] * np.repeat(weight[hit], n), len(windows) * self.n)
        return out.reshape(len(windows), self.n).astype(np.float32)

    def features(self, windows: list[str]) -> np.ndarray:
        x = self.kernel(windows) @ self.whiten
        return np.column_stack([x, np.ones(len(x), np.float32)])

    def machine(self, w: np.ndarray) -> Machine:
        """A decision on features as one on triples."""
        return Machine(np.bincount(self.column, self.weight * (self.whiten @ w[:-1])[self.owner], BUCKETS), float(w[-1]))


@dataclass
class Machine:
    weights: np.ndarray  # by column
    bias: float

    def decide(self, windows: list[str]) -> np.ndarray:
        """Over 0: a bad window."""
        out = np.full(len(windows), self.bias)
        for k in range(0, len(windows), BLOCK):
            own, column, weight = triples(windows[k : k + BLOCK])
            out[k : k + BLOCK] += np.bincount(own, self.weights[column] * weight, len(out[k : k + BLOCK]))
        return out


@dataclass
class Model:
    machine: Machine | None
    curve: np.ndarray | None  # of the worst and the second worst window, the logarithm of the number of tokens, and 1


def newton(x: np.ndarray, f: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of a step for a linear machine with squared hinge loss. f: the rows' decisions so far; toxic, clean: their weights."""
    toxic, clean = toxic * (f < 1), clean * (f > -1)
    active = (toxic + clean) > 0
    part = x[active]
    return (part * (toxic + clean)[active, None].astype(np.float32)).T @ part, part.T @ (toxic - clean)[active].astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The weights of a curve through 0/1 marks, the last one the shift; a weak prior keeps them finite."""
    a = np.column_stack([x, np.ones(len(x))])
    weight = weight * len(x) / weight.sum()
    w = np.append(1.0, np.zeros(x.shape[1]))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), a.T @ (weight * (p - y)) + 0.05 * w)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return w


def departure(toxic: Column, clean: Column, share: float) -> Column:
    """How a window's texts depart from the sample's share of toxic ones, as a log likelihood ratio; negative if the other way."""
    n = toxic + clean
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return (part(toxic, share) + part(clean, 1 - share)) * F.when(toxic > n * share, 1).otherwise(-1)


class Training:
    """The labelled sentences, and the rounds of a machine over them. All tables lie in the scratch folder."""

    def __init__(self, texts: DataFrame, scratch: Scratch):
        self.texts, self.scratch, self.spark = texts, scratch, texts.sparkSession  # texts: toxic int, text string

    def count(self, name: str, count: Callable[[int, list[list[str]], dict], None], machine: Machine | None = None) -> DataFrame:
        """(window, toxic, clean) summed over all texts; count adds up one text's in a dict."""
        shared = self.spark.sparkContext.broadcast(machine)

        def run(batches):
            for batch in sliced(batches):
                texts = [[[*{w for t in tokens_of(s) for w in windows_of(t)}] for s in _SENTENCE.split(x)] for x in batch.column(1).to_pylist()]
                known: dict[str, float] = {}
                if shared.value is not None:
                    new = [*{w for x in texts for s in x for w in s}]
                    known = dict(zip(new, shared.value.decide(new).tolist()))
                sums: dict[str, list[float]] = {}
                for k, x in zip(batch.column(0).to_pylist(), texts):
                    for kind, window in count(k, [s for s in x if s], known):
                        sums.setdefault(window, [0.0, 0.0])[1 - kind] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums.keys(), pa.string()), *(pa.array([v[i] for v in sums.values()], pa.float64()) for i in (0, 1))], names=["window", "toxic", "clean"])

        found = self.texts.mapInArrow(run, "window string, toxic double, clean double")
        return self.keep(found, name)

    def keep(self, counts: DataFrame, name: str) -> DataFrame:
        """Summed by window, and dealt evenly to the tasks of the steps."""
        return self.scratch.keep(counts.groupBy("window").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).repartition(TASKS), name)

    def fit(self, counts: DataFrame, windows: list[str], cost: tuple[float, float], before: Machine | None = None, steps: int = 1) -> Machine:
        """Newton steps over all counted windows; the first starts from the decisions of the machine before. cost: of all toxic ones, of all clean ones."""
        landmarks = Landmarks(windows)
        sums = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
        each = (cost[0] / max(sums["toxic"], 1e-9), cost[1] / max(sums["clean"], 1e-9))
        w = None
        for _ in range(steps):
            shared = self.spark.sparkContext.broadcast((landmarks, before, w))

            def run(batches):
                maps, prior, now = shared.value
                left = right = 0.0
                for batch in batches:
                    for k in range(0, batch.num_rows, BLOCK):
                        part = batch.slice(k, BLOCK)
                        own = part.column(0).to_pylist()
                        x = maps.features(own)
                        f = x @ now.astype(np.float32) if now is not None else prior.decide(own) if prior is not None else np.zeros(len(own))
                        a, b = newton(x, f, *(part.column(1 + i).to_numpy() * each[i] for i in (0, 1)))
                        left, right = left + a.astype(float), right + b.astype(float)
                if np.ndim(left):
                    yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["a", "b"])

            rows = counts.select("window", "toxic", "clean").coalesce(TASKS).mapInArrow(run, "a binary, b binary").collect()  # at most TASKS
            right = sum(np.frombuffer(r["b"]) for r in rows)
            left = sum(np.frombuffer(r["a"]) for r in rows).reshape(len(right), len(right))
            new = np.linalg.solve(left + np.diag(np.append(np.ones(len(right) - 1), 1e-6)), right)
            done = w is not None and np.allclose(new, w, atol=1e-3)
            w = new
            if done:
                break
        return landmarks.machine(w)

    def run(self) -> Machine | None:
        cost = COST * self.texts.where("toxic = 1").count()
        every = self.count("windows", _all_windows)
        sums = every.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("n")).first()
        if not sums["toxic"] or not sums["clean"]:
            return None
        proof = departure(F.col("toxic"), F.col("clean"), sums["toxic"] / (sums["toxic"] + sums["clean"]))
        turn = -F.log((F.xxhash64("window").bitwiseAND(0xFFFFFFFF) + 1) / F.lit(2.0**32 + 1)) / (F.col("toxic") + F.col("clean"))  # a draw by frequency
        windows = _first(every, F.desc(proof)) + _first(every, turn.asc())
        sure = every.withColumn("toxic", F.col("toxic") / (1 + F.exp(F.least(F.lit(700.0), math.log(sums["n"]) - proof))))
        machine = self.fit(sure, [*dict.fromkeys(windows)], (cost, cost))
        judged: DataFrame | None = None
        for k in range(ROUNDS):
            now = self.count(f"judged-{k}", _worst_windows, machine)
            if judged is not None:  # toxic sentences of this round, clean ones of all
                now = self.keep(now.unionByName(judged.select("window", F.lit(0.0).alias("toxic"), "clean")), f"summed-{k}")
            judged = now
            windows = _first(judged.where("toxic > 0"), F.desc("toxic")) + _first(judged.where("toxic = 0 and clean > 0"), F.desc("clean"))
            machine = self.fit(judged, windows, (cost, CLEAN * cost), machine, STEPS)
        return machine


def _first(counts: DataFrame, order: Column) -> list[str]:
    return [r["window"] for r in counts.orderBy(order, "window").select("window").limit(LANDMARKS // 2).collect()]


def _all_windows(toxic: int, sentences: list[list[str]], known: dict) -> Iterable[tuple[int, str]]:
    """A text's windows once."""
    return ((toxic, w) for w in {w for s in sentences for w in s})


def _worst_windows(toxic: int, sentences: list[list[str]], known: dict) -> Iterable[tuple[int, str]]:
    """The worst window of each clean sentence, or of a text's toxic ones: its worst, and those over 0."""
    worst = [max((known[w], w) for w in s) for s in sentences]
    if not toxic:
        return ((0, w) for _, w in worst)
    top = max(range(len(worst)), key=lambda i: (worst[i], -i), default=-1)
    return ((1, w) for i, (v, w) in enumerate(worst) if v > 0 or i == top)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int = MOST, scratch: Scratch | None = None) -> Model:
    """A model from the labelled rows of docs for whose doc_id may_learn holds."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    marks = labels.where("doc_id is not null and toxic is not null").where(may_learn).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    every = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    ids = F.broadcast(some[0].union(some[1]).select("doc_id", "toxic"))  # at most 2 * most rows
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    sample = scratch.keep(sample.select("toxic", "text", (F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(FOLDS)) == 0).alias("curve")).repartition(TASKS), "sample")
    machine = Training(sample.where("not curve").select("toxic", "text"), scratch).run()
    if machine is None:
        return Model(None, None)
    got = signs(sample.where("curve").select("toxic", "text"), machine).collect()  # four numbers a sampled text
    stands_for = [max(1.0, every.get(k, 0) / most) for k in (0, 1)]  # labelled texts of its kind for each sampled one
    if not got:
        return Model(None, None)
    x, y = np.array([r[1:] for r in got], float), np.array([r["toxic"] for r in got], float)
    return Model(machine, logistic(x, y, np.where(y > 0, stands_for[1], stands_for[0])))


_known: dict[int, dict[str, tuple[float, str]]] = {}


def signs_of(texts: list[str], machine: Machine, key: int) -> np.ndarray:
    """The decisions about the worst window of each text and about the worst other one, and the logarithm of the number of its different tokens."""
    if key not in _known:
        _known.clear()
        _known[key] = {}
    known = _known[key]
    parts = [set(tokens_of(t)) for t in texts]
    new = list(set().union(*parts).difference(known)) if parts else []
    own = [windows_of(t) for t in new]
    flat = [*dict.fromkeys(w for x in own for w in x)]
    value = dict(zip(flat, np.clip(machine.decide(flat), LOW, HIGH).tolist()))
    got = {t: max(((value[w], w) for w in x), default=(LOW, "")) for t, x in zip(new, own)}
    if len(known) + len(got) <= CACHE_WORDS:
        known.update(got)
        get = known.__getitem__
    else:
        get = lambda t: known.get(t) or got[t]
    out = np.full((len(texts), 3), LOW)
    for k, p in enumerate(parts):
        mine = [*map(get, p)]
        first = max(mine, default=(LOW, ""))
        out[k] = first[0], max((v for v, w in mine if w != first[1]), default=LOW), math.log1p(len(p))
    return out


def signs(rows: DataFrame, machine: Machine) -> DataFrame:
    """The rows without text, with worst, second and size."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)
    key = hash((machine.bias, float(machine.weights.sum())))
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in sliced(batches):
            got = signs_of(batch.column(len(others)).to_pylist(), shared.value, key)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(got[:, i].copy(), pa.float64()) for i in range(3))], names=[*others, "worst", "second", "size"])
        _known.clear()  # the worker lives on under other work

    plain = rows.select(*others, "text")
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != "text"]
    return plain.mapInArrow(run, ", ".join([*schema, "worst double", "second double", "size double"]))


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """doc_id (with keep_text all columns of docs, as _row) and score of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if keep_text:
        rows = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    if model.machine is None:
        return rows.drop("text").withColumn("score", F.lit(0.0))
    a, b, c, shift = (float(v) for v in model.curve)
    z = F.col("worst") * a + F.col("second") * b + F.col("size") * c + shift
    return signs(rows, model.machine).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))).drop("worst", "second", "size")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without those that score at least limit."""
    model = train(docs, labels, ~held_out())
    return score(docs, model, keep_text=True).where(F.col("score") < limit).select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
