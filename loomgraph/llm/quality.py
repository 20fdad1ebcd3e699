"""Host-level quality rules with an empirical beta prior.

Every document is measured; a host's failures of each rule are summed, each host's rate is shrunk towards the rates of
all hosts by a beta prior fitted by moments, and a host one of whose shrunken rates exceeds its limit is rejected
with all its documents. Documents that fail the base rule go in any case.

Windows and lines are compared within one text by 64-bit hashes of their bytes.

Defined results: null or empty texts have no words, and fail; documents without a host (null) are judged by
themselves alone; repeated rows each count; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, sliced, table, utf8
from loomgraph.llm._words import mix, ngram_hashes, spans, window_hashes

REPEAT = 3
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails` holds; a host is rejected where its shrunken rate exceeds `limit`."""

    name: str
    fails: Column
    limit: float


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def default_rules() -> list[Rule]:
    return [
        Rule("base", base_failed(), 0.6),
        Rule("symbols", F.col("n_symbols") * 2 > F.col("n_words"), 0.6),
        Rule("lines", F.col("n_dup_lines") * 2 > F.col("n_lines"), 0.6),
    ]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure_column(text: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of a column without nulls."""
    raw, offsets = utf8(text)
    n = len(offsets) - 1
    starts, ends, first = spans(raw, offsets)
    in_word = np.zeros(len(raw) + 1, np.int8)
    np.add.at(in_word, starts, 1)
    np.add.at(in_word, ends, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8)
    out = {
        "n_words": np.diff(first),
        "word_chars": _sums(in_word.astype(np.int64) * ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[raw], offsets),
    }
    # lines that hold a word, and those that repeat an earlier one
    cut = np.flatnonzero(raw == 10)
    begins = np.union1d(offsets[:-1], cut + 1)
    begins = begins[begins < len(raw)]
    stops = np.append(begins[1:], len(raw))
    stops = np.where(np.isin(stops - 1, cut, assume_unique=False), stops - 1, stops)
    full = np.searchsorted(starts, stops) > np.searchsorted(starts, begins)
    begins, stops = begins[full], stops[full]
    doc = np.searchsorted(offsets, begins, "right") - 1
    line = mix(window_hashes(raw, begins, stops) ^ doc.astype(np.uint64)) if len(begins) else np.zeros(0, np.uint64)
    once = np.unique(line, return_index=True)[1]
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[once], minlength=n)
    # words in windows that the text holds twice or more
    words = window_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = ngram_hashes(words, REPEAT)
    covered = np.zeros(len(words), bool)
    doc = np.searchsorted(first, np.arange(len(words)), "right") - 1
    if len(grams):
        whole = np.flatnonzero(doc[: len(grams)] == doc[REPEAT - 1 :])
        _, which, count = np.unique(mix(grams[whole] ^ doc[whole].astype(np.uint64)), return_inverse=True, return_counts=True)
        again = whole[count[which] > 1]
        for j in range(REPEAT):
            covered[again + j] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


_SCHEMA = pa.schema([(m, pa.int64()) for m in _MEASURES])


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of each row."""
    def run(batches):
        for batch in sliced(batches, "text"):
            own = table(_SCHEMA, **measure_column(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own.columns], names=["doc_id", "host", *_MEASURES])

    plain = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    kind = [plain.schema[c].dataType.simpleString() for c in ("doc_id", "host")]
    return plain.mapInArrow(run, f"doc_id {kind[0]}, host {kind[1]}, " + ", ".join(f"{m} long" for m in _MEASURES))


def host_verdicts(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """host, n_docs, for each rule its shrunken rate, and host_kept."""
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(r.fails.cast("long")).alias(r.name) for r in rules))
    moments = hosts.agg(*(f(F.col(r.name) / F.col("n_docs")).alias(f"{kind}_{r.name}") for r in rules for kind, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    kept = F.lit(True)
    for r in rules:
        mean, var = moments[f"mean_{r.name}"] or 0.0, moments[f"var_{r.name}"] or 0.0
        weight = min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0) if var > 0 else 1000.0
        rate = (F.col(r.name) + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
        hosts = hosts.withColumn(f"rate_{r.name}", rate)
        kept = kept & (F.col(f"rate_{r.name}") <= r.limit)
    return hosts.withColumn("host_kept", kept)


def judge(docs: DataFrame, host: str = "source", rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, host, the measures, base_failed, host_kept and kept of each row."""
    measured = Scratch(docs.sparkSession, "quality").keep(measure(docs, host), "measured")
    verdicts = host_verdicts(measured, rules or default_rules()).select(F.col("host").alias("_host"), "host_kept")
    joined = measured.join(verdicts, measured["host"] == verdicts["_host"], "left").drop("_host")
    return joined.withColumn("base_failed", base_failed()).withColumn("host_kept", F.coalesce("host_kept", F.lit(True))).withColumn(
        "kept", ~F.col("base_failed") & F.col("host_kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_kept", "kept")
