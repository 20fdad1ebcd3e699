"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Sources have weights and share a multiple of all words; a source gives each of its words `repeats` times at most, and what
it can't give the others share by weight. The mix is a schedule of 2**k slots: slot j takes the source whose part of the
cumulative targets holds the van der Corput point of j (its bits in reverse). A source's slots are therefore a run of
reversed numbers, so they are made from the sources' bounds without a join, in pieces, and a slot's rank among those of its source is a
sum over its bits, without a window. Each source's documents stand in the order of a hash, one after the other and repeated;
that stream is cut into blocks of equally many words, and the slot of rank r takes block r. Words taken follow the targets exactly,
apart from rounding to whole words.

Places of documents in their source's stream are prefix sums over buckets: a source of n documents has sqrt(n) buckets of
some sqrt(n) documents, so a source that holds most of the corpus is spread like all others.

Defined results: null and empty texts have size 0 and take nothing; a null source is a source of its own, the last; a null
doc_id is kept; equal rows (doc_id, text, source) each count, and which of them takes more is open; an empty table gives
none; where no source has words all targets are 0; other columns of the table play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, text_key

WEIGHTS = (5, 2, 1)
#: Words in a block, as long as the schedule stays under 2**MOST_BITS slots; corpora beyond that have longer blocks.
BLOCK_WORDS, LEAST_BITS, MOST_BITS = 256, 10, 31
#: Slots that one row of the schedule's seed stands for.
SLOTS_AT_ONCE = 4096


@dataclass(frozen=True)
class Mix:
    """sources: source, sid, source_size, weight, target, taken; placed: the documents with words and their places; silent: those without."""

    sources: DataFrame
    placed: DataFrame
    silent: DataFrame
    bits: int


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def prefixed(scratch: Scratch, df: DataFrame, order: Column, value: str, name: str) -> DataFrame:
    """df with `nth` (from 0) and `before` (the sum of value ahead) in a total order: sorted by ranges, so that no task has all rows;
    only one row per range meets in one window. value: whole numbers."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    kept = scratch.keep(ranged, name)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum")).select(
        "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum0"))
    within = Window.partitionBy("_part").orderBy("_at")
    out = kept.withColumn("_row", F.row_number().over(within) - 1).withColumn("_here", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.join(parts, "_part").select(*df.columns, (F.col("_n0") + F.col("_row")).alias("nth"), (F.col("_sum0") + F.col("_here")).alias("before"))


def targets(scratch: Scratch, by_source: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """source, source_size, n, nth, weight, target and taken (target in whole words)."""
    ranked = prefixed(scratch, by_source, F.col("source").asc_nulls_last(), "source_size", "ranked").drop("before")
    weighed = scratch.keep(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * repeats
    level = 0.0  # words for each unit of weight; it rises from round to round, as only capped sources leave the sharing
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        got = weighed.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))).first()
        if not got[1] or (higher := (share * total - got[0]) / got[1]) <= level:
            break
        level = higher
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return weighed.withColumn("target", target).withColumn("taken", F.least(cap, F.round("target").cast("long")))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2, block_words: int = BLOCK_WORDS, scratch: Scratch | None = None) -> Mix:
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    rows = docs.select("doc_id", "source", text_key(), words_in(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    rows = scratch.keep(rows, "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    aimed = scratch.keep(targets(scratch, by_source, weights, share, repeats), "aimed")
    total = aimed.agg(F.sum("taken")).first()[0] or 0
    bits = min(max((total // block_words).bit_length(), min(LEAST_BITS, total.bit_length())), MOST_BITS)
    bounds = prefixed(scratch, aimed.drop("nth"), F.col("source").asc_nulls_last(), "taken", "bounds").withColumnRenamed("nth", "sid")
    # the first slot of a source: its lower bound in slots, rounded up; in decimals, as the product outgrows 64 bits
    edge = lambda c: F.expr(f"cast((cast({c} as decimal(38, 0)) * {1 << bits} + {max(total, 1) - 1}) div {max(total, 1)} as bigint)")
    lo = F.least(edge("before"), F.lit((1 << bits) - 1))
    sources = bounds.withColumn("lo", lo).withColumn("hi", F.greatest(edge("before + taken"), F.col("lo") + 1)).withColumn(
        "slots", F.when(F.col("taken") > 0, F.col("hi") - F.col("lo")).otherwise(0)).drop("before")  # a source with too few words for a slot shares one
    sources = scratch.keep(sources, "sources")

    known = rows.join(sources.select(F.col("source").alias("_source"), "sid", "n"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    known = known.withColumn("bucket", F.pmod("h", F.ceil(F.sqrt("n")))).where("size > 0")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    start = sums.select("sid", "bucket", F.coalesce(F.sum("words").over(ahead(Window.partitionBy("sid").orderBy("bucket"))), F.lit(0)).alias("start"))
    within = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "th")
    placed = known.withColumn("rn", F.row_number().over(within)).withColumn("here", F.coalesce(F.sum("size").over(ahead(within)), F.lit(0))).join(start, ["sid", "bucket"])
    placed = scratch.keep(placed.select("doc_id", "source", "th", "size", "sid", "bucket", "rn", (F.col("start") + F.col("here")).alias("at")), "placed")
    return Mix(sources, placed, rows.where("size = 0").select("doc_id", "source", "th", "size"), bits)


def slots(sources: DataFrame, bits: int) -> DataFrame:
    """slot, sid and rank (of the slot among its source's, from 0)."""
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, else these few rows would be put together again before they grow
    runs = sources.where("slots > 0").select("sid", "lo", "hi", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {SLOTS_AT_ONCE}"))).alias("run")).repartition(tasks, "sid", "run")
    first = F.col("lo") + F.col("run") * SLOTS_AT_ONCE
    points = runs.select("sid", "lo", "hi", F.explode(F.sequence(first, F.least(first + SLOTS_AT_ONCE, F.col("hi")) - 1)).alias("p"))
    # earlier slots: for each one bit of p, those that share p's lower bits and have a zero there; they lie 2**(u + 1) apart
    rank = F.expr(f"""aggregate(sequence(0, {max(bits - 1, 0)}), 0L, (n, u) -> n + if((shiftright(p, u) & 1L) = 1L,
        shiftright(hi - (p & (shiftleft(1L, u) - 1L)) + shiftleft(1L, u + 1) - 1L, u + 1) - shiftright(lo - (p & (shiftleft(1L, u) - 1L)) + shiftleft(1L, u + 1) - 1L, u + 1), 0L))""")
    slot = F.conv(F.reverse(F.lpad(F.bin("p"), max(bits, 1), "0")), 2, 10).cast("long")
    return points.select(slot.alias("slot"), "sid", rank.alias("rank"))


def _edge(k: str) -> str:
    """The first word of a source's block k; no product here reaches 2**63."""
    return f"({k} * (taken div slots) + ({k} * (taken % slots)) div slots)"


def schedule(mix: Mix, repeats: int = 2) -> DataFrame:
    """slot, source, doc_id, th, sid, bucket, rn (which tell a row apart), start (in the document, in words) and words: slot by slot, what the mix takes.
    Of slots of one number (a source too small for one of its own) the lesser sid comes first."""
    sources = mix.sources.where("taken > 0").select("sid", "source_size", "taken", "slots")
    twice = mix.placed.join(sources, "sid").withColumn("round", F.explode(F.array(*map(F.lit, range(repeats)))))
    span = twice.withColumn("a", F.col("round") * F.col("source_size") + F.col("at")).withColumn("e", F.least(F.col("a") + F.col("size"), F.col("taken"))).where("a < e")

    def block(x: str) -> Column:
        guess = f"least(slots - 1, cast(floor({x} * (cast(slots as double) / taken)) as bigint))"
        return F.expr(f"({guess}) + if({_edge(f'({guess} + 1)')} <= {x}, 1, 0) - if({_edge(f'({guess})')} > {x}, 1, 0)")

    met = span.withColumn("first", block("a")).withColumn("final", block("(e - 1)")).withColumn("rank", F.explode(F.sequence("first", "final")))
    met = met.withColumn("from", F.greatest("a", F.expr(_edge("rank")))).withColumn("to", F.least("e", F.expr(_edge("(rank + 1)"))))
    pieces = met.select("sid", "rank", "source", "doc_id", "th", "bucket", "rn", (F.col("from") - F.col("a")).alias("start"), (F.col("to") - F.col("from")).alias("words"))
    # both sides grow with the corpus, which their sizes ahead of the explosions don't show
    return slots(mix.sources, mix.bits).hint("merge").join(pieces, ["sid", "rank"]).select("slot", "source", "doc_id", "th", "sid", "bucket", "rn", "start", "words")


def taken_words(mix: Mix, repeats: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row."""
    own = mix.placed.select("doc_id", "source", "size", "sid", "bucket", "rn", F.lit(0).cast("long").alias("words"))
    took = schedule(mix, repeats).select("doc_id", "source", F.lit(0).cast("long").alias("size"), "sid", "bucket", "rn", "words")
    each = own.unionByName(took).groupBy("sid", "bucket", "rn", "doc_id", "source").agg(F.sum("size").alias("size"), F.sum("words").alias("taken"))
    every = each.select("doc_id", "source", "size", "taken").unionByName(mix.silent.select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    of = mix.sources.select(F.col("source").alias("_source"), "source_size", "target")
    return every.join(of, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    return taken_words(plan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))).select("doc_id", "size", "source_size", "target", "taken")
