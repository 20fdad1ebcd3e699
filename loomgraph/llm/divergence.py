"""How far the sources of a language use its terms differently, counted in DuckDB over shards of languages and terms.

Tasks count the terms of their documents in DuckDB and pass on one row per language and term. These are hashed by both into
shards; a shard's rows are sorted, so that it is worked off in chunks of whole terms, and DuckDB sums each chunk's counts and
drops rare terms. With the sources' totals joined to the counts, a second pass over shards sums, for each pair of sources, the
terms that both have, and picks the best terms of each source. Spark adds the shards' sums and ranks.

A term that a source lacks has the same share in it as all others that it lacks. So a pair's sum over all terms is made of the terms
that one of them has, by how many have which share (a small histogram of each source), the count of those that neither has,
and a correction for each term that both have: work follows the counts, not terms times pairs of sources.

All arithmetic is in whole numbers; products that outgrow 64 bits are made in 128. Shares are parts of 10**9 plus one, so no sum of a pair
reaches 2**63.

Defined results: null text, lang and source count as empty; equal rows each count as a document; a language or source without kept
terms takes part in pairs (value 0 where its language keeps none); ties go by the item's bytes; an empty table gives none; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, sliced, utf8

#: Rows of partial counts that a task gathers before it passes them on, and rows of a shard that are worked off at once (and what belongs to their last term).
FLUSH_ROWS, SHARD_ROWS = 1_000_000, 400_000
CHUNK_BYTES = 8 << 20
MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000

#: Letters A-Z become small; a-z and all bytes of other than ASCII characters stay; all else parts terms.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _database():
    """In memory, one thread, nothing on disk: chunks are bounded, so it has no need to spill."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "preserve_insertion_order": False})


def folded(text: pa.Array) -> pa.Array:
    """Texts whose terms stand between spaces."""
    raw, offsets = utf8(text)
    kind = pa.large_string() if offsets[-1] > 2**31 - 1 else pa.string()
    bounds = offsets.astype(np.int64 if kind == pa.large_string() else np.int32)
    return pa.Array.from_buffers(kind, len(text), [None, pa.py_buffer(bounds), pa.py_buffer(_FOLD[raw])])


def _out(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().to_batches(max_chunksize=20_000)


def count_documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, docs, sources and counts of the documents (lang, source, text); the empty term stands for the document itself."""
    con = _database()
    fresh = "CREATE OR REPLACE TABLE part (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)"
    con.execute(fresh)
    rows = 0
    flush = "SELECT lang, term, sum(docs)::BIGINT AS docs, list(source) AS sources, list(n) AS counts FROM (SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs) AS docs FROM part GROUP BY ALL) GROUP BY lang, term"
    for batch in sliced(batches, "text", CHUNK_BYTES):
        con.register("chunk", pa.table({"r": np.arange(batch.num_rows), "lang": batch.column("lang"), "source": batch.column("source"), "text": folded(batch.column("text"))}))
        con.execute("""INSERT INTO part SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM (
             SELECT any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(string_split(text, ' ')) AS term FROM chunk) WHERE term <> '' GROUP BY r, term) GROUP BY lang, source, term
             UNION ALL SELECT DISTINCT lang, source, '', 0, 0 FROM chunk""")
        rows = con.execute("SELECT count(*) FROM part").fetchall()[0][0]
        if rows >= FLUSH_ROWS:
            yield from _out(con, flush)
            con.execute(fresh)
            rows = 0
    if rows:
        yield from _out(con, flush)
    con.close()


def whole_terms(batches: Iterable[pa.RecordBatch], most: int = SHARD_ROWS) -> Iterator[pa.Table]:
    """Sorted rows in chunks of about `most` that no (lang, term) is split between."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        table = pa.Table.from_batches(held)
        last = pc.and_(pc.equal(table["lang"], table["lang"][-1]), pc.equal(table["term"], table["term"][-1]))
        cut = rows - pc.sum(last).as_py()
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows -= cut
    if rows:
        yield pa.Table.from_batches(held)


def shard_counts(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """lang, term, source, n, of_lang and first (once for each term) of the terms in enough documents, and of the empty one."""
    con = _database()
    for table in whole_terms(batches):
        con.register("part", table)
        yield from _out(con, f"""WITH kept AS (SELECT lang, term FROM part GROUP BY lang, term HAVING term = '' OR sum(docs) >= {int(min_docs)}),
             each AS (SELECT lang, term, source, sum(n)::BIGINT AS n FROM (SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM part SEMI JOIN kept USING (lang, term)) GROUP BY ALL)
             SELECT *, (sum(n) OVER w)::BIGINT AS of_lang, (row_number() OVER w = 1 AND term <> '')::BIGINT AS first FROM each WINDOW w AS (PARTITION BY lang, term ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
    con.close()


def shard_sums(batches: Iterable[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """part, lang, source, item, share and value: 'pair' has a pair's correction over the terms that both have, 'share' how many terms of a
    source have a share, 'term' the best terms of a source."""
    con = _database()
    con.execute("CREATE MACRO far(p, q) AS (p - q) * (p - q) // q")
    for table in whole_terms(batches):
        con.register("counted", table)
        con.execute(f"""CREATE OR REPLACE TABLE shares AS SELECT lang, term, source, 1 + CAST({UNIT}::HUGEINT * (n + 1) // (total + terms) AS BIGINT) AS p,
             1 + CAST({UNIT}::HUGEINT * (of_lang + 1) // (lang_total::HUGEINT + terms) AS BIGINT) AS q, 1 + {UNIT} // (total + terms) AS z FROM counted""")
        yield from _out(con, f"""SELECT 'pair' AS part, a.lang, a.source, b.source AS item, NULL::BIGINT AS share, sum(far(a.p, b.p) - far(a.p, b.z) - far(a.z, b.p) + far(a.z, b.z))::BIGINT AS value
              FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
             UNION ALL SELECT 'share', lang, source, NULL, p, count(*) FROM shares GROUP BY ALL
             UNION ALL SELECT 'term', lang, source, term, NULL, far(p, q) FROM shares WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY far(p, q) DESC, term) <= {int(top)}""")
    con.close()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, source, n, of_lang and first of the kept terms; a row with the empty term for each (lang, source)."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    part = plain.mapInArrow(count_documents, "lang string, term string, docs long, sources array<string>, counts array<long>")
    sharded = part.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return sharded.mapInArrow(lambda b: shard_counts(b, min_docs), "lang string, term string, source string, n long, of_lang long, first long")


def far(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, scratch: Scratch | None = None) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    counts = scratch.keep(term_counts(docs, min_docs), "counts")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(F.col("term") != "", 1)).alias("own"))
    groups = scratch.keep(groups.join(langs, "lang").withColumn("z", F.expr(f"1 + {UNIT} div greatest(total + terms, 1)")), "groups")
    counted = counts.where("term <> ''").join(groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"])
    sharded = counted.select("lang", "term", "source", "n", "of_lang", "total", "lang_total", "terms").repartition("lang", "term").sortWithinPartitions("lang", "term")
    sums = scratch.keep(sharded.mapInArrow(lambda b: shard_sums(b, top), "part string, lang string, source string, item string, share long, value long"), "sums")

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z2"), F.col("own").alias("own2"))
    neither = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"(terms - own - own2) * {far('z', 'z2')}").alias("value"))
    shares = sums.where("part = 'share'").groupBy("lang", "source", "share").agg(F.sum("value").alias("n"))
    way = lambda a, b, value: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.expr(value).alias("value"))
    either = shares.join(other, "lang").where("source <> item").select(
        "lang", F.explode(F.array(way("source", "item", f"n * {far('share', 'z2')}"), way("item", "source", f"n * {far('z2', 'share')}"))).alias("e")).select("lang", "e.*")
    both = sums.where("part = 'pair'").select("lang", "source", "item", "value")
    pairs = neither.unionByName(either).unionByName(both).groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38, 0)")).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = sums.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    row = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(pairs, "pair").unionByName(row(terms, "term"))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
 c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
 v AS (SELECT l.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
 g AS (SELECT x.lang, x.source, coalesce(any_value(total), 0) AS total, any_value(v) AS v FROM (SELECT DISTINCT lang, source FROM d) x JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY x.lang, x.source),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS BIGINT) AS p FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM c GROUP BY lang, term),
 pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(any_value(s.value), 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY a.lang, a.source, b.source),
 terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
 SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
 UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 200"""
