"""Distinctive words of files by term and document frequency."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import Words, line_at, line_of_offset, strip
from loomgraph.operators._store import large

TOP, FILES = 8, 80
#: Words that a task counts before it hands them on, and doc_ids of several files that all tasks get.
HELD, SHARED = 500_000, 100_000


def sizes(files: DataFrame) -> tuple[int, bool]:
    """The number of files, and whether each doc_id is one file's."""
    n, most = files.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return n, most <= 1


def _shared(files: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Files whose doc_id no other file has, and files that share theirs. Where very many doc_ids are shared, all files are taken for such."""
    ids = files.groupBy(F.col("doc_id").alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared").limit(SHARED + 1).toArrow()
    if not ids.num_rows:
        return files, None
    if ids.num_rows > SHARED:
        return None, files
    known, same = F.broadcast(files.sparkSession.createDataFrame(ids)), F.col("doc_id").eqNullSafe(F.col("shared"))
    return files.join(known, same, "left_anti"), files.join(known, same, "left_semi")


def term_counts(files: DataFrame, single: bool = False, words: list[str] | None = None) -> DataFrame:
    """doc_id, word and c, of all words or of the given ones. Words are counted where they are read; only rows of files that share a doc_id travel to be added
    up, none where each doc_id is one file's (single)."""
    alone, others = (files, None) if single else _shared(files)
    parts = [] if alone is None else [_rows(alone, words)]
    if others is not None:
        parts.append(_rows(others, words).groupBy("doc_id", "word").agg(F.sum("c").alias("c")))
    return reduce(DataFrame.unionByName, parts)


def _rows(files: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id, word and c of each file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(words)
        for batch in batches:
            found, sizes = [], []
            for text in batch.column("text").to_pylist():
                c = Counter(known.words(text))
                found.append(c)
                sizes.append(len(c))
            which = [i for i, n in enumerate(sizes) for _ in range(n)]
            values = pa.array(chain.from_iterable(c.values() for c in found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(chain.from_iterable(found), pa.string()), values], ["doc_id", "word", "c"])

    return _bytes(files).mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, word string, c long")


def document_counts(files: DataFrame, single: bool = False) -> DataFrame:
    """word and df, the number of doc_ids that have it. Tasks add up before anything travels, but for files that share a doc_id (none, where single)."""
    alone, others = (files, None) if single else _shared(files)
    parts = [] if alone is None else [_files_with(alone)]
    if others is not None:
        parts.append(_rows(others).select("doc_id", "word").distinct().groupBy("word").agg(F.count("*").alias("df")))
    return reduce(DataFrame.unionByName, parts).groupBy("word").agg(F.sum("df").alias("df"))


def _files_with(files: DataFrame) -> DataFrame:
    """word and df, the number of files that have it, in parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(set(known.words(text)))
                if len(held) >= HELD:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    return _bytes(files).mapInArrow(run, "word string, df long")


def _bytes(files: DataFrame) -> DataFrame:
    return files.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "df"])


def vocabulary(counts: DataFrame, n_files: int) -> DataFrame:
    """word and df of the words that may be keywords: neither rare nor in over two fifths of the files, at most 500 (a third of the files)."""
    if n_files < 3:
        return counts.where(F.lit(False))
    df = F.col("df")
    fit = counts.where((df >= (3 if n_files > 60 else 2)) & (df <= max(3, int(n_files * 0.4))))
    most = max(30, min(500, int(n_files / 3 + 0.5)))
    return fit.orderBy(F.desc(F.round(df * F.log(F.lit(float(n_files)) / df), 9)), "word").limit(most)


def top_words(files: DataFrame, n_files: int, single: bool = False, top: int = TOP) -> DataFrame:
    """doc_id, word, c and rn: the best words of each file; ties by word. The vocabulary, of at most 500 rows, is found first: the other words are then left where they are read."""
    known = _known(files, n_files, single)
    return _ranked(term_counts(files, single, known["word"].to_pylist()), known, top)


def _known(files: DataFrame, n_files: int, single: bool) -> pa.Table:
    """word and idf of the vocabulary."""
    return vocabulary(document_counts(files, single), n_files).select("word", F.log(F.lit(float(n_files)) / F.col("df")).alias("idf")).toArrow()


def _ranked(counts: DataFrame, known: pa.Table, top: int) -> DataFrame:
    chosen = counts.join(F.broadcast(counts.sparkSession.createDataFrame(known)), "word")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round(F.col("c") * F.col("idf"), 9)), "word"))
    return chosen.withColumn("rn", rank).where(F.col("rn") <= top).select("doc_id", "word", "c", "rn")


def mentions(files: DataFrame, words: DataFrame, most: int = FILES) -> DataFrame:
    """word, doc_id, line and snippet of the first hit, whatever its case, in each of a word's first files: at most 80 of each word of a vocabulary, which go to
    where the texts are read."""
    nth = F.row_number().over(Window.partitionBy("word").orderBy("doc_id"))
    asked = words.select("word", "doc_id").withColumn("nth", nth).where(F.col("nth") <= most)
    return _hits(files.select("doc_id", "text").join(F.broadcast(asked), "doc_id").withColumn("lower", F.lower("text")))


def all_mentions(files: DataFrame, n_files: int, single: bool = False, top: int = TOP) -> DataFrame:
    """As `mentions`, of each file's best words in that file, however many files a word has. Best words are found and met where texts are read; only texts of files
    that share a doc_id travel to theirs (none, where single)."""
    known = _known(files, n_files, single)
    alone, others = (files, None) if single else _shared(files)
    parts = [] if alone is None else [_with_best(alone, known, top)]
    if others is not None:
        counts = _rows(others, known["word"].to_pylist()).groupBy("doc_id", "word").agg(F.sum("c").alias("c"))
        best = _ranked(counts, known, top).groupBy("doc_id").agg(F.collect_list("word").alias("words"))
        parts.append(others.select("doc_id", "text").join(large(best), "doc_id"))
    each = reduce(DataFrame.unionByName, parts).where("doc_id is not null").select("doc_id", "text", F.lower("text").alias("lower"), "words")
    return _hits(each.select("doc_id", "text", "lower", F.explode("words").alias("word")))


def _with_best(files: DataFrame, known: pa.Table, top: int) -> DataFrame:
    """doc_id, text and words, the best ones of each file, by their own counts."""
    idf = dict(zip(known["word"].to_pylist(), known["idf"].to_pylist()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(list(idf))
        for batch in batches:
            counts = (Counter(words.words(text)) for text in batch.column("text").to_pylist())
            best = [[w for _, w in sorted((-round(c * idf[w], 9), w) for w, c in found.items())[:top]] for found in counts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(best, pa.list_(pa.string()))], ["doc_id", "text", "words"])

    made = _bytes(files).mapInArrow(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, text binary, words array<string>")
    return made.withColumn("text", F.col("text").cast("string"))


def _hits(asked: DataFrame) -> DataFrame:
    """word, doc_id, line and snippet of the first hit of each row's word in its text (lower: in lower case)."""
    found = asked.withColumn("at", F.expr("locate(word, lower)")).where("at > 0")
    line = line_of_offset(F.col("text"), F.col("at"))
    text = F.regexp_replace(F.coalesce(F.get(F.split("text", "\n"), line), F.lit("")), "\r$", "")
    return found.select("word", "doc_id", line.alias("line"), F.substr(strip(text), F.lit(1), F.lit(140)).alias("snippet"))
