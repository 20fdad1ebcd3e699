"""N-gram Jaccard self-join of documents: pairs of texts whose sets of word 5-grams have a similarity of at least 0.8.

Words are runs of anything but ASCII white space, as they stand; a text of fewer than five words has one n-gram, all of
its words. Texts with equal sets are copies and form a class before anything is compared; sets are compared as sorted
64-bit n-gram hashes, and classes are told apart by a 64-bit hash of the whole set.

Defined results: null, empty and wordless texts have no n-grams, link to nothing and are alone; repeated rows are copies;
a row with a null doc_id takes part, and is never chosen where another row of its group has an id; an empty table gives
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import _near
from loomgraph.llm._base import Scratch, carried, docs_view, restored, sliced, utf8
from loomgraph.llm._words import mix, ngram_hashes, spans, window_hashes

N, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.999, 4


def grams_of_column(text: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram hashes without repeats of each text of a column without nulls, end to end, and the n + 1 offsets."""
    raw, offsets = utf8(text)
    starts, ends, first = spans(raw, offsets)
    words = window_hashes(raw, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = ngram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngram_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    size = np.array([len(x) for x in out])
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.append(0, np.cumsum(size))


def grams_of_texts(text: pa.Array, n: int = N) -> list[np.ndarray]:
    elements, offsets = grams_of_column(text, n)
    return np.split(elements, offsets[1:-1])


def grams_of(text: str) -> np.ndarray:
    return grams_of_column(pa.array([text]))[0]


def minhashes(elements: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """n x count; sets must not be empty."""
    out = np.empty((len(offsets) - 1, count), np.uint64)
    for k in range(count):
        seed = mix(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        out[:, k] = np.minimum.reduceat(elements * seed, offsets[:-1])
    return out


def signatures(view: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th, cid (null: no n-grams), n and bands of each row."""
    def run(batches):
        for batch in sliced(batches):
            elements, offsets = grams_of_column(batch.column(1), n)
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            cid = np.zeros(len(size), np.int64)
            made = np.zeros((len(size), bands), np.int64)
            if len(full):
                for k in full.tolist():
                    cid[k] = xxhash.xxh3_64_intdigest(elements[offsets[k] : offsets[k + 1]].tobytes()) - (1 << 63)
                made[full] = _near.band_hashes(minhashes(elements, np.append(offsets[:-1][full], len(elements)), bands * rows), bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cid, mask=size == 0), pa.array(size), lists], names=["doc_id", "th", "cid", "n", "bands"])

    kind = view.schema["doc_id"].dataType.simpleString()
    return view.mapInArrow(run, f"doc_id {kind}, th long, cid long, n long, bands array<long>")


def ngram_classes(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, scratch: Scratch | None = None, **cells) -> DataFrame:
    """doc_id, th, root, class_id, n_links and n_text_links of each row.

    root tells the groups of linked texts and their copies apart (null: no n-grams). class_id is the least doc_id of the
    row's group (null only if no row of it has an id), which unlike groups may share; n_text_links counts the different texts that it is similar to, n_links the other rows, copies among them."""
    bands = _near.choose_bands(similarity, recall, rows)
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    view = docs_view(docs).withColumn("_key", F.struct("doc_id", "th"))
    signed = scratch.keep(signatures(view, n, bands, rows), "signatures")
    # copies are put together first: a class has one row, whatever its number of copies
    one = scratch.keep(signed.where("cid is not null").groupBy("cid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "th")).alias("of")), "classes-of-copies")
    found = _near.candidates(_near.combine(one.select(F.explode("bands").alias("band"), "cid")), scratch)
    wanted = scratch.keep(_near.with_blocks(one.join(found, "cid").select("cid", "comp", "n", "copies", "of"), **cells), "wanted")
    members = _near.sieved(view, wanted.select("of.th")).join(wanted, F.col("_key") == wanted["of"]).select("cid", "comp", "blocks", "copies", "text")
    linked = _near.classes(_near.in_cells(members, lambda t: grams_of_texts(t, n), similarity), scratch)
    named = one.join(linked, "cid", "left").select("cid", "copies", "rep", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("weighted", F.lit(0)).alias("weighted"))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "root").select(F.col("cid").alias("_cid"), "root", "class_id", F.col("links").alias("n_text_links"), (F.col("weighted") + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", "th", "cid").join(named, F.col("cid") == F.col("_cid"), "left")
    return out.select("doc_id", "th", "root", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"), F.col("cid").isNull().alias("alone"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each group of linked texts and their copies: the row with its least doc_id, and among several
    such rows the one with the least text hash. Rows without n-grams all stay."""
    judged = ngram_classes(docs, **how)
    key = F.struct("doc_id", "th").alias("_kept")
    chosen = judged.where("not alone").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("k"))
    stay = chosen.select(F.struct("k.doc_id", "k.th").alias("_kept"), F.lit(False).alias("_alone")).unionByName(judged.where("alone").select(key, F.lit(True).alias("_alone")).distinct())
    keyed = carried(docs).withColumn("_key", F.struct("doc_id", "th"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))  # equal rows: only one of them
    return restored(keyed.join(stay, keyed["_key"] == stay["_kept"]).withColumn("_nth", nth).where("_alone or _nth = 1"), docs)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_classes(docs).select("doc_id", "root", "class_id", "n_links", "n_text_links")
