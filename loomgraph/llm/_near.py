"""Near-duplicate search shared by lines and documents: MinHash bands, candidate components, exact verification.

1. `choose_bands` picks the number of bands for a wanted recall at the similarity limit.
2. Members of a band bucket are chained to a neighbour in the bucket, not paired; connected components of these links
   hold every candidate pair.
3. The texts of a component are dealt to cells of bounded size (a component too large for one cell is cut into blocks,
   and every pair of blocks meets in one cell), and all pairs of a cell are verified on their full sets with an inverted
   index. No pair leaves the cell: only the number of links of each member, and a spanning forest of them.
4. Components of the forests are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch, runs
from loomgraph.llm._words import mix
from loomgraph.llm.components import components

#: A block of a cell holds about so many members and so many set elements at most; a single larger member is alone.
BLOCK_MEMBERS, BLOCK_ELEMENTS = 1024, 400_000
#: A pair of equal elements costs in the index as much as so many multiplications in a matrix product.
DENSE = 100
#: Fewer pairs go to the index at once.
MANY_PAIRS = 10_000
#: Cells of at most SMALL members are verified together, up to about POOL members or POOL_BYTES bytes.
SMALL, POOL, POOL_BYTES = 16, 2048, 4 << 20
#: Text hashes that are broadcast at most, to sieve rows ahead of a shuffle.
MOST_SIEVED = 500_000


def choose_bands(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of `rows` MinHashes that find a pair of the given similarity with at least the given probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands from n x (bands * rows) MinHashes; equal only in the same band."""
    out = np.empty((len(signature), bands), np.int64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, b * rows + r])
        out[:, b] = h.view(np.int64)
    return out


#: What `combined` makes.
SENT = "key long, cid long, to long"


def combined(band: np.ndarray, cid: np.ndarray) -> pa.RecordBatch:
    """A batch's own members of a bucket linked before the shuffle, and one of them to send on: so a bucket that very many
    rows share sends a row per batch."""
    order = np.lexsort((cid, band))
    band, cid = band[order], cid[order]
    same = np.append(False, band[1:] == band[:-1])
    linked = np.flatnonzero(same & np.append(False, cid[1:] != cid[:-1]))
    key, one = np.append(band[~same], cid[linked]), np.append(cid[~same], cid[linked])
    to = pa.array(np.append(np.zeros((~same).sum(), np.int64), cid[linked - 1]), mask=np.arange(len(key)) < (~same).sum())
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(one), to], names=["key", "cid", "to"])


def combine(bands: DataFrame) -> DataFrame:
    """`combined` batches of band and cid (longs)."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield combined(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    return bands.select("band", "cid").mapInArrow(run, SENT)


def chain(sent: DataFrame) -> DataFrame:
    """Edges u, v that connect all members of each bucket, from `combined` batches: the rows of a bucket stream by in order,
    and neighbours are linked."""
    def run(batches):
        last = None
        for batch in batches:
            made = batch.filter(batch.column(2).is_valid())
            if made.num_rows:
                yield pa.RecordBatch.from_arrays([made.column(1), made.column(2)], names=["u", "v"])
            batch = batch.filter(batch.column(2).is_null())
            if not batch.num_rows:
                continue
            band, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                band, cid = np.append(last[0], band), np.append(last[1], cid)
            same = (band[1:] == band[:-1]) & (cid[1:] != cid[:-1])
            last = band[-1:], cid[-1:]
            if same.any():
                yield pa.RecordBatch.from_arrays([pa.array(cid[1:][same]), pa.array(cid[:-1][same])], names=["u", "v"])

    return sent.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(run, "u long, v long")


def verify(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with Jaccard similarity of at least `similarity`: left with right, or pairs i < j of left if right is None.
    Sets are sorted arrays without repeats. An index of one side's elements gives the sizes of all intersections of a set; where
    very many pairs share elements, products of 0/1 matrices do so in less time."""
    others = left if right is None else right
    sizes = np.array([len(x) for x in others])
    if len(left) * len(others) >= MANY_PAIRS and (shared := products(left, right)) is not None:
        mine = sizes if right is None else np.array([len(x) for x in left])
        i, j = np.nonzero(shared * (1 + similarity) + 1e-9 >= similarity * (mine[:, None] + sizes))
        good = (shared[i, j] > 0) & ((i < j) if right is None else True)
        return i[good], j[good]
    flat = np.concatenate(others) if others else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    keys, owner = flat[order], np.repeat(np.arange(len(others)), sizes)[order]
    one, two = [], []
    for i, x in enumerate(left):
        a, b = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
        n = b - a
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(others))
        # |A and B| >= s |A or B|, with room for rounding: exact on whole numbers
        good = np.flatnonzero(shared * (1 + similarity) + 1e-9 >= similarity * (len(x) + sizes))
        good = good[good > i] if right is None else good
        one.append(np.full(len(good), i))
        two.append(good)
    z = np.zeros(0, np.int64)
    return (np.concatenate(one), np.concatenate(two)) if one else (z, z)


def verify_small(sets: list[np.ndarray], cell: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """`verify` within each of many small cells at once; cell: each set's, ascending. Every two sets of a cell that share an element are
    counted once per element."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.lexsort((flat, cell[owner]))  # stable: owners ascend among equal elements of a cell
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, (flat[1:] != flat[:-1]) | (cell[owner[1:]] != cell[owner[:-1]]))[: len(flat)]
    begin = np.flatnonzero(fresh)
    earlier = np.arange(len(flat)) - np.repeat(begin, np.diff(np.append(begin, len(flat))))
    first = np.repeat(np.arange(len(flat)) - earlier - np.append(0, np.cumsum(earlier)[:-1])[: len(flat)], earlier) + np.arange(int(earlier.sum()))
    pair = np.sort(owner[first] * n + np.repeat(owner, earlier))
    edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    shared, pair = np.diff(np.append(edge, len(pair))), pair[edge]
    one, two = pair // n, pair % n
    good = shared * (1 + similarity) + 1e-9 >= similarity * (sizes[one] + sizes[two])
    return one[good], two[good]


def products(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray | None:
    """The sizes of all intersections of left with right (None: with left), by matrix products over a few columns at a time (below 2**24
    float32 is exact); None where an index takes less work, or more than BLOCK_MEMBERS squared pairs meet."""
    n, m = len(left), len(left if right is None else right)
    if n * m > BLOCK_MEMBERS**2:
        return None
    sets = left if right is None else [*left, *right]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    times = np.diff(np.append(np.flatnonzero(fresh), len(flat)))
    again = np.repeat(times > 1, times)  # elements of a single set are in no intersection
    column, owner = np.cumsum(fresh[again]) - 1, owner[again]
    total = int((times > 1).sum())
    if total * n * m > DENSE * float((times.astype(float) ** 2).sum()):
        return None
    out, width = np.zeros((n, m), np.float32), max(64, (1 << 21) // max(n, m))
    for k in range(0, total, width):
        a, b = np.searchsorted(column, (k, k + width))
        bits = np.zeros((len(sets), min(width, total - k)), np.float32)
        bits[owner[a:b], column[a:b] - k] = 1
        out += bits[:n] @ (bits if right is None else bits[n:]).T
    return out.astype(float)


def forest(n: int, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the components of n vertices."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in range(0, len(one), 20_000):  # pairs that are together already go as arrays
        root, a, b = np.array([find(x) for x in range(n)]), one[k : k + 20_000], two[k : k + 20_000]
        apart = root[a] != root[b]
        for a, b in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def sieved(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of view whose th is among the wanted ones, so that no others travel to the join that follows; with over MOST_SIEVED of them
    all rows, among which that join tells."""
    if wanted.count() > MOST_SIEVED:
        return view
    return view.join(F.broadcast(wanted.select("th").distinct()), "th", "left_semi")


def with_blocks(members: DataFrame, block_members: int = BLOCK_MEMBERS, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """Adds to members (cid, comp, n: set size, any more columns) the number of blocks that their component is cut into."""
    size = members.groupBy(F.col("comp").alias("_comp")).agg(F.count("*").alias("_members"), F.sum("n").alias("_elements"))
    blocks = F.greatest(F.ceil(F.col("_members") / block_members), F.ceil(F.col("_elements") / block_elements)).cast("int")
    return members.join(size, F.col("comp") == F.col("_comp")).withColumn("blocks", blocks).drop("_comp", "_members", "_elements")


def in_cells(members: DataFrame, make: Callable[[pa.Array], list[np.ndarray]], similarity: float) -> DataFrame:
    """u, v, links, weighted for members (cid, comp, blocks, copies, text): a row (cid, null, links, weighted) with the number
    of classes linked in a cell, and of their copies, and a row (u, v, 0, 0) per edge of the cell's spanning forest."""
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    cells = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("block"), "cid", "copies", "text")

    def alone(cell):
        x, y = cell.column("x")[0].as_py(), cell.column("y")[0].as_py()
        once = np.unique(cell.column("cid").to_numpy(), return_index=True)[1]  # a repeated row gives its text twice
        cell = cell.take(pa.array(once))
        sets = make(cell.column("text").combine_chunks())
        if x == y:
            return cell, *verify(sets, None, similarity)
        mine = cell.column("block").to_numpy() == x
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        one, two = verify([sets[k] for k in a], [sets[k] for k in b], similarity)
        return cell, a[one], b[two]

    def together(cells):
        number = np.repeat(np.arange(len(cells)), [c.num_rows for c in cells])
        pool = pa.concat_tables(cells)
        cid = pool.column("cid").to_numpy()
        order = np.lexsort((cid, number))
        order = order[np.append(True, (np.diff(cid[order]) != 0) | (np.diff(number[order]) != 0))]
        pool = pool.take(pa.array(order))
        return pool, *verify_small(make(pool.column("text").combine_chunks()), number[order], similarity)

    def answer(cell, one, two):
        cid, copies = cell.column("cid").to_numpy(), cell.column("copies").to_numpy()
        n = len(cid)
        links = np.bincount(one, minlength=n) + np.bincount(two, minlength=n)
        weighted = np.bincount(one, copies[two], n).astype(np.int64) + np.bincount(two, copies[one], n).astype(np.int64)
        some = np.flatnonzero(links)
        tree = forest(n, one, two)
        u = np.append(cid[some], [cid[a] for a, _ in tree])
        return pa.RecordBatch.from_arrays(
            [pa.array(u.astype(np.int64)), pa.array([None] * len(some) + [int(cid[b]) for _, b in tree], pa.int64()), pa.array(np.append(links[some], np.zeros(len(tree), np.int64))), pa.array(np.append(weighted[some], np.zeros(len(tree), np.int64)))],
            names=["u", "v", "links", "weighted"])

    def run(batches):
        held, size = [], 0
        for cell in runs(batches, ["comp", "x", "y"]):
            if cell.num_rows < 2:
                continue
            if cell.num_rows <= SMALL and cell.column("x")[0] == cell.column("y")[0]:
                held.append(cell)
                size += max(cell.num_rows, cell.nbytes * POOL // POOL_BYTES)
                if size >= POOL:
                    yield answer(*together(held))
                    held, size = [], 0
            else:
                yield answer(*alone(cell))
        if held:
            yield answer(*together(held))

    keys = ["comp", "x", "y"]
    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long, links long, weighted long")


def candidates(sent: DataFrame, scratch: Scratch) -> DataFrame:
    """cid and comp of every member that shares a bucket with another one; sent: `combined` batches."""
    return scratch.keep(components(chain(sent), scratch, "candidates").select(F.col("id").alias("cid"), F.col("root").alias("comp")), "candidates")


def classes(verified: DataFrame, scratch: Scratch) -> DataFrame:
    """cid, root, links and weighted of every member with a verified link."""
    verified = scratch.keep(verified, "verified")
    roots = components(verified.where("v is not null").select("u", "v"), scratch, "classes")
    links = verified.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"), F.sum("weighted").alias("weighted"))
    return scratch.keep(links.join(roots, links["cid"] == roots["id"]).select("cid", "root", "links", "weighted"), "classes")
