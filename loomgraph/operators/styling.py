"""Numbers of a drawn neighbourhood: radii, alphas, springs, rings, boxes and nearest nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.views import DEP, REF

# Base radii, in order of the kinds' palette places; shapes.
RADII = {"dir": 5.2, "file": 4.6, "lib": 4.0, "class": 4.2, "type": 3.6, "module": 4.0, "function": 3.3, "method": 3.0, "variable": 2.7, "keyword": 4.0}
SHAPES = {"file": 1, "dir": 1, "lib": 2, "keyword": 3}
SPACE, MIN_SCALE, MAX_SCALE, PAD = 34, 0.03, 2.5, 50


def _table(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def node_style(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """key, radius, shape and palette of each node with a degree."""
    radius = F.coalesce(F.try_element_at(_table(RADII), F.col("kind")), F.lit(3.3)) + F.least(F.lit(5.0), 0.8 * F.log2(1 + F.col("deg")))
    shape = F.coalesce(F.try_element_at(_table(SHAPES), F.col("kind")), F.lit(0))
    place = F.coalesce(F.try_element_at(_table({k: n for n, k in enumerate(RADII)}), F.col("kind")), F.lit(6))
    return nodes.select("key", "kind").join(degrees, "key").select("key", F.round(radius, 6).alias("radius"), shape.alias("shape"), place.alias("palette"))


def edge_style(edges: DataFrame, depths: DataFrame, selected: str) -> DataFrame:
    """s, t, alpha, width and hot of edges between nodes with depths."""
    d = lambda c: depths.select(F.col("key").alias(c), F.col("depth").alias(f"d_{c}"))
    far = F.greatest("d_s", "d_t")
    alpha = F.when(F.col("type") == DEP, 0.34).when(F.col("type") == REF, 0.3).otherwise(0.2) * F.greatest(F.lit(0.35), 1 - 0.13 * F.greatest(F.lit(0), far - 1))
    hot = (F.col("s") == selected) | (F.col("t") == selected)
    return edges.join(d("s"), "s").join(d("t"), "t").select(
        "s", "t", F.round(F.when(hot, F.least(F.lit(0.95), alpha * 2.6 + 0.15)).otherwise(alpha), 6).alias("alpha"), F.when(hot, 1.8).otherwise(1.1).alias("width"), hot.alias("hot"))


def springs(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """s, t, strength, bias and length by the degrees within the neighbourhood."""
    d = lambda c: degrees.select(F.col("key").alias(c), F.col("deg").alias(f"d_{c}"))
    least = F.least("d_s", "d_t")
    return edges.join(d("s"), "s").join(d("t"), "t").select(
        "s", "t", F.round(1 / least, 6).alias("strength"), F.round(F.col("d_s") / (F.col("d_s") + F.col("d_t")), 6).alias("bias"), F.round(50 + 5 * F.sqrt(least), 6).alias("length"))


def ring_radii(depths: DataFrame) -> DataFrame:
    """depth, inner and outer; a row per depth, so the fold is over a few numbers."""
    counts = depths.where("depth > 0").groupBy("depth").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.struct("depth", "n")))
    none = F.array().cast("array<struct<depth:int,inner:double,outer:double>>")

    def step(out, x):
        before = F.when(F.size(out) > 0, F.element_at(out, -1)["outer"]).otherwise(F.lit(0.0))
        inner = before + F.when(x["depth"] == 1, 30.0).otherwise(24.0)
        outer = F.greatest(inner + 90, F.sqrt(inner * inner + x["n"] * SPACE * SPACE / F.lit(3.141592653589793)))
        return F.concat(out, F.array(F.struct(x["depth"].alias("depth"), inner.alias("inner"), outer.alias("outer"))))

    rings = counts.agg(F.aggregate(each, none, step).alias("rings")).select(F.inline("rings"))
    return rings.select("depth", F.round("inner", 4).alias("inner"), F.round("outer", 4).alias("outer"))


def fit_box(points: DataFrame, width: float, height: float) -> DataFrame:
    """cx, cy and scale that show all points (x, y)."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scale = F.least((width - 2 * PAD) / F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), (height - 2 * PAD) / F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")))
    return box.select(((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.round(F.greatest(F.lit(MIN_SCALE), F.least(scale, F.lit(MAX_SCALE))), 6).alias("scale"))


def to_screen(points: DataFrame, cam_x: float, cam_y: float, scale: float, width: float, height: float) -> DataFrame:
    """key, sx and sy: where a camera shows the points (key, x, y)."""
    at = lambda c, cam, size: ((F.col(c) - cam) * scale + size / 2).alias(f"s{c}")
    return points.select("key", at("x", cam_x, width), at("y", cam_y, height))


def clamped_zoom(scale: Column, factor: Column) -> Column:
    """The scale after a zoom, from 0.03 to 8."""
    return F.greatest(F.lit(0.03), F.least(F.lit(8.0), scale * factor))


def nearest(points: DataFrame, x: float, y: float, most: float) -> DataFrame:
    """key of the nearest point within `most`; ties by key."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.select("key", d.alias("d")).where(F.col("d") <= most).agg(F.min(F.struct("d", "key")).alias("m")).select(F.col("m.key").alias("key"))


def directional(points: DataFrame, x: float, y: float, dx: float, dy: float) -> DataFrame:
    """key of the best point in a direction: within 60 degrees, near and straight ahead; ties by key."""
    vx, vy = F.col("x") - x, F.col("y") - y
    some = points.select("key", F.hypot(vx, vy).alias("d"), (vx * dx + vy * dy).alias("dot")).where("d > 0").withColumn("cos", F.col("dot") / F.col("d"))
    return some.where("cos >= 0.5").agg(F.min(F.struct(F.round(F.col("d") * (1.7 - F.col("cos")), 9), "key")).alias("m")).select(F.col("m.key").alias("key"))


def label_order(styles: DataFrame, depths: DataFrame, width: float, height: float) -> DataFrame:
    """key and rn of the nodes that get labels: by depth, then the larger; as many as the window bears."""
    from pyspark.sql import Window

    most = int(max(60, min(220, width * height / 4000)))
    order = ("depth", F.desc("radius"), "key")
    best = styles.join(depths.select("key", "depth"), "key").orderBy(*order).limit(most)
    return best.select("key", F.row_number().over(Window.orderBy(*order)).alias("rn"))
