"""Where a definition's body ends, by indentation, and which definition stands around another: nearest smaller values by windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators._store import cut

# Fixed patterns: lines that don't end a body at its own depth, by language group.
_LABELS = r"^(?:[A-Za-z_$][\w$]*:(?!:)\s*$|case\b|default\s*:)"
_DIRECTIVES = r"^(?:#|[A-Za-z_]\w*:(?!:)\s*$|case\b|default\s*:)"
SKIPPED = {"c": _DIRECTIVES, "cs": _DIRECTIVES, **dict.fromkeys(("go", "js", "jvm", "rs", "swift", "dart", "php"), _LABELS), "rb": r"^(?:rescue|ensure|elsif|when|else)\b"}
#: Columns that a tab counts for.
TAB = 4


def lines_of(files: DataFrame) -> DataFrame:
    """file, grp, line (from 0) and text of the lines of files (file, grp, text); a null text has none."""
    return files.select("file", "grp", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def depth(text: Column) -> Column:
    """The width of a line's leading blanks and tabs."""
    lead = F.regexp_extract(text, r"^[ \t]*", 0)
    return F.length(lead) + (TAB - 1) * F.length(F.regexp_replace(lead, " ", ""))


def next_at_most(data: DataFrame, asked: DataFrame) -> DataFrame:
    """grp, pos, value and load of each asked row (grp, pos, value): the load (a struct whose first field is the row's pos) of the first data row
    (grp, pos, value, load) of its group after its pos whose value is not above its own; null if there is none. Values are whole and not negative.

    A value is not above another if it is equal to it, or agrees with it down to a bit that it lacks and the other has. So each row stands once for each bit
    in a group of those that agree that far, and in each such group the next row in order is the nearest: no pairs, and no sequential scan."""
    high = data.agg(F.max("value")).unionAll(asked.agg(F.max("value"))).agg(F.max("max(value)")).first()[0] or 0
    bits = max(int(high), 1).bit_length()
    same = "struct(-1 as bit, value as head)"

    def keyed(df, has, head, load, ask):
        other = F.expr(f"transform(filter(sequence(0, {bits - 1}), u -> shiftright(value, u) % 2 = {has}), u -> struct(u as bit, {head} as head))")
        at = F.explode(F.concat(F.expr(f"array({same})"), other)).alias("at")
        return df.select("grp", "pos", "value", load.alias("load"), F.lit(ask).alias("ask"), at).select("grp", "pos", "value", "load", "ask", "at.bit", "at.head")

    kind = data.schema["load"].dataType
    both = keyed(data.withColumn("value", F.col("value").cast("long")), 0, "shiftright(value, u)", F.col("load"), 0).unionByName(
        keyed(asked.withColumn("value", F.col("value").cast("long")), 1, "shiftright(value, u) - 1", F.lit(None).cast(kind), 1))
    after = Window.partitionBy("grp", "bit", "head").orderBy(F.desc("pos"), F.desc("ask")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("load", True).over(after)).where("ask = 1")
    return near.groupBy("grp", "pos", "value").agg(F.min("near").alias("load"))


def block_ends(lines: DataFrame, defs: DataFrame) -> DataFrame:
    """file, line and end of each definition line (defs: file, line; blank ones have none) among lines (file, grp, line, text).

    A body goes on over blank lines, deeper lines and, at the definition's own depth, lines that its group skips, closing lines that open again, and a
    brace that comes first. It ends before any other line that is not deeper, or with it if that closes (a bracket, or `end`) at the same depth.
    Skipped lines at that depth don't belong to it if nothing follows them."""
    text = F.col("text")
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    skip = F.lit(False)
    for g, p in SKIPPED.items():
        skip = skip | ((F.col("grp") == g) & F.col("bare").rlike(p))
    full = lines.select("file", "grp", "line", bare.alias("bare"), depth(text).alias("depth")).where("bare <> ''").withColumn("skip", F.coalesce(skip, F.lit(False)))
    brace, closes = F.col("bare").startswith("{") & ~F.col("skip"), F.col("bare").rlike(r"^[})\]]") & ~F.col("skip")
    opens, word = F.col("bare").rlike(r"(?:[{(\[:]|=>)$"), F.col("bare").rlike(r"^end\b") & ~F.col("skip")
    full = full.select("file", "line", "depth", "skip", brace.alias("brace"), (closes | word).alias("shuts"), (~F.col("skip") & ~(closes & opens)).alias("hard"))
    # a line above all others ends every body that is still open
    final = full.groupBy("file").agg((F.max("line") + 1).alias("line")).select("file", "line", F.lit(-1).alias("depth"), F.lit(False).alias("skip"), F.lit(False).alias("brace"), F.lit(False).alias("shuts"), F.lit(True).alias("hard"))
    by_line, level = Window.partitionBy("file").orderBy("line"), Window.partitionBy("file", "depth")
    numbered = full.unionByName(final).withColumn("nth", F.row_number().over(by_line)).withColumn("here", F.row_number().over(level.orderBy("line")))
    # runs of neighbouring skipped lines of one depth: the line ahead of a run
    ran = numbered.withColumn("run", F.when(F.col("skip"), F.col("nth") - F.row_number().over(Window.partitionBy("file", "depth", "skip").orderBy("line"))))
    ran = ran.withColumn("ahead", F.lag("line").over(by_line))
    ran = ran.withColumn("solid", F.when(F.col("skip"), F.first("ahead").over(Window.partitionBy("file", "depth", "skip", "run").orderBy("line"))).otherwise(F.col("line")))
    # what a body that ends at a line has for its last line: the one ahead of it, or ahead of the skipped ones there if they are of its own depth
    ran = cut(ran.select("file", "line", "depth", "skip", "brace", "shuts", "hard", "nth", "here", F.lag("line").over(by_line).alias("last"), F.lag("depth").over(by_line).alias("last_depth"), F.lag("solid").over(by_line).alias("last_solid")))
    later = level.orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    stop = F.struct("line", "depth", "shuts", "last", "last_depth", "last_solid")
    same = ran.withColumn("next_hard", F.last(F.when(F.col("hard"), stop), True).over(later))
    same = same.withColumn("next_full", F.last(F.when(~F.col("skip"), F.struct("nth", "here", "brace", "next_hard")), True).over(later))
    first_brace = F.coalesce(F.col("next_full.brace") & (F.col("next_full.nth") - F.col("nth") == F.col("next_full.here") - F.col("here")), F.lit(False))
    asked = same.where("depth >= 0").join(defs.select("file", "line").distinct(), ["file", "line"]).select("file", "line", "depth", F.when(first_brace, F.col("next_full.next_hard")).otherwise(F.col("next_hard")).alias("equal"))
    asked = cut(asked)
    # less deep: the nearest line of a lesser depth; depths count from 1 here, the final line from 0
    lesser = next_at_most(ran.select(F.col("file").alias("grp"), F.col("line").alias("pos"), (F.col("depth") + 1).alias("value"), stop.alias("load")), asked.select(F.col("file").alias("grp"), F.col("line").alias("pos"), F.col("depth").alias("value")))
    met = asked.join(lesser.select(F.col("grp").alias("file"), F.col("pos").alias("line"), F.col("load").alias("less")), ["file", "line"]).withColumn("stop", F.least("equal", "less"))
    last = F.when((F.col("stop.depth") == F.col("depth")) & F.col("stop.shuts"), F.col("stop.line")).when(F.col("stop.last_depth") == F.col("depth"), F.col("stop.last_solid")).otherwise(F.col("stop.last"))
    return met.select("file", "line", F.greatest("line", last).cast("int").alias("end"))


def enclosing(spans: DataFrame) -> DataFrame:
    """file, nth and up of each definition (spans: file, nth (its order), line, end): the nearest one before it that reaches its line; null if there is none."""
    top = spans.agg(F.max("end")).first()[0] or 0
    data = spans.select(F.col("file").alias("grp"), (-F.col("nth")).alias("pos"), (F.lit(top) - F.col("end")).alias("value"), F.struct((-F.col("nth")).alias("pos")).alias("load"))
    asked = spans.select(F.col("file").alias("grp"), (-F.col("nth")).alias("pos"), (F.lit(top) - F.col("line")).alias("value"))
    return next_at_most(data, asked).select(F.col("grp").alias("file"), (-F.col("pos")).alias("nth"), (-F.col("load.pos")).alias("up"))
