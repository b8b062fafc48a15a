"""Fenced blocks of line-wise texts as a finite-state fold that is cut into segments.

A line that may open or close a block is a *mark*: size (0 or more), closes (it may end a block of at most its size) and opens (the kind of block that it
begins outside of any, null: none). What a segment does to any state it is entered with is a short list, so segments are folded by themselves,
their lists are chained for each text, and only then are the lines told where they stand: no task holds more than a segment's marks, however long
a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of a segment.
SEGMENT = 4096
#: Fixed value: what a fence of claims says after its backticks.
CLAIMS = "atlas:claims"

_STATE = "struct<size:int,kind:string,since:int>"
_OUTSIDE = "named_struct('size', -1, 'kind', cast(null as string), 'since', cast(null as int))"


def mark(size: Column, closes: Column, opens: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), closes.alias("closes"), opens.cast("string").alias("opens"))


def toggles(text: Column) -> Column:
    """Three backticks or tildes, whatever follows: each changes inside to outside and back."""
    return F.when(text.rlike(r"(?U)^\s*(```|~~~)"), mark(F.lit(1), F.lit(True), F.lit("code")))


def nested(text: Column) -> Column:
    """Three or more backticks: a block ends at a bare fence at least as long as the one that began it; blocks of claims say so."""
    ticks, info = (F.regexp_extract(text, r"(?U)^\s*(`{3,})\s*(.*?)\s*$", i) for i in (1, 2))
    return F.when(ticks != "", mark(F.length(ticks), info == "", F.when(info == CLAIMS, "claims").otherwise("code")))


def generated(text: Column) -> Column:
    """Only a fence of claims begins a block; any line of three backticks ends it."""
    info = F.regexp_extract(text, r"(?U)^\s*```\s*(.*?)\s*$", 1)
    return F.when(text.rlike(r"(?U)^\s*```"), mark(F.lit(1), F.lit(True), F.when(info == CLAIMS, "claims")))


def _step(state: Column, m: Column) -> Column:
    inside = state["kind"].isNotNull()
    opened = F.struct(m["size"].alias("size"), m["opens"].alias("kind"), m["line"].alias("since"))
    return F.when(inside & m["closes"] & (m["size"] >= state["size"]), F.expr(_OUTSIDE)).when(~inside & m["opens"].isNotNull(), opened).otherwise(state)


def _enter(state: Column, exits: Column) -> Column:
    """The state after a segment that is entered with ``state``: the first exit for at least its size; blocks longer than any go on."""
    fit = F.filter(exits, lambda e: e["upto"] >= state["size"])
    return F.when(F.size(fit) > 0, fit[0]["exit"]).otherwise(state)


def blocks(lines: DataFrame, marks: Column, segment: int = SEGMENT) -> DataFrame:
    """lines (source, line from 1, ...) with role (open, close or text), block (kind, null: outside) and since (the line that began it).

    ``marks`` gives a mark or null for each line. A line that begins or ends a block is in it. Lines must be unique in their source; a null
    source is a text like any other; no lines give no rows.
    """
    held = lines.select("source", F.col("line").cast("int").alias("_at"), F.floor((F.col("line") - 1) / segment).alias("_seg"), F.struct("*").alias("_row"), marks.alias("_mark"))
    given = F.struct(F.col("_at").alias("line"), "_mark.size", "_mark.closes", "_mark.opens")
    # segments without marks have an empty list
    own = held.groupBy("source", "_seg").agg(F.array_sort(F.collect_list(F.when(F.col("_mark").isNotNull(), given))).alias("m"))
    # a state that is entered from above differs only by the size that ends it: none, or one of the segment's closing sizes
    sizes = F.array_sort(F.array_union(F.array(F.lit(-1)), F.transform(F.filter("m", lambda m: m["closes"]), lambda m: m["size"])))
    above = lambda s: F.when(s < 0, F.expr(_OUTSIDE)).otherwise(F.struct(s.alias("size"), F.lit("above").alias("kind"), F.lit(0).alias("since")))
    exits = F.transform(sizes, lambda s: F.struct(s.alias("upto"), F.aggregate("m", above(s).cast(_STATE), _step).alias("exit")))
    told = own.withColumn("exits", exits)
    chained = told.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("_seg", "exits"))).alias("all"))
    start = F.struct(F.expr(_OUTSIDE).cast(_STATE).alias("now"), F.array().cast(f"array<struct<_seg:bigint,enter:{_STATE}>>").alias("out"))

    def chain(acc: Column, s: Column) -> Column:
        return F.struct(_enter(acc["now"], s["exits"]).alias("now"), F.concat(acc["out"], F.array(F.struct(s["_seg"].alias("_seg"), acc["now"].alias("enter")))).alias("out"))

    entered = chained.select("source", F.inline(F.aggregate("all", start, chain, lambda a: a["out"])))
    scan = F.struct(F.col("enter").alias("now"), F.array().cast(f"array<struct<line:int,before:{_STATE},after:{_STATE}>>").alias("out"))

    def tell(acc: Column, m: Column) -> Column:
        after = _step(acc["now"], m)
        return F.struct(after.alias("now"), F.concat(acc["out"], F.array(F.struct(m["line"].alias("line"), acc["now"].alias("before"), after.alias("after")))).alias("out"))

    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a._seg") == F.col("b._seg"))
    first = F.struct(F.lit(0).alias("line"), F.col("enter").alias("before"), F.col("enter").alias("after"))
    turned = own.alias("a").join(entered.alias("b"), same).select("a.source", "a._seg", F.explode(F.concat(F.array(first), F.aggregate("m", scan, tell, lambda a: a["out"]))).alias("_turn"))
    # what happens at a line comes just before it, and a segment's entry before all of its lines
    at = turned.select("source", F.col("_turn.line").alias("_at"), "_seg", F.lit(None).cast(held.schema["_row"].dataType).alias("_row"), "_turn")
    every = at.unionByName(held.drop("_mark").withColumn("_turn", F.lit(None).cast(at.schema["_turn"].dataType)))
    over = W.partitionBy("source", "_seg").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = every.withColumn("_turn", F.last("_turn", ignorenulls=True).over(over)).where("_row is not null")
    here, before, after = F.col("_turn.line") == F.col("_at"), F.col("_turn.before"), F.col("_turn.after")
    opens = here & before["kind"].isNull() & after["kind"].isNotNull()
    closes = here & before["kind"].isNotNull() & after["kind"].isNull()
    within = F.when(closes, before).otherwise(after)
    role = F.when(opens, "open").when(closes, "close").otherwise("text")
    return found.select(*[F.col("_row")[c].alias(c) for c in lines.columns], role.alias("role"), within["kind"].alias("block"), within["since"].alias("since"))


def left_open(blocked: DataFrame) -> DataFrame:
    """source, line (the last), block, since of texts that end inside a block."""
    last = blocked.groupBy("source").agg(F.max("line").alias("line"), F.max_by(F.struct("role", "block", "since"), "line").alias("at"))
    return last.where("at.role <> 'close' and at.block is not null").select("source", "line", "at.block", "at.since")
