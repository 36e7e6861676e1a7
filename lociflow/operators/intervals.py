"""Interval algebra: merge, remainder, join, nearest, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import WIDTH, join_cells, line, with_cell, within


def with_reach(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """df with `__cell` and `__carry`, the largest end of all records of earlier cells (null in the first)."""
    placed = with_cell(df, start, width)
    ends = placed.groupBy(*keys, "__cell").agg(F.max(end).alias("__end"))
    carried = ends.select(*keys, "__cell", F.max("__end").over(line(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    return join_cells(placed, carried, keys)


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """Unions of ranges that overlap or touch: keys, start, end, n (ranges in it).

    Ranges are merged cell by cell. Of a cell's unions only what an earlier cell
    reaches (one piece) and the last one may go on elsewhere; these pieces, two a
    cell at most, are put together along the line.
    """
    rows = with_reach(df.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e")), keys, "__s", "__e", width)
    order = within(keys, "__s", "__e")
    before = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__first", (before.isNull() | (F.col("__s") > before)).cast("int")).withColumn("__n", F.sum("__first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = [F.min("__s").alias("__s"), F.max("__e").alias("__e"), F.max("__carry").alias("__carry")]
    unions = marked.groupBy(*keys, "__cell", "__n").agg(*whole, F.count("*").alias("n"))
    own = F.col("__carry").isNull() | (F.col("__s") > F.col("__carry"))
    pieces = unions.withColumn("__n", F.when(own, F.col("__n")).otherwise(0)).groupBy(*keys, "__cell", "__n").agg(*whole, F.sum("n").alias("n"))
    last = F.lead("__n").over(within(keys, "__n")).isNull()
    pieces = pieces.withColumn("__open", last | (F.col("__n") == 0))
    edges = pieces.where("__open").withColumn("__island", F.sum((F.col("__n") > 0).cast("int")).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__cell", "__n")))
    joined = edges.groupBy(*keys, "__island").agg(F.min("__s").alias(start), F.max("__e").alias(end), F.sum("n").alias("n")).drop("__island")
    return pieces.where("NOT __open").select(*keys, F.col("__s").alias(start), F.col("__e").alias(end), "n").unionByName(joined)


#: Widths of the bins in which requests and gaps meet.
WIDTHS = [1 << 6, 1 << 10, 1 << 14, 1 << 18, 1 << 22, 1 << 26]


def gaps(covered: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """What lies between the covered ranges of each line: keys, start, end. The next range is looked for in a union's cell and then in the next cell that has any."""
    unions = with_cell(merge(covered.where(F.col(start) < F.col(end)), keys, start, end, width), start, width)
    firsts = unions.groupBy(*keys, "__cell").agg(F.min(start).alias("__first"))
    ahead = firsts.select(*keys, "__cell", F.lead("__first").over(line(keys)).alias("__next"))
    following = F.coalesce(F.lead(start).over(within(keys, start)), "__next")
    return join_cells(unions, ahead, keys).select(*keys, F.col(end).alias(start), following.alias(end)).where(F.col(end).isNotNull())


def remainder(requests: DataFrame, covered: DataFrame, keys: list[str], request: str, start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """The parts of each request that no covered range of its keys holds: request, start, end.

    They are the request's meets with the gaps between the covered ranges, which
    are found once for all requests, and what of it lies before the first or
    behind the last range of its line. So a line that many requests ask for and
    many ranges cover is no group of its own, and no request is paired with
    ranges that it holds whole. Empty requests and ranges are left out; a request
    whose keys are null, or have no range, remains whole.
    """
    asked = requests.select(request, *keys, F.col(start).cast("bigint").alias("__lo"), F.col(end).cast("bigint").alias("__hi")).where("__lo < __hi")
    held = covered.select(*keys, F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e")).where("__s < __e")
    between = gaps(held, keys, "__s", "__e", width)
    met = interval_join(asked.withColumnsRenamed({"__lo": "lo", "__hi": "hi"}), between.withColumnsRenamed({"__s": "lo", "__e": "hi"}), keys, WIDTHS, "lo", "hi")
    inner = met.select(request, F.greatest("lo", "r_lo").alias(start), F.least("hi", "r_hi").alias(end))
    ends = held.groupBy(*keys).agg(F.min("__s").alias("__first"), F.max("__e").alias("__last"))
    outer = asked.join(ends, keys, "left")
    pieces = F.when(F.col("__first").isNull(), F.array(F.struct(F.col("__lo").alias("s"), F.col("__hi").alias("e")))).otherwise(
        F.array(F.struct(F.col("__lo").alias("s"), F.least("__hi", "__first").alias("e")), F.struct(F.greatest("__lo", "__last").alias("s"), F.col("__hi").alias("e")))
    )
    return inner.unionByName(outer.select(request, F.explode(pieces).alias("p")).select(request, F.col("p.s").alias(start), F.col("p.e").alias(end)).where(F.col(start) < F.col(end)))


def _binned(df: DataFrame, widths: list[int], s: str, e: str, first: str, sides: tuple[list[int], int]) -> DataFrame:
    """A row for each bin that a record meets others in: __level, __side, __bin, and its first bin of that level."""
    long = F.greatest(F.col(e), F.col(s) + 1) - F.col(s)
    own = F.lit(len(widths) - 1)
    for i, w in reversed(list(enumerate(widths[:-1]))):
        own = F.when(long <= w, i).otherwise(own)
    cell = lambda c, w: F.floor(c / w)

    def at_level(i: int, w: int, side: int):
        return F.transform(F.sequence(cell(F.col(s), w), cell(F.greatest(F.col(s), F.col(e) - 1), w)), lambda b: F.struct(F.lit(i).alias("i"), b.alias("b"), cell(F.col(s), w).alias("f"), F.lit(side).alias("t")))

    def reached(i: int, w: int):
        """Of its own width a record meets all; where it comes from a narrower one, those whose own width it is."""
        at_own, above = (at_level(i, w, t) for t in sides[0]), at_level(i, w, sides[1])
        return F.when(F.col("__own") == i, F.concat(*at_own) if i else at_level(0, w, 0)).when(F.col("__own") < i, above).otherwise(F.slice(above, 1, 0))

    bins = F.concat(*(reached(i, w) for i, w in enumerate(widths))) if len(widths) > 1 else at_level(0, widths[0], 0)
    placed = df.withColumn("__own", own).withColumn("__b", F.explode(bins))
    return placed.withColumns({"__level": F.col("__b.i"), "__bin": F.col("__b.b"), "__side": F.col("__b.t"), first: F.col("__b.f")}).drop("__b", "__own")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: int | list[int], start: str = "start", end: str = "end", prefix: str = "r_") -> DataFrame:
    """Pairs of records of equal keys that share a base. right's columns get the prefix; columns of both sides must differ then, and names that begin with two low lines are kept for this.

    Records go to the bins that they reach, and bins are an ordinary equi-join
    key, of which AQE splits the hot ones. A pair is kept in the later of its two
    first bins only, so it comes once. Where lengths differ much, give several
    widths, each a multiple of the one before: a record goes to the bins of the
    first width that is not below its length, two at most, and to those above,
    and a pair meets at the wider of its two: `__side` keeps records that come
    from narrower widths on both sides from meeting there again. width near a
    high quantile of the lengths keeps both the copies and the candidates few.
    """
    widths = sorted([width] if isinstance(width, int) else width)

    renamed = right.select(*(F.col(c).alias(c if c in keys else prefix + c) for c in right.columns))
    # sides: 0 both of their own width, 1 the left's own, 2 the right's own
    a, b = _binned(left, widths, start, end, "__first", ([0, 1], 2)), _binned(renamed, widths, prefix + start, prefix + end, "__first_r", ([0, 2], 1))
    met = a.join(b, [*keys, "__level", "__bin", "__side"]).where(F.col("__bin") == F.greatest("__first", "__first_r"))
    return met.where((F.col(start) < F.col(prefix + end)) & (F.col(end) > F.col(prefix + start))).drop("__bin", "__level", "__side", "__first", "__first_r")


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], at: str, target_at: str, target_id: str, value: str, width: int = WIDTH) -> DataFrame:
    """points with the value and distance of the nearest target of equal keys; ties go to the smallest target_id.

    Both are laid out along the line once; the last target before and the first
    after each point are the only candidates, so there is no pairing. Those of
    other cells come from the table of cells.
    """
    one = targets.groupBy(*keys, F.col(target_at).cast("bigint").alias("__at")).agg(F.min(F.struct(F.col(target_id).alias("id"), F.col(value).alias("value"))).alias("__t"))
    one = one.select(*keys, "__at", F.struct("__at", "__t.id", "__t.value").alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast(points.schema).alias("__p"))
    asked = points.select(*keys, F.col(at).cast("bigint").alias("__at"), F.lit(None).cast(one.schema["__t"].dataType).alias("__t"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__p"))
    both = with_cell(one.unionByName(asked), "__at", width)
    ends = both.groupBy(*keys, "__cell").agg(F.max_by("__t", F.when(F.col("__t").isNotNull(), F.col("__at"))).alias("__last"), F.min_by("__t", F.when(F.col("__t").isNotNull(), F.col("__at"))).alias("__first"))
    along = line(keys)
    cells = ends.select(
        *keys, "__cell",
        F.last("__last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.first("__first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    back = within(keys, "__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = within(keys, F.col("__at").desc(), F.col("__kind")).rowsBetween(Window.unboundedPreceding, 0)
    near = join_cells(both, cells, keys).select("*", F.coalesce(F.last("__t", ignorenulls=True).over(back), "__before").alias("__b"), F.coalesce(F.last("__t", ignorenulls=True).over(ahead), "__after").alias("__a"))
    far = lambda c: F.abs(F.col(f"{c}.__at") - F.col("__at"))
    pick = lambda c: F.struct(far(c).alias("distance"), F.col(f"{c}.id").alias("id"), F.col(f"{c}.value").alias("value"))
    best = F.array_min(F.filter(F.array(pick("__b"), pick("__a")), lambda x: x["distance"].isNotNull()))
    return near.where("__kind = 1").select("__p.*", best.alias("__n")).select(*points.columns, F.col("__n.value").alias("nearest_value"), F.col("__n.id").alias("nearest_id"), F.col("__n.distance").alias("distance"))


def depth(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """Most records that share a base: keys, depth."""
    edges = df.where(F.col(start) < F.col(end)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = with_cell(edges.groupBy(*keys, "e.at").agg(F.sum("e.d").alias("d")), "at", width)
    change = with_cell(edges.select(*keys, "e.*"), "at", width).groupBy(*keys, "__cell").agg(F.sum("d").alias("__d"))
    base = change.select(*keys, "__cell", F.coalesce(F.sum("__d").over(line(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    run = F.col("__base") + F.sum("d").over(within(keys, "at").rowsBetween(Window.unboundedPreceding, 0))
    return join_cells(steps, base, keys).withColumn("n", run).groupBy(*keys).agg(F.max("n").alias("depth"))
