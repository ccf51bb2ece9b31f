"""Curves in the table itself: one measured attribute as a monotone function of another.

The lattice of a group has a node for the whole group and for each slice by a
value of a categorical attribute; on every node, each axis attribute may decide
each measured one.  A curve is (group, slice, axis, target) with its distinct
points, all found in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.operators.scan import numbered

#: what names a curve; slices of the whole group have empty names
CURVE = ("grp", "seg_k", "seg_v", "x_k", "y_k")
MIN_POINTS, MONOTONE_PCT, MAX_CATEGORIES = 6, 95, 30


def slices(long: DataFrame, min_rows: int = MIN_POINTS, max_values: int = MAX_CATEGORIES) -> DataFrame:
    """(grp, row_ord, seg_k, seg_v): the lattice nodes of each row.

    Categorical are attributes with 2 to ``max_values`` values in the group, by
    values that are no measures; a slice needs ``min_rows`` rows.
    """
    few = long.select("grp", "k", "v").distinct().groupBy("grp", "k").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_values)).drop("n")
    cells = long.where(X.measure(F.col("v")).isNull()).join(few, ["grp", "k"], "left_semi").select("grp", "row_ord", F.col("k").alias("seg_k"), F.col("v").alias("seg_v"))
    large = cells.groupBy("grp", "seg_k", "seg_v").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).drop("n")
    whole = long.select("grp", "row_ord", F.lit("").alias("seg_k"), F.lit("").alias("seg_v")).distinct()
    return cells.join(large, ["grp", "seg_k", "seg_v"], "left_semi").select("grp", "row_ord", "seg_k", "seg_v").unionByName(whole)


def curve_points(long: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct points (CURVE, x, y) for the measured attributes (grp, k) of ``targets``."""
    y = long.join(targets.select("grp", "k").distinct(), ["grp", "k"], "left_semi").select("grp", "row_ord", F.col("k").alias("y_k"), X.measure(F.col("v")).alias("y")).where("y is not null")
    x = long.select("grp", "row_ord", F.col("k").alias("x_k"), X.axis(F.col("v")).alias("x")).where("x is not null")
    both = y.join(x, ["grp", "row_ord"]).where("x_k <> y_k")
    return both.join(slices(long), ["grp", "row_ord"]).where("seg_k <> y_k").select(*CURVE, "x", "y").distinct()


def monotone_ratio(pts: DataFrame, by: tuple[str, ...] = CURVE, bucket: int = 4096) -> DataFrame:
    """(by, n_points, n_pairs, n_up, ratio): the share of pairs x1 < x2 of distinct points that have y1 <= y2.

    Pairs are counted, not listed.  Two places x1 < x2 of an axis differ first in
    one bit of their ranks, so each pair belongs to one level (the bit) and one
    block (the bits above it), x1 on the left side and x2 on the right.  In a block
    each right point counts the left points of no greater y: in buckets of
    ``bucket`` y ranks by a running sum, across buckets by a prefix sum of the
    buckets' totals.  Work is points times the bits of a rank; no window is longer
    than a bucket or than the buckets of a curve.
    """
    by = list(by)
    xs, ys = (numbered(pts.select(*by, c).distinct(), *by, c).withColumnRenamed("position", f"{c}_at") for c in ("x", "y"))
    first = xs.groupBy(*by).agg(F.min("x_at").alias("x0"), F.max("x_at").alias("x1")).join(ys.groupBy(*by).agg(F.min("y_at").alias("y0")), by)
    ranked = pts.join(xs, [*by, "x"]).join(ys, [*by, "y"]).join(first, by)
    ranked = ranked.select(*by, (F.col("x_at") - F.col("x0")).alias("i"), (F.col("y_at") - F.col("y0")).alias("j"), (F.col("x1") - F.col("x0")).alias("last"))
    levels = ranked.where("last > 0").select(*by, "i", "j", F.explode(F.sequence(F.lit(0), F.length(F.bin("last")) - 1)).alias("level"))
    sides = levels.select(*by, "level", F.expr("shiftright(i, level + 1)").alias("block"), "j", F.expr("shiftright(i, level) & 1").alias("right"))
    cells = sides.groupBy(*by, "level", "block", "j").agg(F.sum(1 - F.col("right")).alias("left"), F.sum("right").alias("right"))
    cells = cells.withColumn("bucket", F.floor(F.col("j") / bucket))
    block = [*by, "level", "block"]
    upto = F.sum("left").over(W.partitionBy(*block, "bucket").orderBy("j"))
    inside = cells.withColumn("up", F.col("right") * upto).groupBy(*block, "bucket").agg(F.sum("up").alias("up"), F.sum("left").alias("left"), F.sum("right").alias("right"))
    before = F.coalesce(F.sum("left").over(W.partitionBy(*block).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ups = inside.withColumn("up", F.col("up") + F.col("right") * before).groupBy(*by).agg(F.sum("up").alias("n_up"))
    sizes = pts.groupBy(*by, "x").agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum("c").alias("n_points"), F.sum(F.col("c") * F.col("c")).alias("same"))
    return sizes.join(ups, by).select(*by, "n_points", F.expr("(n_points * n_points - same) div 2").alias("n_pairs"), "n_up").withColumn("ratio", F.bround(F.col("n_up") / F.col("n_pairs"), 6))


def curves(ratios: DataFrame, by: tuple[str, ...] = CURVE, min_points: int = MIN_POINTS, percent: int = MONOTONE_PCT) -> DataFrame:
    """(by, direction, mono, n_points): enough points and pairs, nearly all in one direction."""
    up, down = 100 * F.col("n_up") >= percent * F.col("n_pairs"), 100 * F.col("n_up") <= (100 - percent) * F.col("n_pairs")
    share = F.col("n_up") / F.col("n_pairs")
    found = ratios.where((F.col("n_points") >= min_points) & (F.col("n_pairs") >= min_points))
    return found.select(*by, F.when(up, "up").when(down, "down").alias("direction"), F.bround(F.when(up, share).otherwise(1 - share), 3).alias("mono"), "n_points").where("direction is not null")


def brackets(asked: DataFrame, pts: DataFrame, found: DataFrame, by: tuple[str, ...] = CURVE) -> DataFrame:
    """(by, x, lo, hi, kind) for each distinct (by, x) asked of a curve: the range of y that the curve allows there.

    At an x of the curve, the y it has there (``exact``); elsewhere what lies
    between the nearest y before and after (``interp``), and no row where one side
    is missing.  Points and asked places are laid on one axis, and what comes
    before and after is a running extreme.
    """
    by = list(by)
    have = pts.join(found.select(*by), by, "left_semi").groupBy(*by, "x").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    places = asked.select(*by, "x").distinct().join(found.select(*by), by, "left_semi")
    lone = places.join(have.select(*by, "x"), [*by, "x"], "left_anti").select(*by, "x", F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("y1"))
    w = W.partitionBy(*by).orderBy("x")
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    axis = have.unionByName(lone).withColumns({"b0": F.min("y0").over(before), "b1": F.max("y1").over(before), "a0": F.min("y0").over(after), "a1": F.max("y1").over(after)})
    at = axis.join(places, [*by, "x"], "left_semi").join(found.select(*by, "direction"), by)
    up = F.col("direction") == "up"
    one, two = F.when(up, F.col("b1")).otherwise(F.col("a1")), F.when(up, F.col("a0")).otherwise(F.col("b0"))
    both = one.isNotNull() & two.isNotNull()
    out = at.select(*by, "x", F.coalesce("y0", F.when(both, F.least(one, two))).alias("lo"), F.coalesce("y1", F.when(both, F.greatest(one, two))).alias("hi"), F.when(F.col("y0").isNotNull(), "exact").otherwise("interp").alias("kind"))
    return out.where("lo is not null")


def candidates(values: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """(grp, row_ord, y_k, CURVE, x, direction, mono, n_points, seg_pos, x_pos): the curves that each asked cell can be held against.

    ``values`` has (grp, row_ord, k), ``known`` the row's own cells with their
    place in it (grp, row_ord, k, v, pos).
    """
    asked = values.select("grp", "row_ord", F.col("k").alias("y_k")).distinct()
    x = known.select("grp", "row_ord", F.col("k").alias("x_k"), X.axis(F.col("v")).alias("x"), F.col("pos").alias("x_pos")).where("x is not null")
    seg = known.where(X.measure(F.col("v")).isNull()).select("grp", "row_ord", F.col("k").alias("seg_k"), F.col("v").alias("seg_v"), F.col("pos").alias("seg_pos"))
    whole = known.select("grp", "row_ord", F.lit("").alias("seg_k"), F.lit("").alias("seg_v"), F.lit(-1).alias("seg_pos")).distinct()
    nodes = asked.join(x, ["grp", "row_ord"]).where("x_k <> y_k").join(seg.unionByName(whole), ["grp", "row_ord"]).where("seg_k <> y_k")
    return nodes.join(found, list(CURVE))


def verify_cells(values: DataFrame, known: DataFrame, long: DataFrame, pad: float = 0.02) -> DataFrame:
    """(grp, row_ord, k, value, status, ...): each value against the best curve of its row.

    Best is a slice before the whole group, then the more monotone curve, then the
    one of more points, then what stands first in the row.  A value within the
    bracket and ``pad`` of its larger end is PLAUSIBLE; else OUT_OF_RANGE where a
    slice says so and DISAGREE_UNSEGMENTED where only the whole group does.
    NOT_NUMERIC values are no measures; without a bracket there is NO_REFERENCE.
    """
    pts = curve_points(long, values)
    found = curves(monotone_ratio(pts))
    near = candidates(values, known, found)
    ranges = near.join(brackets(near, pts, found), [*CURVE, "x"])
    best = W.partitionBy("grp", "row_ord", "y_k").orderBy((F.col("seg_k") == "").cast("int"), F.desc("mono"), F.desc("n_points"), "seg_pos", "x_pos")
    top = ranges.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("grp", "row_ord", F.col("y_k").alias("k"), "seg_k", "seg_v", "x_k", "x", "lo", "hi", "kind", "mono", "n_points")
    y, room = X.measure(F.col("value")), pad * F.greatest(F.abs("lo"), F.abs("hi"))
    status = (
        F.when(y.isNull(), "NOT_NUMERIC").when(F.col("lo").isNull(), "NO_REFERENCE").when((y >= F.col("lo") - room) & (y <= F.col("hi") + room), "PLAUSIBLE")
        .when(F.col("seg_k") == "", "DISAGREE_UNSEGMENTED").otherwise("OUT_OF_RANGE")
    )
    return values.select("grp", "row_ord", "k", "value").join(top, ["grp", "row_ord", "k"], "left").withColumn("status", status)


def axis_label_choice(items: DataFrame, known: DataFrame, long: DataFrame, min_rows: int = 6, min_keys: int = 2, min_percent: int = 90) -> DataFrame:
    """(k, axis, label, usable, total, n_keys, purity): what decides each target, over the rows of all groups.

    Axes are attributes that asked rows know as a number, labels those they know
    as anything else, or none (an empty label).  A choice needs ``min_rows`` rows
    with a measured target, ``min_keys`` keys and one value for nearly all rows of a
    key.  Best is the axis that most items can use, then purity, then rows; ties by
    name.
    """
    asked = items.select("row_ord", F.col("k").alias("target")).distinct().join(known.select("row_ord", "k", "v"), "row_ord").where("k <> target")
    axes = asked.where(X.axis(F.col("v")).isNotNull()).groupBy("target", F.col("k").alias("axis")).agg(F.count("*").alias("usable"))
    labels = asked.where(X.axis(F.col("v")).isNull()).select("target", F.col("k").alias("label")).distinct()
    y = long.join(items.select("k").distinct(), "k", "left_semi").select("row_ord", F.col("k").alias("target"), X.measure(F.col("v")).alias("y")).where("y is not null")
    x = long.select("row_ord", F.col("k").alias("axis"), X.axis(F.col("v")).alias("x")).where("x is not null")
    on_axis = y.join(x, "row_ord").join(axes.select("target", "axis"), ["target", "axis"], "left_semi")
    named = on_axis.join(long.select("row_ord", F.col("k").alias("label"), F.col("v").alias("lv")), "row_ord").join(labels, ["target", "label"], "left_semi")
    rows = on_axis.withColumns({"label": F.lit(""), "lv": F.lit("")}).unionByName(named)
    key = ["target", "axis", "label", "lv", "x"]
    keys = rows.groupBy(*key, "y").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    made = keys.groupBy("target", "axis", "label").agg(F.sum("n").alias("total"), F.count("*").alias("n_keys"), F.sum("most").alias("good"))
    good = made.where((F.col("total") >= min_rows) & (F.col("n_keys") >= min_keys) & (100 * F.col("good") >= min_percent * F.col("total"))).join(axes, ["target", "axis"])
    best = W.partitionBy("target").orderBy(F.desc("usable"), F.desc(F.col("good") / F.col("total")), F.desc("total"), "axis", "label")
    return good.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(F.col("target").alias("k"), "axis", "label", "usable", "total", "n_keys", F.bround(F.col("good") / F.col("total"), 6).alias("purity"))


def cross_check(items: DataFrame, known: DataFrame, long: DataFrame) -> DataFrame:
    """(id, k, reason): answers (id, row_ord, k, value) that cannot be right together.

    Answers of one target are compared on its chosen axis, and only with answers of
    the same label: other values at one x (SAME_X), or an order that the target's
    curve over all rows does not have, equal values included (ORDER).  Each answer
    is held against the extremes at its x, before it and after it, so no pairs are
    listed.  Targets with one answer, or without a choice, have none.
    """
    several = items.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    items = items.join(several, "k", "left_semi")
    chosen = axis_label_choice(items, known, long)
    y = long.join(chosen.select("k"), "k", "left_semi").select("row_ord", "k", X.measure(F.col("v")).alias("y")).where("y is not null")
    x = long.select("row_ord", F.col("k").alias("axis"), X.axis(F.col("v")).alias("x")).where("x is not null")
    pts = y.join(chosen.select("k", "axis"), "k").join(x, ["row_ord", "axis"]).select("k", "x", "y").distinct()
    found = curves(monotone_ratio(pts, ("k",)), ("k",)).select("k", "direction")
    cells = known.select("row_ord", F.col("k").alias("a"), "v")
    at = items.select("id", "row_ord", "k", X.measure(F.col("value")).alias("y")).where("y is not null").join(chosen.select("k", "axis", "label"), "k")
    at = at.join(cells.select("row_ord", F.col("a").alias("axis"), X.axis(F.col("v")).alias("x")).where("x is not null"), ["row_ord", "axis"])
    at = at.join(cells.select("row_ord", F.col("a").alias("label"), F.col("v").alias("lv")), ["row_ord", "label"], "left").withColumn("lv", F.coalesce("lv", F.lit("")))
    w = W.partitionBy("k", "lv").orderBy("x")
    before, after = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    seen = at.groupBy("k", "lv", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).withColumns({"lo_before": F.min("lo").over(before), "hi_before": F.max("hi").over(before), "lo_after": F.min("lo").over(after), "hi_after": F.max("hi").over(after)})
    both = at.select("id", "k", "lv", "x", "y").join(seen, ["k", "lv", "x"]).join(found, "k", "left")
    up = (F.col("direction") == "up") & ((F.col("hi_before") >= F.col("y")) | (F.col("lo_after") <= F.col("y")))
    down = (F.col("direction") == "down") & ((F.col("lo_before") <= F.col("y")) | (F.col("hi_after") >= F.col("y")))
    reasons = F.array_compact(F.array(F.when(F.col("lo") != F.col("hi"), "SAME_X"), F.when(F.coalesce(up | down, F.lit(False)), "ORDER")))
    return both.select("id", "k", F.explode(reasons).alias("reason")).distinct()
