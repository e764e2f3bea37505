"""Interval, nearest, radius and one-to-one joins.

Distance joins go through buckets as wide as the radius: one side is put in its bucket, the other in its own and the
neighbouring ones, so that an equi-join on the bucket finds all pairs within reach and Spark never compares all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, materialise
from .linework import components


def first_match(left: DataFrame, rights: Sequence[tuple[DataFrame, Column]], pick: str, name: str) -> DataFrame:
    """Left joins in order of preference; the first match of `pick` is taken, rows without one are dropped."""
    out, found = left, []
    for k, (right, on) in enumerate(rights):
        out = out.join(right.select(*[F.col(c).alias(c) for c in right.columns if c != pick], F.col(pick).alias(f"__m{k}")), on, "left").drop(*[c for c in right.columns if c != pick])
        found.append(F.col(f"__m{k}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*[f"__m{k}" for k in range(len(found))]).where(F.col(name).isNotNull())


def without(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def _cells(low, high, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def inset_anti(lines: DataFrame, boxes: DataFrame, keys: Sequence[str], share: float = 0.5, cell: float = 256.0) -> DataFrame:
    """Drop lines of which a box covers over `share`, which is a half or more.

    A line's area takes sides of at least 1, the overlap its true sides: a line without width overlaps nothing. A box
    that covers over a half holds the line's centre, so a line is looked up in the cell of its centre only and boxes
    are put in every cell that they touch: an equi-join on key and cell.
    """
    if share < 0.5:
        raise ValueError("share under a half: a line's centre need not be in the box")
    sides = ("x_min", "x_max", "y_min", "y_max")
    b = boxes.where("x_min <= x_max and y_min <= y_max").select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in sides])
    b = b.withColumn("b_i", F.explode(_cells(F.col("b_x_min"), F.col("b_x_max"), cell))).withColumn("b_j", F.explode(_cells(F.col("b_y_min"), F.col("b_y_max"), cell)))
    w = F.greatest(F.lit(0.0), F.least("x_max", "b_x_max") - F.greatest("x_min", "b_x_min"))
    h = F.greatest(F.lit(0.0), F.least("y_max", "b_y_max") - F.greatest("y_min", "b_y_min"))
    area = F.greatest(F.lit(1.0), F.col("x_max") - F.col("x_min")) * F.greatest(F.lit(1.0), F.col("y_max") - F.col("y_min"))
    on = (F.floor((F.col("x_min") + F.col("x_max")) / 2 / cell) == F.col("b_i")) & (F.floor((F.col("y_min") + F.col("y_max")) / 2 / cell) == F.col("b_j")) & (w * h / area > share)
    for k in keys:
        on = (F.col(k) == F.col(f"b_{k}")) & on
    return lines.join(b, on, "left_anti")


def point_in_box_anti(points: DataFrame, boxes: DataFrame, keys: Sequence[str], margin: float = 18.0, x: str = "cx", y: str = "cy", cell: float = 256.0) -> DataFrame:
    """Drop points inside a box widened by the margin, its edges included: an equi-join on key and cell."""
    b = boxes.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[(F.col(c) + s * margin).alias(f"b_{c}") for c, s in (("x_min", -1), ("x_max", 1), ("y_min", -1), ("y_max", 1))])
    b = b.where("b_x_min <= b_x_max and b_y_min <= b_y_max")
    b = b.withColumn("b_i", F.explode(_cells(F.col("b_x_min"), F.col("b_x_max"), cell))).withColumn("b_j", F.explode(_cells(F.col("b_y_min"), F.col("b_y_max"), cell)))
    on = (F.floor(F.col(x) / cell) == F.col("b_i")) & (F.floor(F.col(y) / cell) == F.col("b_j")) & F.col(x).between(F.col("b_x_min"), F.col("b_x_max")) & F.col(y).between(F.col("b_y_min"), F.col("b_y_max"))
    for k in keys:
        on = (F.col(k) == F.col(f"b_{k}")) & on
    return points.join(b, on, "left_anti")


def interval_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], low: str, high: str, r_low: str, r_high: str, bucket: float) -> DataFrame:
    """Pairs whose closed intervals overlap, with the overlap's ends as lo and hi.

    Both sides are put in every bucket that they touch; a pair is given in the bucket of the later start only.
    """
    spread = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    l = spread(left.where(F.col(low) <= F.col(high)), low, high, "__b")
    r = spread(right.where(F.col(r_low) <= F.col(r_high)), r_low, r_high, "__rb")
    r = r.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in r.columns])
    lo, hi = F.greatest(F.col(low), F.col(r_low)), F.least(F.col(high), F.col(r_high))
    on = (F.col("__b") == F.col("__rb")) & (lo <= hi) & (F.floor(lo / bucket) == F.col("__b"))
    for k in keys:
        on = (F.col(k) == F.col(f"__k_{k}")) & on
    return l.join(r, on).withColumns({"lo": lo, "hi": hi}).drop("__b", "__rb", *[f"__k_{k}" for k in keys])


def nearest_centre(values: DataFrame, centres: DataFrame, keys: Sequence[str], value: Column, centre: str, index: str, ids: Sequence[str], within: float) -> DataFrame:
    """For each value the centre at the least distance, the lower index on ties, if the distance is under `within`.

    Values and centres of a bucket stand in one order, with the nearest centre of either bucket beside it; each value looks
    at the centre before and the one after it, so rows grow with the two tables and never with their pairs.
    """
    keys, ids = list(keys), [i for i in ids if i not in keys]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("__p").isNotNull() & ~F.isnan("__p"))
    bucket = F.floor(F.col("__p") / within)
    v = values.select(*keys, *ids, value.cast("double").alias("__p")).where(whole).withColumn("__b", bucket)
    # Of centres at one place only the lowest index can win.
    c = centres.select(*keys, F.col(centre).cast("double").alias("__p"), F.col(index).alias("__i")).where(whole).groupBy(*keys, "__p").agg(F.min("__i").alias("__i"))
    c = c.withColumn("__b", bucket).select(*keys, "__b", "__p", F.struct(F.col("__p").alias("c"), F.col("__i").alias("i")).alias("__c"))
    ends = c.groupBy(*keys, "__b").agg(F.min("__c").alias("low"), F.max("__c").alias("high"))
    beside = [ends.select(*keys, (F.col("__b") + step).alias("__b"), F.col(f"{end}.c").alias("__p"), F.col(end).alias("__c")) for end, step in (("high", 1), ("low", -1))]
    rows = reduce(lambda a, b: a.unionByName(b, True), [v.withColumn("__own", F.lit(1)), c.withColumn("__own", F.lit(0)), *[e.withColumn("__own", F.lit(0)) for e in beside]])
    last = lambda order: F.last("__c", ignorenulls=True).over(Window.partitionBy(*keys, "__b").orderBy(order, "__own").rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumn("__below", last(F.asc("__p"))).withColumn("__above", last(F.desc("__p"))).where("__own = 1")
    found = lambda s: F.when(F.abs(F.col("__p") - F.col(f"{s}.c")) < within, F.struct(F.abs(F.col("__p") - F.col(f"{s}.c")).alias("distance"), F.col(f"{s}.i").alias(index), F.col(f"{s}.c").alias(centre)))
    best = near.withColumn("m", F.least(found("__below"), found("__above"))).where("m is not null").groupBy(*keys, *ids).agg(F.min("m").alias("m"))
    return best.select(*keys, *ids, "m.*")


def nearest_line(points: DataFrame, lines: DataFrame, keys: Sequence[str], x: str, y: str, slope: str, intercept: str, index: str, within: Column, cell: float) -> DataFrame:
    """Each point with the line x = slope * y + intercept of its key that is nearest along x, under `within` (a column of
    lines); the lower index on ties: the columns of points, index, distance. Points without such a line are dropped.

    The plane is cut into bands of y and cells of x. A line lies in the cells that it crosses within each band, and as far as
    `within` beside them, so steep and slanted lines alike meet only the points near them.
    """
    band = F.floor(F.col(y) / cell)
    p = points.withColumn("__band", band).withColumn("__cell", F.floor(F.col(x) / cell))
    reach = p.groupBy(*keys).agg(F.min("__band").alias("__low"), F.max("__band").alias("__high"))
    l = lines.select(*keys, F.col(index).alias("__i"), F.col(slope).alias("__a"), F.col(intercept).alias("__b"), within.alias("__w")).join(reach, list(keys))
    l = l.withColumn("__band", F.explode(F.sequence("__low", "__high")))
    ends = [F.col("__a") * (F.col("__band") + k) * cell + F.col("__b") for k in (0, 1)]
    cells = F.sequence(F.floor((F.least(*ends) - F.col("__w")) / cell), F.floor((F.greatest(*ends) + F.col("__w")) / cell))
    l = l.select(*keys, "__i", "__a", "__b", "__w", "__band", F.explode(cells).alias("__cell"))
    near = p.join(l, [*keys, "__band", "__cell"]).withColumn("__d", F.abs(F.col(x) - (F.col("__a") * F.col(y) + F.col("__b")))).where(F.col("__d") < F.col("__w"))
    best = near.groupBy(*points.columns).agg(F.min(F.struct(F.col("__d").alias("distance"), F.col("__i").alias(index))).alias("m"))
    return best.select(*points.columns, f"m.{index}", "m.distance")


def radius_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], radius: float, lx: str, ly: str, rx: str, ry: str, inclusive: bool = True) -> DataFrame:
    """All pairs within a radius in the plane, with their distance.

    Cells are dealt to a fixed number of tasks: a few rows may make many pairs, so tasks are not put together by their size.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda c: F.floor(F.col(c) / radius)
    l = left.withColumn("__c", F.explode(F.array(*[F.struct((cell(lx) + i).alias("i"), (cell(ly) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    r = right.withColumn("__c", F.struct(cell(rx).alias("i"), cell(ry).alias("j")))
    d = F.sqrt((F.col(lx) - F.col(rx)) ** 2 + (F.col(ly) - F.col(ry)) ** 2)
    out = l.repartition(tasks, *keys, "__c").join(r.repartition(tasks, *keys, "__c"), [*keys, "__c"]).withColumn("distance", d).drop("__c")
    return out.where(F.col("distance") <= radius if inclusive else F.col("distance") < radius)


def snap(points: DataFrame, targets: DataFrame, keys: Sequence[str], ids: Sequence[str], reach: float = 10.0) -> DataFrame:
    """Each point (x, y) moved to the nearest target (tx, ty) within reach, or left where it is.

    Targets at one place are one. Cells grow from a sixteenth of the reach to the whole: a target within a cell's width is
    the nearest, and only points without one go on, so that dense targets do not meet every point of a wide cell.
    """
    keys, ids = list(keys), list(ids)
    places, left, parts = targets.select(*keys, "tx", "ty").distinct(), points.select(*keys, *ids, "x", "y"), []
    for share in (16, 4, 1):
        near = radius_pairs(left, places, keys, reach / share, "x", "y", "tx", "ty")
        found = near.groupBy(*keys, *ids).agg(F.min(F.struct("distance", "tx", "ty")).alias("m"))
        parts.append(materialise(found, "snapped"))
        left = left.join(parts[-1].select(*keys, *ids), [*keys, *ids], "left_anti")
    best = reduce(DataFrame.unionByName, parts)
    return points.join(best, [*keys, *ids], "left").select(*[c for c in points.columns if c not in ("x", "y")], F.coalesce("m.tx", "x").alias("x"), F.coalesce("m.ty", "y").alias("y"))


def facing_ends(ends: DataFrame, keys: Sequence[str], radius: float, angle: float) -> DataFrame:
    """Nearest end of another line within a radius (under it) that heads the other way: the dot product of both outward
    directions is at most -cos(angle); an end without direction passes. ends: line_id, side, x, y, dx, dy."""
    other = ends.select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("line_id", "side", "x", "y", "dx", "dy")])
    pairs = radius_pairs(ends, other, keys, radius, "x", "y", "o_x", "o_y", inclusive=False).where(F.col("line_id") != F.col("o_line_id"))
    dot = F.col("dx") * F.col("o_dx") + F.col("dy") * F.col("o_dy")
    pairs = pairs.where(F.coalesce(dot <= -F.cos(F.radians(F.lit(angle))) + 1e-12, F.lit(True)))
    best = pairs.groupBy(*keys, "line_id", "side").agg(F.min(F.struct("distance", "o_line_id", "o_side")).alias("m"))
    return best.select(*keys, "line_id", "side", "m.*")


#: Rounds of mutual best choices before what is left is cut into components, and pairs of which one task holds all.
ROUNDS, TASK_PAIRS = 6, 1_000_000


def in_components(pairs: DataFrame, keys: Sequence[str], left: Column, right: Column, solve: Callable[[pa.Table], pa.Table], kind: str, most: int = TASK_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(solved, rest): solve applied to the pairs of whole components that have up to `most` pairs, and the other pairs.

    Pairs hang together by the nodes `left` and `right`, which must be of one type. Components are dealt to as many tasks as
    their pairs fill, and solve gets those of a task together: no pair of one component may matter to another.
    """
    named = materialise(pairs.withColumn("__a", left).withColumn("__b", right), "named")
    parts = components(named.select("__a", "__b"), "__a", "__b").select(F.col("id").alias("__a"), "component")
    sized = named.join(parts, "__a")
    small = sized.groupBy("component").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") <= most)
    small = materialise(sized.join(small.select("component"), "component", "left_semi"), "small")
    tasks = max(1, -(-small.count() // most))
    solved = small.withColumn("__task", F.pmod(F.xxhash64("component"), F.lit(tasks))).select(*pairs.columns, "__task")
    solved = solved.groupBy("__task").applyInArrow(lambda t: solve(t.drop(["__task"])), kind)
    return solved, sized.join(small.select("component").distinct(), "component", "left_anti").select(*pairs.columns)


#: Pairs a row up to which rows are matched by pairs; more go by places.
ROW_PAIRS = 16


def greedy_match(left: DataFrame, right: DataFrame, keys: Sequence[str], lpos: str, rpos: str, lid: str, rid: str, within: float, most: int = TASK_PAIRS) -> DataFrame:
    """One-to-one matching, nearest pairs first (ties by left, then right id), up to a distance of within inclusive.

    Rounds over places, without pairs: where a place of lefts and one of rights are nearest to each other, and no other is
    as near, their rows are matched in the order of their ids; of several as near, the first pair alone is taken. Rows out
    of reach go. Once a few pairs a row are left, or if there never were more, the rest goes by pairs. Keys whose ids repeat, or whose places differ by so little that distances round to the same, go by pairs at once.
    """
    # Keys go by names of their own, which no column in between has.
    names, keys = list(keys), [f"__key{i}" for i, _ in enumerate(keys)]
    named = lambda df: df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "l_id", "r_id", "distance")

    def placed(df: DataFrame, at: str, name: str) -> DataFrame:
        some = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in names], F.col(name).isNotNull() & (F.abs(at) < float("inf")))
        return df.where(some).select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col(name).alias("id"), F.col(at).alias("p"))

    l, r = placed(left, lpos, lid), placed(right, rpos, rid)
    if {dict(df.dtypes)["p"] for df in (l, r)} - {"double", "int", "bigint"}:
        return named(_matched_pairs(_reach(l, r, keys, within), keys, most))
    again = [df.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys) for df in (l, r)]
    shift = F.explode(F.array(F.lit(0.0), F.lit(0.5)))
    places = l.select(*keys, F.col("p").cast("double")).unionByName(r.select(*keys, F.col("p").cast("double"))).distinct().withColumn("shift", shift).withColumn("b", F.floor(F.col("p") / within + F.col("shift")))
    gap = F.col("p") - F.lag("p").over(Window.partitionBy(*keys, "shift", "b").orderBy("p"))
    odd = materialise(places.withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") <= within * 2.0**-51)).select(*keys).unionByName(again[0]).unionByName(again[1]).distinct(), "odd")
    taken = []
    if not odd.isEmpty():
        taken.append(_matched_pairs(_reach(l.join(odd, keys, "left_semi"), r.join(odd, keys, "left_semi"), keys, within), keys, most))
        l, r = l.join(odd, keys, "left_anti"), r.join(odd, keys, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*keys, "p").orderBy("id"))
    l, r = (materialise(df.withColumn("rank", rank), "ranked") for df in (l, r))
    tables, rounds = [l, r], 0
    while not l.isEmpty() and not r.isEmpty():
        if _pair_count(l, r, keys, within) <= ROW_PAIRS * (l.count() + r.count()):
            taken.append(_matched_pairs(_reach(l, r, keys, within), keys, most, min(rounds, ROUNDS)))
            break
        lefts, rights = _nearest_places(l, r, keys, within)
        n = F.when(F.col("tie") | F.col("o_tie"), 1).otherwise(F.least("n", "o_n"))
        agreed = lefts.join(rights.select(*keys, F.col("p").alias("q"), F.col("q").alias("p"), F.col("n").alias("o_n"), F.col("tie").alias("o_tie")), [*keys, "p", "q"]).select(*keys, "p", "q", n.alias("k"))
        agreed = materialise(agreed, "agreed")
        # Of a place the first rows go, so what is left of it begins at one rank.
        own = lambda df, at, near: df.join(near.select(*keys, "p", "passed").join(agreed.select(*keys, F.col(at).alias("p"), F.col("p").alias("pair"), "k"), [*keys, "p"], "left"), [*keys, "p"]).withColumn("nth", F.when(F.col("rank") - F.col("passed") <= F.col("k"), F.col("rank") - F.col("passed")))  # noqa: B023, E731
        l, r = materialise(own(l, "p", lefts), "lefts"), materialise(own(r, "q", rights), "rights")
        pairs = l.where("nth IS NOT NULL").select(*keys, "pair", "nth", F.col("id").alias("l_id"), F.col("p").alias("__l"))
        pairs = pairs.join(r.where("nth IS NOT NULL").select(*keys, "pair", "nth", F.col("id").alias("r_id"), F.col("p").alias("__r")), [*keys, "pair", "nth"])
        taken.append(materialise(pairs.select(*keys, "l_id", "r_id", F.abs(F.col("__l") - F.col("__r")).alias("distance")), "matched"))
        for done in (*tables, agreed, lefts, rights):
            forget(done)
        tables, rounds = [l, r], rounds + 1
        l, r = (df.where("nth IS NULL").select(*keys, "id", "p", "rank") for df in (l, r))
    none = _reach(l.limit(0), r.limit(0), keys, within)
    return named(reduce(DataFrame.unionByName, taken, none))


def _nearest_places(l: DataFrame, r: DataFrame, keys: Sequence[str], within: float) -> tuple[DataFrame, DataFrame]:
    """For places p of lefts and of rights the nearest place q of the other side within reach: (keys, p, q, n, passed, tie).

    n rows are at p, after `passed` that are gone; of two places as near (tie) q is that of the smaller first id. As in
    nearest_centre(), places of a bucket stand in one order, with the nearest ones of the buckets beside it.
    """
    side = lambda df, s: df.select(*keys, "p", F.col("id").alias(f"{s}_id"), F.col("rank").alias(f"{s}_rank"))
    rows = side(l, "l").unionByName(side(r, "r"), True)
    places = rows.groupBy(*keys, "p").agg(*[f for s in "lr" for f in (F.count(f"{s}_id").alias(f"{s}_n"), F.min(f"{s}_id").alias(f"{s}_id"), (F.min(f"{s}_rank") - 1).alias(f"{s}_passed"))])
    at = lambda s: F.when(F.col(f"{s}_n") > 0, F.struct(F.col("p").alias("q"), F.col(f"{s}_id").alias("id"))).alias(s)
    places = materialise(places.select("*", at("l"), at("r"), F.floor(F.col("p") / within).alias("__b")), "places")
    ends = places.groupBy(*keys, "__b").agg(*[f(s).alias(f"{s}_{n}") for s in "lr" for f, n in ((F.max, "last"), (F.min, "first"))])
    beside = [ends.where(f"{s}_{n} IS NOT NULL").select(*keys, (F.col("__b") + step).alias("__b"), F.col(f"{s}_{n}.q").alias("p"), F.col(f"{s}_{n}").alias(s)) for s in "lr" for n, step in (("last", 1), ("first", -1))]
    rows = reduce(lambda a, b: a.unionByName(b, True), [places.withColumn("own", F.lit(1)), *beside])
    last = lambda s, order: F.last(s, ignorenulls=True).over(Window.partitionBy(*keys, "__b").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    near = rows.withColumns({f"{s}_{name}": last(s, order) for s in "lr" for name, order in (("below", F.asc("p")), ("above", F.desc("p")))}).where("own = 1")
    out = []
    for s, o in ("lr", "rl"):
        ways = [F.abs(F.col("p") - F.col(f"{o}_{w}.q")) for w in ("below", "above")]
        best = F.least(*[F.when(d <= within, F.struct(d.alias("d"), F.col(f"{o}_{w}.id").alias("id"), F.col(f"{o}_{w}.q").alias("q"))) for d, w in zip(ways, ("below", "above"), strict=True)])
        tie = F.coalesce((ways[0] == ways[1]) & (F.col(f"{o}_below.q") != F.col(f"{o}_above.q")), F.lit(False))
        found = near.where(f"{s}_n > 0").withColumn("m", best).where("m IS NOT NULL")
        out.append(materialise(found.select(*keys, "p", "m.q", F.col(f"{s}_n").alias("n"), F.col(f"{s}_passed").alias("passed"), tie.alias("tie")), "nearest"))
    forget(places)
    return out[0], out[1]


def _reach(l: DataFrame, r: DataFrame, keys: Sequence[str], within: float) -> DataFrame:
    """(keys, l_id, r_id, distance): all pairs within reach, by a join on buckets."""
    b = F.floor(F.col("p") / within)
    l = l.select(*keys, F.col("id").alias("l_id"), F.col("p").alias("l_pos"), F.explode(F.array(b - 1, b, b + 1)).alias("__b"))
    r = r.select(*keys, F.col("id").alias("r_id"), F.col("p").alias("r_pos"), b.alias("__b"))
    return l.join(r, [*keys, "__b"]).select(*keys, "l_id", "r_id", F.abs(F.col("l_pos") - F.col("r_pos")).alias("distance")).where(F.col("distance") <= within)


def _pair_count(l: DataFrame, r: DataFrame, keys: Sequence[str], within: float) -> int:
    """Pairs that the join of _reach() meets, from the rows of each bucket."""
    b = F.floor(F.col("p") / within)
    n = lambda df, *at: df.select(*keys, F.explode(F.array(*at)).alias("__b")).groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("n"))
    met = n(l, b - 1, b, b + 1).join(n(r, b).withColumnRenamed("n", "m"), [*keys, "__b"])
    return met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _matched_pairs(pairs: DataFrame, keys: Sequence[str], most: int, rounds: int = 0) -> DataFrame:
    """greedy_match() of pairs that are there: rounds of mutual best choices give what the sorted greedy pass gives.

    A pair that is the best for both its sides is taken, and all pairs of what it uses go. What ROUNDS rounds leave hangs
    on long chains; its components of up to `most` pairs are passed through in order, each in one task, and only larger
    ones take more rounds.
    """
    pairs, taken = materialise(pairs, "pairs"), []

    def in_order(table: pa.Table) -> pa.Table:
        rows = sorted(((*(r[k] for k in ("distance", "l_id", "r_id")), *(r[k] for k in keys), i) for i, r in enumerate(table.to_pylist())))
        used, kept = set(), []
        for row in rows:
            sides = {("l", row[1], *row[3:-1]), ("r", row[2], *row[3:-1])}
            if not sides & used:
                used |= sides
                kept.append(row[-1])
        return table.take(pa.array(sorted(kept), pa.int64()))

    while True:
        if rounds == ROUNDS and not pairs.isEmpty():
            node = lambda side, c: F.struct(F.lit(side).alias("side"), *keys, F.col(c).cast("string").alias("id"))
            kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
            solved, rest = in_components(pairs, keys, node("l", "l_id"), node("r", "r_id"), in_order, kind, most)
            taken.append(materialise(solved, "matched"))
            done, pairs = pairs, materialise(rest, "pairs")
            forget(done)
        best = lambda side: pairs.groupBy(*keys, side).agg(F.min(F.struct("distance", "l_id", "r_id")).alias("m")).select(*keys, "m.*")  # noqa: B023, E731
        mutual = materialise(best("l_id").join(best("r_id"), [*keys, "distance", "l_id", "r_id"]), "matched")
        if mutual.isEmpty():
            break
        taken.append(mutual)
        free = pairs.join(mutual.select(*keys, "l_id"), [*keys, "l_id"], "left_anti").join(mutual.select(*keys, "r_id"), [*keys, "r_id"], "left_anti")
        done, pairs = pairs, materialise(free.select(*pairs.columns), "pairs")
        forget(done)
        rounds += 1
    return reduce(DataFrame.unionByName, [t.select(*keys, "l_id", "r_id", "distance") for t in taken], mutual.select(*keys, "l_id", "r_id", "distance"))


def interpolate(samples: DataFrame, vertices: DataFrame, keys: Sequence[str], at: str, x: str, y: str, order: Sequence[str] = ()) -> DataFrame:
    """y at given positions on each key's chain of vertices sorted by x, linear between neighbours, null outside."""
    by = Window.partitionBy(*keys).orderBy(x, *order)
    spans = vertices.select(*keys, F.col(x).alias("__x1"), F.col(y).alias("__y1"), F.lead(x).over(by).alias("__x2"), F.lead(y).over(by).alias("__y2")).where("__x2 is not null")
    on = F.col(at).between(F.col("__x1"), F.col("__x2"))
    s = spans.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__x1", "__y1", "__x2", "__y2")
    for k in keys:
        on = (F.col(k) == F.col(f"__k_{k}")) & on
    hit = samples.join(s, on, "left")
    value = F.when(F.col("__x2") == F.col("__x1"), F.col("__y1")).otherwise(F.col("__y1") + (F.col(at) - F.col("__x1")) / F.nullif(F.col("__x2") - F.col("__x1"), F.lit(0.0)) * (F.col("__y2") - F.col("__y1")))
    return hit.groupBy(*samples.columns).agg(F.min_by(value, F.struct("__x1", "__x2", "__y1", "__y2")).alias("value"))


def aligned(truth: DataFrame, prediction: DataFrame, keys: Sequence[str], t_size: Column | None = None, p_size: Column | None = None) -> DataFrame:
    """Foreground pixels of truth and prediction side by side, 0 where one of them has none."""
    t = truth.select(*keys, "x", "y", F.col("cls").alias("truth"))
    p = prediction.select(*keys, "x", "y", F.col("cls").alias("pred"))
    return t.join(p, [*keys, "x", "y"], "full").select(*keys, "x", "y", F.coalesce("truth", F.lit(0)).alias("truth"), F.coalesce("pred", F.lit(0)).alias("pred"))
