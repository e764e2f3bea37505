"""Driver queries: each operator on a geometric reading of the relational tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import ocr
from ..functions import text as t
from ..operators import cluster, filters, fit, gcp, joins, linework, metrics, ordered, raster, topology
from ..storage import materialise
from . import instances

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def _seconds() -> Column:
    return F.unix_timestamp(F.col("ts"))


#: All columns of a line item in a fixed order: (l_orderkey, l_linenumber) is no key.
LINE_TIES = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
_LINE_ORDER = "l_extendedprice, " + ", ".join(LINE_TIES)


@query("""
    WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    f AS (SELECT *, CASE WHEN sec - lag(sec) OVER w > 3600 THEN 1 ELSE 0 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id))
    SELECT user_id, event_id, sec, CAST(sum(o) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f
""")
def gap_cluster(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", _seconds().alias("sec"))
    return cluster.gap_clusters(e, ["user_id"], F.col("sec"), ["event_id"], 3600)


@query(f"""
    WITH f AS (SELECT *, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER w >= 2000 THEN 1 ELSE 0 END AS o FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY {_LINE_ORDER}, l_orderkey)),
    c AS (SELECT *, CAST(sum(o) OVER (PARTITION BY l_partkey ORDER BY {_LINE_ORDER}, l_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f)
    SELECT l_partkey, cluster, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM c GROUP BY l_partkey, cluster
""")
def gap_cluster_strict(spark, d):
    c = cluster.gap_clusters(_t(spark, d, "lineitem"), ["l_partkey"], F.col("l_extendedprice"), [*LINE_TIES, "l_orderkey"], 2000, strict=True)
    return c.groupBy("l_partkey", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query(f"""
    WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS rn FROM lineitem),
    f AS (
        SELECT l_orderkey, rn, l_extendedprice AS pos, l_quantity AS span, 1 AS slot FROM s WHERE rn = 1
        UNION ALL
        SELECT s.l_orderkey, s.rn,
               CASE WHEN s.l_extendedprice - f.pos > 5000 OR s.l_quantity > f.span THEN s.l_extendedprice ELSE f.pos END,
               CASE WHEN s.l_extendedprice - f.pos > 5000 OR s.l_quantity > f.span THEN s.l_quantity ELSE f.span END,
               CASE WHEN s.l_extendedprice - f.pos > 5000 THEN f.slot + 1 ELSE f.slot END
        FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.rn = f.rn + 1
    )
    SELECT l_orderkey, arg_max(pos, rn) AS pos, arg_max(span, rn) AS span FROM f GROUP BY l_orderkey, slot
""")
def dedup_fold(spark, d):
    kept = cluster.dedup_fold(_t(spark, d, "lineitem"), ["l_orderkey"], F.col("l_extendedprice"), F.col("l_quantity"), LINE_TIES, 5000)
    return kept.select("l_orderkey", F.col("l_extendedprice").alias("pos"), F.col("l_quantity").alias("span"))


@query("""
    WITH RECURSIVE s AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier),
    f AS (
        SELECT s_nationkey, s_suppkey, s_acctbal, rn, s_acctbal AS leader FROM s WHERE rn = 1
        UNION ALL
        SELECT s.s_nationkey, s.s_suppkey, s.s_acctbal, s.rn, CASE WHEN s.s_acctbal - f.leader < 500 THEN f.leader ELSE s.s_acctbal END
        FROM f JOIN s ON s.s_nationkey = f.s_nationkey AND s.rn = f.rn + 1
    )
    SELECT s_nationkey, s_suppkey, leader FROM f
""")
def leader_cluster(spark, d):
    led = cluster.leader_clusters(_t(spark, d, "supplier"), ["s_nationkey"], F.col("s_acctbal"), ["s_suppkey"], 500)
    return led.select("s_nationkey", "s_suppkey", "leader")


@query("""
    WITH n AS (SELECT user_id, event_id, value, ts, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER w AS nth,
                      avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, round(CASE WHEN n > 5 AND nth > 2 AND nth <= n - 2 THEN m ELSE value END, 6) AS smooth FROM n
""")
def smooth_polyline(spark, d):
    s = ordered.smooth(_t(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"], 5)
    return s.select("user_id", "event_id", _r("value_smooth").alias("smooth"))


@query("""
    SELECT l_suppkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
           CASE WHEN regr_sxx(l_extendedprice, l_quantity) < 1e-6 THEN TRUE ELSE abs(degrees(atan(regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)))) BETWEEN 75 AND 105 END AS vertical,
           CASE WHEN count(*) < 3 OR regr_sxx(l_extendedprice, l_quantity) < 1e-6 THEN FALSE ELSE abs(degrees(atan(regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)))) <= 45 END AS horizontal
    FROM lineitem GROUP BY l_suppkey
""")
def line_fit(spark, d):
    f = fit.line_fit(_t(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_extendedprice"))
    return f.select("l_suppkey", "n", _r("slope", 4).alias("slope"), _r("intercept", 3).alias("intercept"), g.is_vertical(F.col("sxx"), F.col("sxy")).alias("vertical"), g.is_horizontal(F.col("n"), F.col("sxx"), F.col("sxy")).alias("horizontal"))


@query("""
    WITH m AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY l_suppkey),
    s AS (SELECT l_suppkey, any_value(m) AS m, CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(y) AS t0, sum(u*y) AS t1, sum(u*u*y) AS t2
          FROM (SELECT l.l_suppkey, m.m, l_quantity - m.m AS u, l_extendedprice AS y FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey) GROUP BY l_suppkey),
    d AS (SELECT *, s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2) AS w,
                 t2*(s2*n-s1*s1) - s3*(t1*n-s1*t0) + s2*(t1*s1-s2*t0) AS da,
                 s4*(t1*n-s1*t0) - t2*(s3*n-s1*s2) + s2*(s3*t0-t1*s2) AS db,
                 s4*(s2*t0-t1*s1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2) AS dc FROM s)
    SELECT l_suppkey, CAST(n AS BIGINT) AS n, round(da/w, 3) AS a, round(db/w - 2*da/w*m, 1) AS b FROM d WHERE abs(w) > 1e-9 * greatest(1.0, s4*s2*n)
""")
def quad_fit(spark, d):
    f = fit.quadratic_fit(_t(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity"), F.col("l_extendedprice"))
    return f.where("a is not null").select("l_suppkey", "n", _r("a", 3).alias("a"), _r("b", 1).alias("b"))


@query("""
    WITH h AS (SELECT event_type, CAST(floor(value) AS INT) AS level, count(*) AS n FROM events GROUP BY 1, 2),
    c AS (SELECT event_type, level, sum(n) OVER u AS n0, sum(n) OVER p AS n, sum(n*level) OVER u AS s0, sum(n*level) OVER p AS s FROM h
          WINDOW u AS (PARTITION BY event_type ORDER BY level ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY event_type)),
    v AS (SELECT *, CASE WHEN n > n0 THEN round(CAST(n0*(n-n0) AS DOUBLE) * (s0/n0 - (s-s0)/(n-n0)) * (s0/n0 - (s-s0)/(n-n0)), 3) ELSE 0 END AS between_ FROM c)
    SELECT event_type, arg_max(level, (between_, -level)) AS threshold FROM v GROUP BY event_type
""")
def otsu(spark, d):
    return fit.otsu(_t(spark, d, "events"), ["event_type"], F.floor("value"))


_CONFUSION = """
    WITH v AS (SELECT doc_id % 10 AS sheet, unnest(CASE WHEN quality = toxic THEN [{'cls': quality, 'role': 'tp'}] ELSE [{'cls': toxic, 'role': 'fp'}, {'cls': quality, 'role': 'fn'}] END) AS r FROM labels),
    c AS (SELECT sheet, r.cls AS cls, CAST(count(*) FILTER (r.role = 'tp') AS BIGINT) AS tp, CAST(count(*) FILTER (r.role = 'fp') AS BIGINT) AS fp, CAST(count(*) FILTER (r.role = 'fn') AS BIGINT) AS fn
          FROM v GROUP BY GROUPING SETS ((sheet, cls), (cls)))
"""
_SCORES = """round(CASE WHEN tp+fp = 0 THEN 0 ELSE tp / CAST(tp+fp AS DOUBLE) END, 6) AS "precision", round(CASE WHEN tp+fn = 0 THEN 0 ELSE tp / CAST(tp+fn AS DOUBLE) END, 6) AS recall,
             round(CASE WHEN tp+fp+fn = 0 THEN 0 ELSE tp / CAST(tp+fp+fn AS DOUBLE) END, 6) AS iou, round(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp / CAST(2*tp+fp+fn AS DOUBLE) END, 6) AS dice"""


def _confused(spark, d):
    return metrics.confusion(_t(spark, d, "labels").withColumn("sheet", F.col("doc_id") % 10), ["sheet"], "quality", "toxic")


@query(f"{_CONFUSION} SELECT sheet, cls, tp, fp, fn, {_SCORES} FROM c")
def confusion(spark, d):
    s = metrics.scores(_confused(spark, d))
    return s.select("sheet", "cls", "tp", "fp", "fn", *[_r(c).alias(c) for c in ("precision", "recall", "iou", "dice")])


@query(f"{_CONFUSION} SELECT sheet, round(avg(CASE WHEN tp+fp+fn > 0 THEN tp / CAST(tp+fp+fn AS DOUBLE) END), 6) AS miou FROM c WHERE cls > 0 AND tp+fp+fn > 0 GROUP BY sheet")
def micro_avg(spark, d):
    return metrics.foreground_miou(_confused(spark, d), ["sheet"]).select("sheet", _r("miou").alias("miou"))


_BOX_SQL = "SELECT s_nationkey AS sheet, s_acctbal AS x0, s_acctbal + 400 AS x1, s_suppkey * 53 % 1000 AS y0, s_suppkey * 53 % 1000 + 400 AS y1 FROM supplier"


def _boxes(spark, d):
    """Suppliers of a nation as boxes: balance along x, key along y."""
    s = _t(spark, d, "supplier")
    y = (F.col("s_suppkey") * 53 % 1000).cast("double")
    return s.select(F.col("s_nationkey").alias("sheet"), F.col("s_acctbal").alias("x_min"), (F.col("s_acctbal") + 400).alias("x_max"), y.alias("y_min"), (y + 400).alias("y_max"))


@query(f"""
    WITH b AS ({_BOX_SQL}),
    l AS (SELECT c_custkey, c_nationkey AS sheet, c_acctbal AS x0, c_acctbal + c_custkey % 7 AS x1, c_custkey * 37 % 1000 AS y0, c_custkey * 37 % 1000 + 50 + c_custkey % 300 AS y1 FROM customer)
    SELECT c_custkey FROM l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sheet = l.sheet
        AND greatest(0, least(l.x1, b.x1) - greatest(l.x0, b.x0)) * greatest(0, least(l.y1, b.y1) - greatest(l.y0, b.y0)) / (greatest(1, l.x1 - l.x0) * greatest(1, l.y1 - l.y0)) > 0.5)
""")
def inset_anti(spark, d):
    c = _t(spark, d, "customer")
    y = (F.col("c_custkey") * 37 % 1000).cast("double")
    l = c.select("c_custkey", F.col("c_nationkey").alias("sheet"), F.col("c_acctbal").alias("x_min"), (F.col("c_acctbal") + F.col("c_custkey") % 7).alias("x_max"), y.alias("y_min"), (y + 50 + F.col("c_custkey") % 300).alias("y_max"))
    return joins.inset_anti(l, _boxes(spark, d), ["sheet"]).select("c_custkey")


@query(f"""
    WITH b AS ({_BOX_SQL})
    SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.sheet = c.c_nationkey AND c.c_acctbal BETWEEN b.x0 - 18 AND b.x1 + 18 AND c.c_custkey * 37 % 1000 BETWEEN b.y0 - 18 AND b.y1 + 18)
""")
def point_in_box_anti(spark, d):
    p = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("sheet"), F.col("c_acctbal").alias("cx"), (F.col("c_custkey") * 37 % 1000).cast("double").alias("cy"))
    return joins.point_in_box_anti(p, _boxes(spark, d), ["sheet"]).select("c_custkey")


@query("""
    WITH c AS (SELECT c_nationkey AS k, c_custkey, c_acctbal AS a, c_acctbal + c_custkey % 40 AS b FROM customer),
    s AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal AS a, s_acctbal + s_suppkey % 90 AS b FROM supplier)
    SELECT c.k AS nation, c_custkey, s_suppkey, round(greatest(c.a, s.a), 2) AS lo, round(least(c.b, s.b), 2) AS hi FROM c JOIN s ON c.k = s.k AND greatest(c.a, s.a) <= least(c.b, s.b)
""")
def interval_overlap(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_acctbal") + F.col("c_custkey") % 40).alias("b"))
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("sa"), (F.col("s_acctbal") + F.col("s_suppkey") % 90).alias("sb"))
    return joins.interval_overlap(c, s, ["nation"], "a", "b", "sa", "sb", 100.0).select("nation", "c_custkey", "s_suppkey", _r("lo", 2).alias("lo"), _r("hi", 2).alias("hi"))


@query("""
    WITH p AS (SELECT c_custkey, c_nationkey AS k, c_acctbal AS v, s_suppkey, s_acctbal AS c, abs(c_acctbal - s_acctbal) AS dist FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) < 150)
    SELECT k AS nation, c_custkey, s_suppkey, round(dist, 4) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dist, s_suppkey) = 1
""")
def nearest_center(spark, d):
    v = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    c = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    m = joins.nearest_centre(v, c, ["nation"], F.col("c_acctbal"), "s_acctbal", "s_suppkey", ["c_custkey"], 150.0)
    return m.select("nation", "c_custkey", "s_suppkey", _r("distance", 4).alias("distance"))


@query("""
    WITH RECURSIVE p AS (SELECT c_nationkey AS k, c_custkey AS l, s_suppkey AS r, abs(c_acctbal - s_acctbal) AS dist,
                                row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(c_acctbal - s_acctbal), c_custkey, s_suppkey) AS rn
                         FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 180),
    f AS (
        SELECT k, rn, [l] AS ls, [r] AS rs, TRUE AS took FROM p WHERE rn = 1
        UNION ALL
        SELECT p.k, p.rn, CASE WHEN ok THEN list_append(f.ls, p.l) ELSE f.ls END, CASE WHEN ok THEN list_append(f.rs, p.r) ELSE f.rs END, ok
        FROM f JOIN p ON p.k = f.k AND p.rn = f.rn + 1, LATERAL (SELECT NOT list_contains(f.ls, p.l) AND NOT list_contains(f.rs, p.r) AS ok)
    )
    SELECT p.k AS nation, p.l AS c_custkey, p.r AS s_suppkey, round(p.dist, 4) AS distance FROM f JOIN p ON p.k = f.k AND p.rn = f.rn WHERE f.took
""")
def greedy_match(spark, d):
    l = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    r = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    m = joins.greedy_match(l, r, ["nation"], "c_acctbal", "s_acctbal", "c_custkey", "s_suppkey", 180.0)
    return m.select("nation", F.col("l_id").alias("c_custkey"), F.col("r_id").alias("s_suppkey"), _r("distance", 4).alias("distance"))


@query("""
    WITH v AS (SELECT s_nationkey AS k, s_acctbal AS x1, CAST(s_suppkey AS DOUBLE) AS y1, lead(s_acctbal) OVER w AS x2, CAST(lead(s_suppkey) OVER w AS DOUBLE) AS y2 FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)),
    s AS (SELECT n_nationkey AS k, CAST(x AS DOUBLE) AS "at" FROM nation, range(-900, 9900, 450) r(x))
    SELECT s.k AS nation, s.at AS "at", round(CASE WHEN v.x1 = v.x2 THEN v.y1 ELSE v.y1 + (s.at - v.x1) / (v.x2 - v.x1) * (v.y2 - v.y1) END, 6) AS value
    FROM s LEFT JOIN v ON v.k = s.k AND v.x2 IS NOT NULL AND s.at BETWEEN v.x1 AND v.x2 QUALIFY row_number() OVER (PARTITION BY s.k, s.at ORDER BY v.x1, v.x2, v.y1, v.y2) = 1
""")
def interp(spark, d):
    v = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"), "s_suppkey")
    s = _t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.sequence(F.lit(-900), F.lit(9899), F.lit(450))).alias("i")).select("nation", F.col("i").cast("double").alias("at"))
    return joins.interpolate(s, v, ["nation"], "at", "x", "y", ["s_suppkey"]).select("nation", "at", _r("value").alias("value"))


_SHEET_SQL = """
    v AS (SELECT sheet, p_partkey, CAST(100.37 AS DOUBLE) * (p_partkey % 20) AS x1, CAST(100.37 AS DOUBLE) * (p_partkey % 20) + CAST(1.03 AS DOUBLE) * p_size AS x2, CAST(0 AS DOUBLE) AS y1, CAST(500.13 AS DOUBLE) + p_size * CAST(10.7 AS DOUBLE) AS y2, CAST(60 + p_partkey % 20 AS DOUBLE) AS lon FROM parts WHERE p_partkey % 2 = 0),
    h AS (SELECT sheet, p_partkey AS h_key, CAST(20.29 AS DOUBLE) * (p_partkey % 30) AS ya, CAST(20.29 AS DOUBLE) * (p_partkey % 30) + CAST(0.91 AS DOUBLE) * p_size AS yb, CAST(10 + p_partkey % 30 AS DOUBLE) AS lat FROM parts WHERE p_partkey % 2 = 1)
"""


def _sheet(spark, d):
    """Twenty parts as a sheet: even keys are meridians, odd ones parallels; odd factors keep values off the halves that rounding splits."""
    p = _t(spark, d, "part").withColumn("sheet", F.floor(F.col("p_partkey") / 20).cast("long"))
    k = F.col("p_partkey")
    x = 100.37 * (k % 20)
    v = p.where(k % 2 == 0).select("sheet", F.array(g.point(x, F.lit(0)), g.point(x + 1.03 * F.col("p_size"), 500.13 + F.col("p_size") * 10.7)).alias("points"), (60 + k % 20).cast("double").alias("degree"))
    y = 20.29 * (k % 30)
    h = p.where(k % 2 == 1).select("sheet", F.array(g.point(F.lit(0), y), g.point(F.lit(1000), y + 0.91 * F.col("p_size")), g.point(F.lit(2000), y)).alias("points"), (10 + k % 30).cast("double").alias("degree"))
    return v, h


@query(f"""
    WITH RECURSIVE parts AS (SELECT p_partkey // 20 AS sheet, p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part), {_SHEET_SQL},
    j AS (SELECT v.sheet, p_partkey, h_key, lon, lat, x1, x2, y2, ya, yb, (greatest(y1, ya) + least(y2, yb)) / 2 AS y0 FROM v JOIN h ON v.sheet = h.sheet AND y1 <= yb AND ya <= y2),
    f AS (
        SELECT *, y0 AS y, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py, FALSE AS done, 0 AS i FROM j
        UNION ALL
        SELECT * EXCLUDE (y, px, py, done, i, x, yn),
               CASE WHEN yn IS NULL THEN y ELSE yn END, CASE WHEN abs(yn - y) < 0.5 AND yn BETWEEN 0 AND y2 THEN x END, CASE WHEN abs(yn - y) < 0.5 AND yn BETWEEN 0 AND y2 THEN yn END,
               yn IS NULL OR abs(yn - y) < 0.5, i + 1
        FROM (SELECT *, CASE WHEN x BETWEEN 0 AND 1000 THEN ya + x / 1000.0 * (yb - ya) WHEN x BETWEEN 1000 AND 2000 THEN yb + (x - 1000.0) / 1000.0 * (ya - yb) END AS yn
              FROM (SELECT *, x1 + y / y2 * (x2 - x1) AS x FROM f WHERE NOT done AND i < 30))
    )
    SELECT sheet, lon, lat, round_even(px, 2) AS pixel_x, round_even(py, 2) AS pixel_y FROM f WHERE px IS NOT NULL
""")
def intersections(spark, d):
    v, h = _sheet(spark, d)
    return gcp.intersections(v, h, ["sheet"])


@query("""
    WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS rank FROM part)
    SELECT p_brand, p_partkey, rank, round_even(92.0 + (rank - 1) * ((104.0 - 92.0) / 4 + (110.0 - 104.0) / 3) / 2, 0) AS degree, rank IN (1, 5, 8) AS confirmed FROM r
""")
def degree_assign(spark, d):
    spec = t.anchors(F.lit("v:1=92,5=104,8=110;h:2=52,3=48"), "v")
    return ordered.assign_degrees(_t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], ["p_retailprice", "p_partkey"], spec).select("p_brand", "p_partkey", "rank", "degree", "confirmed")


@query("""
    WITH s AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n, s_suppkey FROM supplier),
    ps AS (SELECT s_nationkey * 1000000 + n // 8 AS k, n % 8 AS i, 100.0 + 4 * (n % 8) + CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 ELSE 0 END AS dg FROM s),
    pairs AS (SELECT a.k, a.i AS ai, b.i AS bi, a.dg AS base, (b.dg - a.dg) / (b.i - a.i) AS step FROM ps a JOIN ps b ON a.k = b.k AND a.i < b.i WHERE abs((b.dg - a.dg) / (b.i - a.i)) > 1e-9),
    e AS (SELECT p.k, p.ai, p.bi, q.i, q.dg, base + (q.i - p.ai) * step AS raw, round_even(base + (q.i - p.ai) * step, CASE WHEN abs(step) >= 1 THEN 0 ELSE 1 END) AS est FROM pairs p JOIN ps q ON p.k = q.k),
    w AS (SELECT k, ai, bi, count(*) AS n, round(10 * stddev_pop(est - raw) - 0.5 * count(*), 9) AS score FROM e WHERE abs(est - dg) <= 0.51 GROUP BY k, ai, bi HAVING count(*) >= 3),
    best AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY score, ai, bi) = 1)
    SELECT e.k AS sheet, e.i AS idx, e.est AS degree FROM e JOIN best b ON e.k = b.k AND e.ai = b.ai AND e.bi = b.bi WHERE abs(est - dg) <= 0.51
    UNION ALL SELECT k, i, dg FROM ps WHERE k NOT IN (SELECT k FROM best)
""")
def ap_consensus(spark, d):
    """A sheet has eight suppliers of a nation as lines."""
    from pyspark.sql import Window

    s = _t(spark, d, "supplier").withColumn("n", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    s = s.select((F.col("s_nationkey") * 1000000 + F.floor(F.col("n") / 8)).cast("long").alias("sheet"), (F.col("n") % 8).alias("idx"), "s_suppkey")
    noisy = s.select("sheet", "idx", (100.0 + 4 * F.col("idx") + F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 5).otherwise(0)).alias("degree"))
    return fit.progression_consensus(noisy, ["sheet"], "idx", "degree").select("sheet", F.col("idx").cast("long").alias("idx"), "degree")


_SEGMENT_SQL = """e AS (SELECT user_id, event_id, value AS x2, CAST(event_id % 500 AS DOUBLE) AS y2, lag(value) OVER w AS x1, CAST(lag(event_id) OVER w % 500 AS DOUBLE) AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _event_segments(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    y = (F.col("event_id") % 500).cast("double")
    e = _t(spark, d, "events").select("user_id", "event_id", F.col("value").alias("x2"), y.alias("y2"), F.lag("value").over(by).alias("x1"), F.lag(y).over(by).alias("y1"))
    return e.where("x1 is not null")


@query(f"""
    WITH {_SEGMENT_SQL},
    p AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM e WHERE x1 IS NOT NULL),
    q AS (SELECT *, greatest(0.0, CASE WHEN -dx < 0 THEN (x1-20)/(-dx) END, CASE WHEN dx < 0 THEN (150-x1)/dx END, CASE WHEN -dy < 0 THEN (y1-50)/(-dy) END, CASE WHEN dy < 0 THEN (400-y1)/dy END) AS a,
                 least(1.0, CASE WHEN -dx > 0 THEN (x1-20)/(-dx) END, CASE WHEN dx > 0 THEN (150-x1)/dx END, CASE WHEN -dy > 0 THEN (y1-50)/(-dy) END, CASE WHEN dy > 0 THEN (400-y1)/dy END) AS b,
                 (dx = 0 AND (x1 < 20 OR x1 > 150)) OR (dy = 0 AND (y1 < 50 OR y1 > 400)) AS out_ FROM p)
    SELECT user_id, event_id, round(x1+a*dx + 1e-9, 5) AS cx1, round(y1+a*dy + 1e-9, 5) AS cy1, round(x1+b*dx + 1e-9, 5) AS cx2, round(y1+b*dy + 1e-9, 5) AS cy2 FROM q WHERE NOT out_ AND a <= b
""")
def clip_segments(spark, d):
    c = g.clipped(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(20.0), F.lit(50.0), F.lit(150.0), F.lit(400.0))
    s = _event_segments(spark, d).withColumn("c", c).where("c is not null")
    return s.select("user_id", "event_id", *[_r(F.col(f"c.{k}") + 1e-9, 5).alias(f"c{k}") for k in ("x1", "y1", "x2", "y2")])


@query("""
    WITH i AS (SELECT p_partkey, 300 + p_size * 40 AS w, 200 + p_size * 30 AS h FROM part)
    SELECT p_partkey, CAST(r AS INT) AS "row", CAST(c AS INT) AS col, CAST(c * 256 AS INT) AS x0, CAST(r * 256 AS INT) AS y0
    FROM (SELECT *, unnest(range(greatest(1, CAST(ceil((w - 512) / 256.0) AS INT) + 1))) AS c FROM (SELECT *, unnest(range(greatest(1, CAST(ceil((h - 512) / 256.0) AS INT) + 1))) AS r FROM i))
""")
def tile_grid(spark, d):
    i = _t(spark, d, "part").select("p_partkey", (300 + F.col("p_size") * 40).alias("width"), (200 + F.col("p_size") * 30).alias("height"))
    return metrics.tile_grid(i).select("p_partkey", "row", "col", F.col("x0").cast("int").alias("x0"), F.col("y0").cast("int").alias("y0"))


@query("""
    SELECT event_id, r, c, round(CASE WHEN dr < 4 AND dc < 4 THEN greatest(dr, dc) + 1 WHEN dr < 4 THEN dr + 1 WHEN dc < 4 THEN dc + 1 ELSE 5 END / 5.0, 9) AS linear,
           round(exp(-((r-7.5)*(r-7.5) + (c-7.5)*(c-7.5)) / (2 * (16/6.0) * (16/6.0))), 9) AS gaussian, round(least(1.0, (dr + 1) / 4.0) * least(1.0, (dc + 1) / 4.0), 9) AS ramp
    FROM (SELECT *, least(r, 15 - r) AS dr, least(c, 15 - c) AS dc FROM (SELECT event_id, CAST(floor(value) AS INT) % 16 AS r, CAST(event_id * 7 % 16 AS INT) AS c FROM events))
""")
def blend_weights(spark, d):
    """Weights of the place that each event takes in a tile of 16 x 16."""
    r, c = F.col("r"), F.col("c")
    px = _t(spark, d, "events").select("event_id", (F.floor("value").cast("int") % 16).alias("r"), (F.col("event_id") * 7 % 16).cast("int").alias("c"))
    return px.select("event_id", "r", "c", _r(metrics.linear_weight(r, c, 16), 9).alias("linear"), _r(metrics.gaussian_weight(r, c, 16), 9).alias("gaussian"), _r(metrics.ramp_weight(r, c, 16, 4), 9).alias("ramp"))


@query("""
    WITH w AS (SELECT user_id, length(event_type) AS cls, value AS p, 1 + event_id % 5 AS w FROM events),
    m AS (SELECT user_id, cls, sum(w*p) / greatest(sum(w), 1e-6) AS p FROM w GROUP BY user_id, cls)
    SELECT user_id, arg_max(cls, (round(p, 9), -cls)) AS cls, round(max(p), 6) AS p FROM m GROUP BY user_id
""")
def weighted_blend(spark, d):
    e = _t(spark, d, "events").select("user_id", F.char_length("event_type").alias("cls"), F.col("value").alias("prob"), (1 + F.col("event_id") % 5).alias("weight"))
    return metrics.blend(e, ["user_id"]).select("user_id", "cls", _r("p").alias("p"))


@query(f"""
    WITH {_SEGMENT_SQL},
    n AS (SELECT *, greatest(1, CAST(ceil(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) / 25.0) AS INT)) AS k FROM e WHERE x1 IS NOT NULL)
    SELECT user_id, event_id, CAST(i AS INT) AS i, round(x1 + (x2-x1) * i / k + 1e-9, 5) AS x, round(y1 + (y2-y1) * i / k + 1e-9, 5) AS y FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM n)
""")
def densify(spark, d):
    s = _event_segments(spark, d).withColumn("p", g.densified(F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2"))), 25.0))
    return s.select("user_id", "event_id", F.posexplode("p").alias("i", "q")).select("user_id", "event_id", "i", _r(F.col("q.x") + 1e-9, 5).alias("x"), _r(F.col("q.y") + 1e-9, 5).alias("y"))


def _normal_equations(terms: list[str], targets: list[str], source: str) -> str:
    """SQL of a least-squares fit: CTEs of the normal equations and of each step of their elimination; the last, g{n}, holds
    the coefficient of term i for target t as a{n}_i_{n + t}."""
    n, right = len(terms), len(terms) + len(targets)
    steps = ["g0 AS (SELECT " + ", ".join(f"sum({x} * {y}) AS a0_{i}_{j}" for i, x in enumerate(terms) for j, y in enumerate([*terms, *targets])) + f" FROM {source})"]
    for p in range(n):
        row = lambda i, j: f"a{p}_{p}_{j} / a{p}_{p}_{p}" if i == p else f"a{p}_{i}_{j} - a{p}_{i}_{p} * a{p}_{p}_{j} / a{p}_{p}_{p}"  # noqa: B023, E731
        steps.append(f"g{p + 1} AS (SELECT " + ", ".join(f"{row(i, j)} AS a{p + 1}_{i}_{j}" for i in range(n) for j in range(right)) + f" FROM g{p})")
    return ", ".join(steps)


_PLANE = ["1.0", "u", "v", "u * u", "u * v", "v * v"]
_FITTED = [" + ".join(f"a6_{i}_{6 + k} * {term}" for i, term in enumerate(_PLANE)) for k in (0, 1)]


@query(f"""
    WITH m AS (SELECT avg(l_quantity) AS mu, avg(l_discount) AS mv, stddev_pop(l_quantity) AS su, stddev_pop(l_discount) AS sv FROM lineitem),
    z AS (SELECT l_orderkey, (l_quantity - mu) / su AS u, (l_discount - mv) / sv AS v, CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS y FROM lineitem, m),
    {_normal_equations(_PLANE, ["x", "y"], "z")}
    SELECT l_orderkey % 10 AS part, round(avg(sqrt(({_FITTED[0]} - x) ** 2 + ({_FITTED[1]} - y) ** 2)), 3) AS residual FROM z, g6 GROUP BY 1
""")
def poly2_fit(spark, d):
    pts = _t(spark, d, "lineitem").select(F.col("l_quantity").alias("lon"), F.col("l_discount").alias("lat"), F.col("l_extendedprice").alias("pixel_x"), F.col("l_tax").alias("pixel_y"), "l_orderkey")
    res = fit.plane_residuals(pts, fit.plane_fit(pts))
    return res.groupBy((F.col("l_orderkey") % 10).alias("part")).agg(_r(F.avg("residual"), 3).alias("residual"))


@query("""
    WITH f AS (SELECT doc_id, translate(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'OQDIl|！ZSBGgATYb。，, ', '000111125869474' || '6...') AS s FROM documents)
    SELECT doc_id, len(n) AS n, round(coalesce(list_sum(list_filter(n, lambda v: v BETWEEN 60 AND 150)), 0), 3) AS lon, CAST(len(list_filter(n, lambda v: v BETWEEN 10 AND 61)) AS BIGINT) AS lats
    FROM (SELECT doc_id, list_transform(regexp_extract_all(s, '[0-9]+(\\.[0-9]+)?'), lambda v: CAST(v AS DOUBLE)) AS n FROM f)
""")
def text_numbers(spark, d):
    s = _t(spark, d, "documents").select("doc_id", F.col("text"))
    lon = F.aggregate(t.degree_candidates(F.col("text"), "lon"), F.lit(0.0), lambda a, v: a + v)
    return s.select("doc_id", F.size(t.numbers(t.repaired(F.col("text")))).cast("long").alias("n"), _r(lon, 3).alias("lon"), F.size(t.degree_candidates(F.col("text"), "lat")).cast("long").alias("lats"))


@query("""
    WITH p AS (SELECT page_id, split_part(split_part(url, '/', 3), '.', 1) AS prefix FROM pages WHERE split_part(split_part(url, '/', 3), '.', 1) NOT IN (SELECT lower(n_name) FROM nation))
    SELECT prefix, min(page_id) AS page_id, count(*) AS n FROM p GROUP BY prefix
""")
def prefix_sample(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).alias("prefix"))
    used = _t(spark, d, "nation").select(F.lower("n_name").alias("prefix"))
    return joins.without(p, used, "prefix").groupBy("prefix").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_quantity DESC, l_extendedprice, l_discount, l_linenumber, l_partkey, l_suppkey, l_tax, l_shipdate) - 1 AS position FROM lineitem
""")
def shape_sort(spark, d):
    l = _t(spark, d, "lineitem").withColumn("ix", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_shipdate"))
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    s = ordered.sort_shapes(l, ["l_orderkey"], rank, (F.col("l_extendedprice"), F.col("l_discount")), "ix", length=F.col("l_quantity"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "position")


@query("""
    WITH a AS (SELECT p_brand, p_type, CAST(sum(p_size) AS BIGINT) AS area FROM part GROUP BY p_brand, p_type)
    SELECT p_brand, p_type, area, row_number() OVER (PARTITION BY p_brand ORDER BY area DESC, p_type) - 1 AS group_id FROM a WHERE area >= 20
""")
def region_rank(spark, d):
    a = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").alias("area"))
    return ordered.rank_regions(a, ["p_brand"], F.col("area"), ["p_type"], F.lit(20)).select("p_brand", "p_type", "area", "group_id")


_COMPONENT_SQL = """
    WITH RECURSIVE e AS ({edges}),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, component) USING KEY (id) AS (
        SELECT DISTINCT a, a FROM u
        UNION SELECT u.a, min(r.component) FROM r JOIN u ON r.id = u.b JOIN recurring.r AS own ON own.id = u.a WHERE r.component < own.component GROUP BY u.a)
    SELECT id, component FROM r
"""


@query(_COMPONENT_SQL.format(edges="SELECT DISTINCT o_orderkey AS a, 2 * o_orderkey + o_custkey % 2 AS b FROM orders"))
def components(spark, d):
    """Orders joined to the order of about twice their key: paths that double."""
    e = _t(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (2 * F.col("o_orderkey") + F.col("o_custkey") % 2).alias("b"))
    return linework.components(e)


@query(_COMPONENT_SQL.format(edges="SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem"))
def components_all(spark, d):
    e = _t(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return linework.components(e)


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events""")
def json_flags(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return _t(spark, d, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@query("""
    WITH e AS (SELECT c_nationkey AS k, least(o_custkey, o_orderkey % 200) AS a, greatest(o_custkey, o_orderkey % 200) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey <> o_orderkey % 200)
    SELECT k, a, b FROM e GROUP BY k, a, b HAVING count(*) % 2 = 1
""")
def dissolve_edges(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = F.col("o_orderkey") % 200
    e = o.where(F.col("o_custkey") != x).select(F.col("c_nationkey").alias("k"), F.least("o_custkey", x).alias("a"), F.greatest("o_custkey", x).alias("b"))
    return linework.dissolve(e, ["k"])


@query("""
    WITH p AS (SELECT DISTINCT o_orderstatus || o_custkey % 3 AS k, o_orderkey AS x FROM orders),
    q AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM p)
    SELECT k, min(x) AS "start", max(x) AS "end", count(*) AS length FROM q GROUP BY k, g HAVING count(*) >= 2
""")
def run_length(spark, d):
    p = _t(spark, d, "orders").select(F.concat("o_orderstatus", F.col("o_custkey") % 3).alias("k"), F.col("o_orderkey").alias("x"))
    return linework.run_lengths(p, ["k"], "x", 2)


@query("""
    WITH l AS (SELECT c_custkey AS l, c_nationkey AS k, c_acctbal / 10 AS x, CAST(c_custkey % 300 AS DOUBLE) AS y FROM customer), r AS (SELECT s_suppkey AS r, s_nationkey AS k, s_acctbal / 10 AS x, CAST(s_suppkey * 3 % 300 AS DOUBLE) AS y FROM supplier)
    SELECT l.k AS nation, l AS c_custkey, r AS s_suppkey, round(sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y)), 5) AS distance FROM l JOIN r ON l.k = r.k AND sqrt((l.x-r.x)*(l.x-r.x) + (l.y-r.y)*(l.y-r.y)) <= 60
""")
def radius_join(spark, d):
    l = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 300).cast("double").alias("y"))
    r = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", (F.col("s_acctbal") / 10).alias("tx"), (F.col("s_suppkey") * 3 % 300).cast("double").alias("ty"))
    return joins.radius_pairs(l, r, ["nation"], 60.0, "x", "y", "tx", "ty").select("nation", "c_custkey", "s_suppkey", _r("distance", 5).alias("distance"))


@query("""
    WITH p AS (SELECT c_custkey, c_nationkey AS k, c_acctbal AS x, CAST(c_custkey % 100 AS DOUBLE) AS y FROM customer), q AS (SELECT s_nationkey AS k, s_acctbal AS tx, CAST(s_suppkey % 100 AS DOUBLE) AS ty FROM supplier),
    n AS (SELECT p.*, tx, ty FROM p LEFT JOIN q ON p.k = q.k AND sqrt((x-tx)*(x-tx) + (y-ty)*(y-ty)) <= 100 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((x-tx)*(x-tx) + (y-ty)*(y-ty)), tx, ty) = 1)
    SELECT c_custkey, round(coalesce(tx, x), 4) AS x, round(coalesce(ty, y), 4) AS y FROM n
""")
def nearest_snap(spark, d):
    p = _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    q = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("tx"), (F.col("s_suppkey") % 100).cast("double").alias("ty"))
    return joins.snap(p, q, ["nation"], ["c_custkey"], 100.0).select("c_custkey", _r("x", 4).alias("x"), _r("y", 4).alias("y"))


@query("""
    SELECT p_brand, any_value(n) AS n, round(any_value(sp), 4) AS spacing, round(stddev_pop(gap), 4) AS spread, CAST(sum(CASE WHEN gap < 0.3 * sp THEN 1 ELSE 0 END) AS BIGINT) AS tight
    FROM (SELECT p_brand, gap, median(gap) OVER (PARTITION BY p_brand) AS sp, count(*) OVER (PARTITION BY p_brand) AS n FROM (SELECT p_brand, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS gap FROM part)) GROUP BY p_brand
""")
def median_spacing(spark, d):
    from pyspark.sql import Window

    gap = F.col("p_retailprice") - F.lag("p_retailprice").over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"))
    s = _t(spark, d, "part").withColumn("gap", gap)
    m = s.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("sp"))
    return s.join(m, "p_brand").groupBy("p_brand").agg(F.first("n").alias("n"), _r(F.first("sp"), 4).alias("spacing"), _r(F.stddev_pop("gap"), 4).alias("spread"), F.sum(F.when(F.col("gap") < 0.3 * F.col("sp"), 1).otherwise(0)).alias("tight"))


@query("""
    WITH f AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
    SELECT user_id, event_id, v FROM (SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM f) WHERE v IS NOT NULL
""")
def carry_forward(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return ordered.carry_forward(e, ["user_id"], ["ts", "event_id"], "v").select("user_id", "event_id", "v")


@query("""
    WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value > 5 AS ok FROM events)
    SELECT user_id, CAST(min(step) FILTER (NOT ok) - 1 AS BIGINT) AS steps FROM s GROUP BY user_id HAVING min(step) FILTER (NOT ok) > 1
""")
def support_march(spark, d):
    from pyspark.sql import Window

    s = _t(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"), (F.col("value") > 5).alias("ok"))
    broken = s.where("not ok").select("user_id").distinct()
    return ordered.support_march(s, ["user_id"], "step", F.col("ok")).join(broken, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"))


@query("""
    WITH p AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal AS pos, s_suppkey % 17 AS w, s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS gap FROM supplier),
    m AS (SELECT p.*, CASE WHEN count(*) OVER (PARTITION BY k) >= 3 THEN 0.3 * median(gap) OVER (PARTITION BY k) ELSE -1 END AS g, row_number() OVER (PARTITION BY k ORDER BY pos, s_suppkey) AS rn FROM p),
    f AS (WITH RECURSIVE r AS (
            SELECT k, rn, pos, w, s_suppkey, 1 AS slot FROM m WHERE rn = 1
            UNION ALL
            SELECT m.k, m.rn, CASE WHEN m.pos - r.pos >= m.g OR m.w > r.w THEN m.pos ELSE r.pos END, CASE WHEN m.pos - r.pos >= m.g OR m.w > r.w THEN m.w ELSE r.w END,
                   CASE WHEN m.pos - r.pos >= m.g OR m.w > r.w THEN m.s_suppkey ELSE r.s_suppkey END, CASE WHEN m.pos - r.pos >= m.g THEN r.slot + 1 ELSE r.slot END
            FROM r JOIN m ON m.k = r.k AND m.rn = r.rn + 1) SELECT * FROM r)
    SELECT k AS nation, arg_max(s_suppkey, rn) AS s_suppkey FROM f GROUP BY k, slot
""")
def dedup_inliers(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return cluster.dedup_by_spacing(s, ["nation"], F.col("s_acctbal"), F.col("s_suppkey") % 17, ["s_suppkey"]).select("nation", "s_suppkey")


@query("""SELECT l_returnflag AS label, l_linestatus AS kind, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def label_count(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH i AS (SELECT c_custkey, c_name FROM customer), a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS direct, o_custkey + 1 AS stem FROM orders)
    SELECT o_orderkey, coalesce(x.c_name, y.c_name) AS image FROM a LEFT JOIN i x ON x.c_custkey = a.direct LEFT JOIN i y ON y.c_custkey = a.stem WHERE coalesce(x.c_name, y.c_name) IS NOT NULL
""")
def image_match(spark, d):
    i = _t(spark, d, "customer")
    a = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("direct"), (F.col("o_custkey") + 1).alias("stem"))
    by = lambda c: (i.select(F.col("c_custkey").alias(f"k_{c}"), "c_name"), F.col(c) == F.col(f"k_{c}"))
    return joins.first_match(a, [by("direct"), by("stem")], "c_name", "image").select("o_orderkey", "image")


@query("""
    WITH b AS (SELECT p_partkey, 100.0 + p_size * 20 AS x, 50.0 + p_retailprice % 400 AS y FROM part)
    SELECT p_partkey, round(least(greatest(x / 1000, 0), 1), 6) AS nx, round(least(greatest(y / 300, 0), 1), 6) AS ny, CAST(trunc(x) AS INT) AS px FROM b
""")
def normalise_clamp(spark, d):
    pt = F.array(g.point(100.0 + F.col("p_size") * 20, 50.0 + F.col("p_retailprice") % 400))
    n = F.get(g.normalised(pt, F.lit(1000.0), F.lit(300.0)), F.lit(0))
    return _t(spark, d, "part").select("p_partkey", _r(n["x"]).alias("nx"), _r(n["y"]).alias("ny"), F.get(pt, F.lit(0))["x"].cast("int").alias("px"))


@query("""
    WITH v AS (SELECT c_mktsegment AS k, unnest([c_custkey, c_custkey * 2]) AS x FROM customer), w AS (SELECT 'BUILDING' AS k, s_suppkey AS x FROM supplier)
    SELECT k, CAST(x AS BIGINT) AS x, 'union' AS op FROM (SELECT * FROM v UNION SELECT * FROM w)
    UNION ALL SELECT k, x, 'minus' FROM (SELECT * FROM v EXCEPT SELECT * FROM w) UNION ALL SELECT k, x, 'both' FROM (SELECT * FROM v INTERSECT SELECT * FROM w)
    UNION ALL SELECT k, x, 'xor' FROM ((SELECT * FROM v EXCEPT SELECT * FROM w) UNION ALL (SELECT * FROM w EXCEPT SELECT * FROM v))
""")
def overlay_sets(spark, d):
    v = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("k"), F.explode(F.array("c_custkey", F.col("c_custkey") * 2)).alias("x"))
    w = _t(spark, d, "supplier").select(F.lit("BUILDING").alias("k"), F.col("s_suppkey").alias("x"))
    parts = {"union": linework.union_edges(v, w), "minus": linework.difference(v, w), "both": linework.intersection(v, w), "xor": linework.symmetric_difference(v, w)}
    out = None
    for name, p in parts.items():
        p = p.select("k", "x", F.lit(name).alias("op"))
        out = p if out is None else out.unionByName(p)
    return out


_STROKE_SQL = """
    e AS (SELECT user_id, (value * 7) % 100 AS x, (event_id * 13) % 75 + CAST(0.37 AS DOUBLE) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
    v AS (SELECT user_id, n // 4 AS shape, n, x, y FROM e UNION ALL SELECT user_id, n // 4 - 1, n, x, y FROM e WHERE n % 4 = 0 AND n > 0),
    seg AS (SELECT user_id * 1000000 + shape // 16 AS image_id, shape % 16 AS shape_idx, n, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v WINDOW w AS (PARTITION BY user_id, shape ORDER BY n) QUALIFY x2 IS NOT NULL)
"""


def _strokes(spark, d):
    """All events of each user as one line of pixels, cut into shapes of four steps, sixteen shapes to a sheet of 100 x 75."""
    from pyspark.sql import Window

    e = _t(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    at = F.floor(F.col("n") / 4)
    # A shape ends where the next one begins.
    e = e.withColumn("p", g.point((F.col("value") * 7) % 100, (F.col("event_id") * 13) % 75 + 0.37))
    e = e.select("user_id", "n", "p", F.explode(F.when((F.col("n") % 4 == 0) & (F.col("n") > 0), F.array(at - 1, at)).otherwise(F.array(at))).alias("shape"))
    shapes = e.groupBy((F.col("user_id") * 1000000 + F.floor(F.col("shape") / 16)).cast("long").alias("image_id"), (F.col("shape") % 16).alias("shape_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda s: s["p"]).alias("points"))
    return shapes.where(F.size("points") >= 2)


@query(f"""
    WITH {_STROKE_SQL},
    k AS (SELECT *, greatest(1, CAST(ceil(greatest(abs(x2 - x1), abs(y2 - y1)) * 2) AS INT)) AS k FROM seg),
    p AS (SELECT image_id, shape_idx, CAST(round_even(x1 + (x2 - x1) * i / k, 0) AS INT) AS x, CAST(round_even(y1 + (y2 - y1) * i / k, 0) AS INT) AS y FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM k))
    SELECT image_id, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y, CAST(1 + max(shape_idx) % 3 AS INT) AS cls FROM p, range(-1, 2) a(dx), range(-1, 2) b(dy) GROUP BY ALL
""")
def rasterise(spark, d):
    return raster.rasterised(_strokes(spark, d).withColumn("cls", (1 + F.col("shape_idx") % 3).cast("int")), 3)


@query()
def thinning(spark, d):
    return raster.per_drawing(_strokes(spark, d), lambda m: [[(int(x), int(y))] for y, x in raster.np.argwhere(raster.thin(m))], 5).select("image_id", F.get("points", F.lit(0))["x"].alias("x"), F.get("points", F.lit(0))["y"].alias("y"))


@query()
def vectorise(spark, d):
    return raster.per_drawing(_strokes(spark, d), raster.vectorise, 5)


@query()
def dp_simplify(spark, d):
    return raster.per_drawing(_strokes(spark, d), lambda m: [raster.simplify(p, 2.0) for p in raster.trace(raster.thin(m), 5)], 1)


@query()
def chain(spark, d):
    return raster.per_drawing(_strokes(spark, d), lambda m: raster.chain(raster.trace(raster.thin(m), 5), 15.0, 120.0), 1)


@query(f"""
    WITH {_STROKE_SQL},
    l AS (SELECT image_id, shape_idx AS line_id, CAST(1 + shape_idx % 2 AS INT) AS level, list({{'x': x1, 'y': y1}} ORDER BY n) || [arg_max({{'x': x2, 'y': y2}}, n)] AS p FROM seg GROUP BY image_id, shape_idx),
    t AS (SELECT *, 'start' AS side, p[1] AS tip, p[least(3, len(p) - 1) + 1] AS back FROM l UNION ALL SELECT *, 'end', p[len(p)], p[greatest(len(p) - 4, 0) + 1] FROM l),
    ends AS (SELECT image_id, line_id, level, side, tip.x AS x, tip.y AS y, tip.x - back.x AS dx, tip.y - back.y AS dy, sqrt((tip.x - back.x) * (tip.x - back.x) + (tip.y - back.y) * (tip.y - back.y)) AS d FROM t),
    others AS (SELECT image_id, shape_idx AS to_line, CAST(1 + shape_idx % 2 AS INT) AS to_level, x1, y1, x2 - x1 AS ux, y2 - y1 AS uy FROM seg),
    n AS (SELECT ends.*, to_line, to_level, x1, y1, ux, uy, least(greatest(coalesce(((x - x1) * ux + (y - y1) * uy) / nullif(ux * ux + uy * uy, 0), 0), 0), 1) AS along FROM ends JOIN others ON ends.image_id = others.image_id AND line_id <> to_line),
    c AS (SELECT image_id, line_id, level, side, x, y, dx, dy, d, to_line, to_level, x1 + along * ux AS tx, y1 + along * uy AS ty FROM n
          UNION ALL SELECT image_id, line_id, level, side, x, y, dx, dy, d, -1, 0, w[1], w[2] FROM (SELECT *, unnest([[0.0, y], [99.0, y], [x, 0.0], [x, 74.0]]) AS w FROM ends)),
    m AS (SELECT *, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) AS distance FROM c),
    a AS (SELECT *, CASE WHEN d >= 1e-6 AND distance > 0 THEN degrees(acos(least(1, greatest(-1, (dx / d * (tx - x) + dy / d * (ty - y)) / distance)))) END AS angle FROM m),
    o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY image_id, line_id, side, to_line ORDER BY distance, to_level, angle NULLS FIRST, tx, ty) = 1),
    r AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS second, count(*) FILTER (distance <= 10) OVER g AS within, count(*) FILTER (distance <= 5 AND (to_level = level OR to_line = -1)) OVER g AS own
          FROM o WINDOW w AS (PARTITION BY image_id, line_id, side ORDER BY distance, to_line), g AS (PARTITION BY image_id, line_id, side))
    SELECT image_id, line_id, level, side, round(x, 6) AS x, round(y, 6) AS y, to_line, to_level, round(distance, 6) AS distance, round(angle, 6) AS angle, round(tx, 6) AS tx, round(ty, 6) AS ty, within AS candidates,
           CASE WHEN distance > 10 THEN 'open' WHEN distance <= 5 AND level = 1 AND own = 0 THEN 'review' WHEN distance <= 1.5 THEN 'connected' WHEN distance > 5 THEN 'review'
                WHEN coalesce(second - distance < 2, false) THEN 'ambiguous' WHEN coalesce(angle <= 30, false) THEN 'snappable' ELSE 'review' END AS status
    FROM r WHERE r = 1
""")
def topology_gaps(spark, d):
    # Written, so that ends, segments and frames draw the strokes once.
    lines = materialise(_strokes(spark, d).select("image_id", F.col("shape_idx").alias("line_id"), (1 + F.col("shape_idx") % 2).cast("int").alias("level"), "points"), "strokes")
    frames = lines.select("image_id").distinct().select("image_id", F.lit(0.0).alias("x_min"), F.lit(99.0).alias("x_max"), F.lit(0.0).alias("y_min"), F.lit(74.0).alias("y_max"))
    found = topology.gaps(lines, frames)
    # A negative zero is a zero.
    return found.withColumns({c: _r(F.col(c)) + F.lit(0.0) for c in ("x", "y", "distance", "angle", "tx", "ty")})


@query("""
    WITH d AS (SELECT l_suppkey, l_extendedprice AS x, l_quantity AS y, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, 42)) AS h0, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, 43)) AS h1 FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY h0, x, y) AS n0, row_number() OVER (PARTITION BY l_suppkey ORDER BY h1, x, y) AS n1 FROM d),
    p AS (SELECT a.l_suppkey, a.n0 AS draw, (b.x - a.x) / (b.y - a.y) AS slope, a.x - (b.x - a.x) / (b.y - a.y) * a.y AS intercept FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.n0 = b.n1 WHERE a.n0 <= 30 AND abs(b.y - a.y) >= 5),
    v AS (SELECT p.l_suppkey, draw, slope, intercept, count(*) FILTER (abs(x - (slope * y + intercept)) < 2000) AS votes FROM p JOIN d ON p.l_suppkey = d.l_suppkey GROUP BY ALL),
    b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, draw) = 1),
    f AS (SELECT b.l_suppkey, regr_slope(x, y) AS s, regr_intercept(x, y) AS i FROM b JOIN d ON b.l_suppkey = d.l_suppkey WHERE abs(x - (slope * y + intercept)) < 2000 GROUP BY b.l_suppkey)
    SELECT b.l_suppkey, round(CASE WHEN votes >= 10 AND s IS NOT NULL THEN s ELSE slope END, 4) AS slope, round(CASE WHEN votes >= 10 AND s IS NOT NULL THEN i ELSE intercept END, 3) AS intercept, votes AS inliers FROM b LEFT JOIN f ON b.l_suppkey = f.l_suppkey
""")
def robust_fit(spark, d):
    f = fit.robust_line(_t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"], within=2000.0, apart=5.0, draws=30)
    return f.select("l_suppkey", _r("slope", 4).alias("slope"), _r("intercept", 3).alias("intercept"), "inliers")


@query("""SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 10""")
def longest_lines(spark, d):
    return ordered.top_k(_t(spark, d, "part"), ["p_brand"], 10, F.col("p_retailprice").desc(), F.col("p_partkey")).select("p_brand", "p_partkey", "p_retailprice")


@query(f"""
    WITH {_SEGMENT_SQL}, s AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy, sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) AS d FROM e WHERE x1 IS NOT NULL),
    n AS (SELECT *, CASE WHEN d > 0 THEN -dy / d ELSE 0 END AS nx, CASE WHEN d > 0 THEN dx / d ELSE 1 END AS ny FROM s)
    SELECT user_id, event_id, CAST(trunc(x1 + 3*nx) AS INT) AS ax, CAST(trunc(y1 + 3*ny) AS INT) AS ay, CAST(trunc(x2 + 3*nx) AS INT) AS bx, CAST(trunc(y2 + 3*ny) AS INT) AS by_,
           CAST(trunc(x2 - 3*nx) AS INT) AS cx, CAST(trunc(y2 - 3*ny) AS INT) AS cy, CAST(trunc(x1 - 3*nx) AS INT) AS dx, CAST(trunc(y1 - 3*ny) AS INT) AS dy FROM n
""")
def ribbon(spark, d):
    r = _event_segments(spark, d).withColumn("r", g.ribbon(F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2")))))
    at = lambda k, c: F.get("r", F.lit(k))[c].cast("int")
    return r.select("user_id", "event_id", *[at(k, c).alias(n) for k, c, n in ((0, "x", "ax"), (0, "y", "ay"), (1, "x", "bx"), (1, "y", "by_"), (2, "x", "cx"), (2, "y", "cy"), (3, "x", "dx"), (3, "y", "dy"))])


@query("""
    WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mx, avg(l_extendedprice / 1000) AS my, var_pop(l_quantity) AS vx, var_pop(l_extendedprice / 1000) AS vy, covar_pop(l_quantity, l_extendedprice / 1000) AS c FROM lineitem GROUP BY l_suppkey),
    t AS (SELECT *, atan2(2 * c, vx - vy) / 2 AS t FROM m)
    SELECT l_suppkey, round(least(greatest(mx - 1000 * cos(t), 0), 1999), 3) AS x1, round(least(greatest(my - 1000 * sin(t), 0), 899), 3) AS y1, round(least(greatest(mx + 1000 * cos(t), 0), 1999), 3) AS x2, round(least(greatest(my + 1000 * sin(t), 0), 899), 3) AS y2 FROM t
""")
def full_line(spark, d):
    l = _t(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    p = fit.principal_line(l, ["l_suppkey"], "x", "y", F.lit(2000.0), F.lit(900.0))
    return p.select("l_suppkey", *[_r(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("""
    WITH s AS (SELECT p_brand, (lead(p_retailprice) OVER w - p_retailprice) / (lead(p_partkey) OVER w - p_partkey) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
    SELECT p_brand, round(avg(s), 6) AS "interval", max(s) - min(s) > 0.1 AS inconsistent FROM s GROUP BY p_brand
""")
def anchor_spacing(spark, d):
    s = ordered.spacing_consistency(_t(spark, d, "part"), ["p_brand"], "p_partkey", "p_retailprice")
    return s.select("p_brand", _r("interval").alias("interval"), "inconsistent")


@query("""
    WITH r AS (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS i FROM events GROUP BY user_id, event_type)
    SELECT user_id, arg_max(event_type, (n, -i)) AS best FROM r GROUP BY user_id
""")
def best_row(spark, d):
    from pyspark.sql import Window

    r = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    r = r.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_type")))
    return ordered.argmax_row(r, ["user_id"], F.col("n"), F.col("i"), F.col("event_type"), "best")


@query("""
    WITH h AS (SELECT l_suppkey % 20 AS k, CAST(floor(least(greatest(l_quantity / 5 * 10, 0), 255)) AS INT) AS level, count(*) AS n FROM lineitem GROUP BY 1, 2),
    c AS (SELECT k, level, sum(n) OVER u AS n0, sum(n) OVER p AS n, sum(n*level) OVER u AS s0, sum(n*level) OVER p AS s FROM h WINDOW u AS (PARTITION BY k ORDER BY level ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY k)),
    v AS (SELECT *, CASE WHEN n > n0 THEN round(CAST(n0*(n-n0) AS DOUBLE) * (s0/n0 - (s-s0)/(n-n0)) * (s0/n0 - (s-s0)/(n-n0)), 3) ELSE 0 END AS b FROM c)
    SELECT k, arg_max(level, (b, -level)) / 10.0 AS threshold FROM v GROUP BY k
""")
def width_threshold(spark, d):
    l = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("k"), (F.col("l_quantity") / 5).alias("w"))
    return fit.width_threshold(l, ["k"], "w")


@query("""
    WITH g AS (SELECT user_id, ts, value, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 3600 THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    c AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS "start", count(*) AS n, round(sum(value), 4) AS total FROM c GROUP BY user_id, s
""")
def gap_sessions(spark, d):
    from ..streaming.gaps import gap_sessions as sessions

    s = sessions(_t(spark, d, "events"), ["user_id"], "ts")
    return s.select("user_id", F.unix_timestamp("start").alias("start"), "n", _r("value_sum", 4).alias("total"))


@query("""
    WITH p AS (SELECT p_partkey, 5.0 * p_size AS x, CAST(p_retailprice % 300 AS DOUBLE) AS y, CAST(p_partkey % 7 - 3 AS DOUBLE) AS dx, CAST(p_partkey % 5 - 2 AS DOUBLE) AS dy FROM part),
    u AS (SELECT *, CASE WHEN dx*dx + dy*dy = 0 THEN NULL ELSE dx / sqrt(dx*dx + dy*dy) END AS ux, CASE WHEN dx*dx + dy*dy = 0 THEN NULL ELSE dy / sqrt(dx*dx + dy*dy) END AS uy, x AS l, 399 - x AS r, y AS t, 299 - y AS b FROM p),
    n AS (SELECT *, least(l, r, t, b) AS m FROM u)
    SELECT p_partkey, round(CASE WHEN m > 200 OR ux IS NULL THEN x WHEN l = m AND -ux > 0.3 THEN least(greatest(x + ux * l / -ux, 0), 399) WHEN r = m AND ux > 0.3 THEN least(greatest(x + ux * r / ux, 0), 399)
                                 WHEN t = m AND -uy > 0.3 THEN least(greatest(x + ux * t / -uy, 0), 399) WHEN b = m AND uy > 0.3 THEN least(greatest(x + ux * b / uy, 0), 399) ELSE x END, 4) AS x,
                      round(CASE WHEN m > 200 OR ux IS NULL THEN y WHEN l = m AND -ux > 0.3 THEN least(greatest(y + uy * l / -ux, 0), 299) WHEN r = m AND ux > 0.3 THEN least(greatest(y + uy * r / ux, 0), 299)
                                 WHEN t = m AND -uy > 0.3 THEN least(greatest(y + uy * t / -uy, 0), 299) WHEN b = m AND uy > 0.3 THEN least(greatest(y + uy * b / uy, 0), 299) ELSE y END, 4) AS y FROM n
""")
def extend_to_edge(spark, d):
    p = _t(spark, d, "part").select("p_partkey", (5.0 * F.col("p_size")).alias("x"), (F.col("p_retailprice") % 300).alias("y"), (F.col("p_partkey") % 7 - 3).cast("double").alias("dx"), (F.col("p_partkey") % 5 - 2).cast("double").alias("dy"))
    e = p.withColumn("e", g.extended_to_edge(F.col("x"), F.col("y"), F.col("dx"), F.col("dy"), F.lit(400.0), F.lit(300.0)))
    return e.select("p_partkey", _r("e.x", 4).alias("x"), _r("e.y", 4).alias("y"))


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders), a AS (SELECT o_custkey % 100 AS k, count(*) AS area, min(o_orderkey) AS x_min, max(o_orderkey) AS x_max, round(avg(o_totalprice), 4) AS cy FROM r GROUP BY 1)
    SELECT * FROM a WHERE area > 20
""")
def component_boxes(spark, d):
    o = _t(spark, d, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderkey").alias("x"), F.col("o_totalprice").alias("y"), F.lit(1).alias("c"))
    return linework.component_boxes(o, ["k"], "c", 20).select("k", "area", "x_min", "x_max", _r("cy", 4).alias("cy"))


@query(f"""
    WITH {_STROKE_SQL},
    t AS (SELECT CAST(r AS INT) AS "row", CAST(c AS INT) AS col, c * 32.0 AS x0, r * 32.0 AS y0 FROM range(2) a(r), range(3) b(c)),
    p AS (SELECT s.*, "row", col, x0, y0, x2-x1 AS dx, y2-y1 AS dy FROM seg s CROSS JOIN t),
    q AS (SELECT *, greatest(0.0, CASE WHEN -dx < 0 THEN (x1-x0)/(-dx) END, CASE WHEN dx < 0 THEN (x0+64-x1)/dx END, CASE WHEN -dy < 0 THEN (y1-y0)/(-dy) END, CASE WHEN dy < 0 THEN (y0+64-y1)/dy END) AS a,
                 least(1.0, CASE WHEN -dx > 0 THEN (x1-x0)/(-dx) END, CASE WHEN dx > 0 THEN (x0+64-x1)/dx END, CASE WHEN -dy > 0 THEN (y1-y0)/(-dy) END, CASE WHEN dy > 0 THEN (y0+64-y1)/dy END) AS b,
                 (dx = 0 AND (x1 < x0 OR x1 > x0 + 64)) OR (dy = 0 AND (y1 < y0 OR y1 > y0 + 64)) AS out_ FROM p),
    c AS (SELECT image_id, shape_idx, "row", col, n, x1 + a*dx AS ax, y1 + a*dy AS ay, x1 + b*dx AS bx, y1 + b*dy AS by_ FROM q WHERE NOT out_ AND a <= b),
    o AS (SELECT *, CASE WHEN abs(lag(bx) OVER w - ax) < 1e-6 AND abs(lag(by_) OVER w - ay) < 1e-6 THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY image_id, shape_idx, "row", col ORDER BY n)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY image_id, shape_idx, "row", col ORDER BY n ROWS UNBOUNDED PRECEDING) AS piece FROM o)
    SELECT image_id, shape_idx, "row", col, CAST(count(*) + 1 AS INT) AS n FROM g GROUP BY image_id, shape_idx, "row", col, piece
""")
def tile_clip(spark, d):
    s = _strokes(spark, d)
    size = s.select("image_id").distinct().select("image_id", F.lit(100).alias("width"), F.lit(75).alias("height"))
    tiles = metrics.tile_grid(size, size=64).select("image_id", "row", "col", "x0", "y0")
    return metrics.tile_clip(s, tiles, ["image_id"], 64).select("image_id", "shape_idx", "row", "col", F.size("points").alias("n"))


@query("""
    SELECT split_part(url, '/', 3) AS host, url, page_id FROM pages WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY md5('42|' || url), url, page_id) = 1
""")
def draw_of_prefix(spark, d):
    p = _t(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "url", "page_id")
    return ordered.one_of_each(p, "host", "url")


@query("""
    WITH i AS (SELECT event_id, event_type AS text, CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE (event_id % 100) / 100.0 END AS conf, 1.0 + event_id % 3 AS s, value AS x, CAST(event_id % 300 AS DOUBLE) AS y, event_id % 5 = 0 AS corners FROM events WHERE event_id % 11 <> 0)
    SELECT event_id, text, round((CASE WHEN corners THEN x + 10 ELSE x + 8 END) / s, 6) AS cx, round((CASE WHEN corners THEN y + 2 ELSE y + 1.5 END) / s, 6) AS cy,
           round((CASE WHEN corners THEN 20 ELSE 26 END) / s, 6) AS w, round((CASE WHEN corners THEN 4 ELSE 9 END) / s, 6) AS h, round(conf, 6) AS conf FROM i WHERE conf >= 0.35
""")
def ocr_items(spark, d):
    """Events as recognised texts: boxes of corners and of polygons, some without a box or a confidence."""
    x, y, k = F.col("value"), (F.col("event_id") % 300).cast("double"), F.col("event_id")
    polygon = F.array(x - 5, y, x + 20, y - 3, x + 21, y + 5, x, y + 6)
    e = _t(spark, d, "events").select("event_id", F.col("event_type").alias("text"), F.when(k % 7 != 0, (k % 100) / 100.0).alias("conf"), (1.0 + k % 3).alias("scale"), F.when(k % 11 != 0, F.when(k % 5 == 0, F.array(x, y, x + 20, y + 4)).otherwise(polygon)).alias("box"))
    return ocr.normalised_items(e).select("event_id", "text", *[_r(c).alias(c) for c in ("cx", "cy", "w", "h", "conf")])


@query("""
    WITH l AS (SELECT l_suppkey, l_partkey % 10 AS line, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_discount) * 10 AS conf FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, line, round((hi - lo) / 100000, 9) AS coverage FROM l WHERE conf >= 0.5 AND (hi - lo) / 100000 >= 0.25
""")
def confident_lines(spark, d):
    l = _t(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 10).alias("line")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), (F.avg("l_discount") * 10).alias("conf"))
    c = filters.covering(filters.confident(l), F.col("lo"), F.col("hi"), F.lit(100000.0))
    return c.select("l_suppkey", "line", _r("coverage", 9).alias("coverage"))


_LINE_SQL = "SELECT s_suppkey, s_nationkey, s_acctbal AS x1, CAST(s_suppkey * 7 % 500 AS DOUBLE) AS y1, s_acctbal + 40 AS x2, CAST(s_suppkey * 7 % 500 + 300 AS DOUBLE) AS y2 FROM supplier"


def _short_lines(spark, d):
    y = (F.col("s_suppkey") * 7 % 500).cast("double")
    return _t(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("x1"), y.alias("y1"), (F.col("s_acctbal") + 40).alias("x2"), (y + 300).alias("y2"))


@query(f"""
    WITH l AS ({_LINE_SQL}),
    e AS (SELECT s_nationkey AS k, s_suppkey AS i, unnest([{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}]) AS p FROM l)
    SELECT e.k AS nation, e.i AS a, f.i AS b, round(min(sqrt((e.p.x - f.p.x) ** 2 + (e.p.y - f.p.y) ** 2)), 5) AS distance FROM e JOIN e f ON e.k = f.k AND e.i < f.i
    WHERE sqrt((e.p.x - f.p.x) ** 2 + (e.p.y - f.p.y) ** 2) < 400 GROUP BY e.k, e.i, f.i
""")
def end_distance(spark, d):
    """Pairs of lines of a nation by the distance of their nearest ends."""
    c = instances.close_lines(_short_lines(spark, d), ["s_nationkey"], "s_suppkey", 400.0)
    return c.select(F.col("s_nationkey").alias("nation"), "a", "b", _r("distance", 5).alias("distance"))


@query(f"""
    WITH RECURSIVE l AS ({_LINE_SQL}),
    e AS (SELECT s_nationkey AS k, s_suppkey AS i, unnest([{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y2}}]) AS p FROM l),
    p AS (SELECT DISTINCT e.k, e.i AS a, f.i AS b FROM e JOIN e f ON e.k = f.k AND e.i < f.i WHERE sqrt((e.p.x - f.p.x) ** 2 + (e.p.y - f.p.y) ** 2) < 1500),
    o AS (SELECT s_nationkey AS k, s_suppkey AS i, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM l),
    f AS (
        SELECT k, n, i, [i] AS leaders FROM o WHERE n = 1
        UNION ALL SELECT o.k, o.n, o.i, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.k = o.k AND p.b = o.i AND list_contains(f.leaders, p.a)) THEN f.leaders ELSE list_append(f.leaders, o.i) END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1
    )
    SELECT unnest(leaders) AS s_suppkey FROM f QUALIFY n = max(n) OVER (PARTITION BY k)
""")
def merged_close_lines(spark, d):
    return instances.leading_lines(_short_lines(spark, d), ["s_nationkey"], "s_suppkey", 1500.0).select("s_suppkey")


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT CAST(o_orderkey AS DOUBLE) AS a, CAST(2 * o_orderkey + o_custkey % 2 AS DOUBLE) AS b FROM orders),
    d AS (SELECT n, count(*) AS deg FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n),
    t AS (SELECT e.a, e.b, x.deg = 2 AS open_a, y.deg = 2 AS open_b FROM e JOIN d x ON x.n = a JOIN d y ON y.n = b),
    r AS (SELECT a AS start_, b AS "at", open_b AS goes, 1 AS n FROM t WHERE NOT open_a UNION ALL SELECT r.start_, t.b, t.open_b, r.n + 1 FROM r JOIN t ON t.a = r."at" WHERE r.goes)
    SELECT start_ AS "start", "at" AS "end", CAST(n + 1 AS INT) AS points FROM r WHERE NOT goes
""")
def merged_lines(spark, d):
    """Orders joined to the order of about twice their key: the paths between branchings as lines."""
    x = lambda c: g.point(c, F.lit(0.0))
    e = _t(spark, d, "orders").select(F.lit(1).alias("k"), x(F.col("o_orderkey")).alias("a"), x(2 * F.col("o_orderkey") + F.col("o_custkey") % 2).alias("b"))
    m = linework.merged(e, ["k"])
    return m.select(F.least(F.get("points", F.lit(0))["x"], F.element_at("points", -1)["x"]).alias("start"), F.greatest(F.get("points", F.lit(0))["x"], F.element_at("points", -1)["x"]).alias("end"), F.size("points").alias("points"))


from . import overlay_queries  # noqa: E402, F401  its queries register themselves
