"""The registered queries: each applies operators of this library to the driver's tables, and has its SQL for DuckDB.

The tables hold orders, events and vectors rather than images, so a query adapts an operator to columns of
the same shape (a weight, an error, a coordinate, an undirected pair); names follow the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..functions.expression import apply_expression
from ..operators import coverage, estimation, graph, lens, matching, ranking, relations, statistics
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- lens look-ups


@query("""
WITH m AS (SELECT l_quantity AS k, sum(l_extendedprice * l_linenumber) / sum(l_linenumber) AS v FROM lineitem GROUP BY 1),
n AS (SELECT k, v, row_number() OVER (ORDER BY abs(k - 23.4), k) AS r FROM m),
t AS (SELECT count(*) AS n, max(k) FILTER (r = 1) AS k1, max(v) FILTER (r = 1) AS v1, max(k) FILTER (r = 2) AS k2, max(v) FILTER (r = 2) AS v2 FROM n WHERE r <= 2)
SELECT n = 2 AND (sign(k1 - 23.4) * sign(k2 - 23.4) <= 0 OR abs(23.4 - k1) < 0.15 * 23.4) AS found, round(v1 + (23.4 - k1) / (k2 - k1) * (v2 - v1), 4) AS price FROM t
""")
def lens_lookup_hfov(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("price"), "l_linenumber")
    return lens.look_up(t, "l_quantity", "price", "l_linenumber", 23.4).withColumn("price", F.round("price", 4))


@query("""
SELECT l_suppkey, l_quantity, round(sum(l_extendedprice * l_linenumber) / sum(l_linenumber), 1) AS price, CAST(sum(CAST(l_linenumber AS BIGINT) * l_linenumber) // sum(l_linenumber) AS BIGINT) AS weight
FROM lineitem GROUP BY 1, 2
""")
def lens_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("weight"))
    return statistics.compact(t, "weight", ["price"], "l_suppkey", "l_quantity").withColumn("price", F.round("price", 1))


@query("""
WITH m AS (SELECT l_suppkey, l_quantity AS q, l_discount AS d, sum(l_extendedprice * l_linenumber) / sum(l_linenumber) AS v FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT l_suppkey, q FROM (SELECT l_suppkey, q, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(q - 23.4), q) AS r FROM (SELECT DISTINCT l_suppkey, q FROM m)) WHERE r <= 2),
g AS (SELECT l_suppkey, q, d, v, row_number() OVER (PARTITION BY l_suppkey, q ORDER BY abs(d - 0.043), d) AS r FROM m JOIN f USING (l_suppkey, q)),
l AS (SELECT l_suppkey, q, max(d) FILTER (r = 1) AS d1, max(v) FILTER (r = 1) AS v1, max(d) FILTER (r = 2) AS d2, max(v) FILTER (r = 2) AS v2 FROM g WHERE r <= 2 GROUP BY 1, 2),
w AS (SELECT l_suppkey, q, CASE WHEN d2 IS NULL THEN v1 WHEN abs(d2 - d1) < 1e-4 THEN v1 ELSE v1 + (0.043 - d1) / (d2 - d1) * (v2 - v1) END AS v FROM l),
x AS (SELECT l_suppkey, q, v, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(q - 23.4), q) AS r FROM w),
y AS (SELECT l_suppkey, max(q) FILTER (r = 1) AS k1, max(v) FILTER (r = 1) AS v1, max(q) FILTER (r = 2) AS k2, max(v) FILTER (r = 2) AS v2 FROM x GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN k2 IS NULL THEN v1 WHEN abs(k2 - k1) < 1e-4 THEN v1 ELSE v1 + (23.4 - k1) / (k2 - k1) * (v2 - v1) END, 4) AS price FROM y
""")
def lens_vignetting_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_discount", F.col("l_extendedprice").alias("price"), "l_linenumber")
    grid = lens.nearest_grid(t, "l_quantity", "l_discount", ["price"], "l_linenumber", 23.4, 0.043, "l_suppkey")
    return lens.interpolate_grid(grid, "l_quantity", "l_discount", "price", 23.4, 0.043, "l_suppkey").withColumn("price", F.round("price", 4))


@query("""
WITH m AS (SELECT l_returnflag AS lens, l_quantity AS k, sum(l_extendedprice * l_linenumber) / sum(l_linenumber) AS v FROM lineitem GROUP BY 1, 2),
i AS (SELECT c_custkey AS image, ['A', 'N', 'X'][c_custkey % 3 + 1] AS lens, abs(c_acctbal) % 80 + 0.5 AS f FROM customer),
r AS (SELECT image, f, k, v, row_number() OVER (PARTITION BY image ORDER BY abs(k - f), k) AS r FROM i JOIN m USING (lens)),
t AS (SELECT image, any_value(f) AS f, max(k) FILTER (r = 1) AS k1, max(v) FILTER (r = 1) AS v1, max(k) FILTER (r = 2) AS k2, max(v) FILTER (r = 2) AS v2 FROM r WHERE r <= 2 GROUP BY 1)
SELECT image, CASE WHEN sign(k1 - t.f) * sign(k2 - t.f) <= 0 OR abs(t.f - k1) < 0.15 * t.f THEN round(v1 + (t.f - k1) / (k2 - k1) * (v2 - v1), 2) END AS price FROM i LEFT JOIN t USING (image)
""")
def lens_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image of a project looked up in its lens's rows."""
    names = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("X")), (F.col("c_custkey") % 3 + 1).cast("int"))
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"), names.alias("l_returnflag"), (F.abs("c_acctbal") % 80 + 0.5).alias("f"))
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.col("l_extendedprice").alias("price"), "l_linenumber")
    return lens.look_up_all(images, "image", "f", t, "l_returnflag", "l_quantity", "price", "l_linenumber").withColumn("price", F.round("price", 2))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS discount FROM lineitem GROUP BY 1")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_extendedprice": "price", "l_discount": "discount"})
    return statistics.weighted_mean(t, "l_quantity", ["price", "discount"], "l_returnflag").select("l_returnflag", F.round("price", 4).alias("price"), F.round("discount", 6).alias("discount"))


# ---- statistics


@query("""
SELECT l_suppkey, l_returnflag, count(*) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, round(var_samp(l_extendedprice), 2) AS variance
FROM lineitem GROUP BY 1, 2
""")
def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.error_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_suppkey", "l_returnflag")
    return s.withColumn("mean", F.round("mean", 4)).withColumn("variance", F.round("variance", 2))


@query("""
SELECT n, coalesce(e.min, 1000000.0) AS min, coalesce(e.max, 0.0) AS max, mean, round(variance, 2) AS variance
FROM (SELECT count(l_extendedprice) AS n, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS mean, var_samp(l_extendedprice) AS variance FROM lineitem WHERE l_quantity < l_linenumber - 6) e
""")
def error_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of rows that a filter leaves: none in the usual tables, where the neutral limits stand."""
    s = statistics.error_stats(table(spark, sf_dir, "lineitem").filter("l_quantity < l_linenumber - 6"), "l_extendedprice")
    return s.withColumn("mean", F.round("mean", 4)).withColumn("variance", F.round("variance", 2))


@query("""
WITH s AS (SELECT l_suppkey, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem JOIN s USING (l_suppkey) WHERE l_extendedprice > CASE WHEN d > m THEN m ELSE m + d END
""")
def clean_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.over_limit(table(spark, sf_dir, "lineitem"), "l_extendedprice", 1.0, "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query("""
SELECT l_returnflag, sorted[CAST(floor(0.1 * n) AS BIGINT) + 1] AS q10, sorted[CAST(floor(0.9 * n) AS BIGINT) + 1] AS q90
FROM (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS sorted, count(*) AS n FROM lineitem GROUP BY 1)
""")
def index_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.index_quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"q10": 0.1, "q90": 0.9}, "l_returnflag")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice) - min(o_totalprice), 4) AS range, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def exposure_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.max("o_totalprice") - F.min("o_totalprice"), 4).alias("range"), F.countDistinct("o_custkey").alias("customers"))


@query("""
SELECT l_suppkey, var_pop(l_quantity) < 1e-5 AS vertical, CASE WHEN var_pop(l_quantity) >= 1e-5 THEN round(regr_slope(l_extendedprice, l_quantity), 4) END AS slope,
       CASE WHEN var_pop(l_quantity) >= 1e-5 THEN round(regr_intercept(l_extendedprice, l_quantity), 2) END AS "offset" FROM lineitem GROUP BY 1
""")
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = statistics.line_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_suppkey")
    return fit.withColumn("slope", F.round("slope", 4)).withColumn("offset", F.round("offset", 2))


# ---- pixels: (x, y) from keys, value and exposure from prices


_PIXELS = "(SELECT l_partkey % 10 AS x, l_suppkey % 10 AS y, l_extendedprice AS v, l_discount * 10 AS m, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_partkey") % 10).alias("x"), (F.col("l_suppkey") % 10).alias("y"), F.col("l_extendedprice").alias("v"), (F.col("l_discount") * 10).alias("m"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")


@query(f"""
SELECT x, y, round(CASE WHEN sum(0.5 - abs(m - 0.5)) > 0 THEN sum((0.5 - abs(m - 0.5)) * v) / sum(0.5 - abs(m - 0.5)) WHEN min(m) >= 1 THEN min(v) ELSE max(v) END, 3) AS hdr FROM {_PIXELS} GROUP BY 1, 2
""")
def hdr_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.hdr_average(_pixels(spark, sf_dir), "v", "m", "x", "y").withColumn("hdr", F.round("hdr", 3))


@query(f"""
WITH p AS {_PIXELS}, a AS (SELECT x, y, avg(v) AS a, count(*) AS n FROM p GROUP BY 1, 2)
SELECT x, y, round(CASE WHEN max(n) > 1 THEN sum(abs(v - a)) ELSE max(v) END, 2) AS spread FROM p JOIN a USING (x, y) GROUP BY 1, 2
""")
def difference_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spread(_pixels(spark, sf_dir), "v", "x", "y").withColumn("spread", F.round("spread", 2))


@query(f"""
WITH p AS (SELECT x, y, count(*) AS c FROM {_PIXELS} GROUP BY 1, 2)
SELECT x, y, CAST(sum(r) OVER (PARTITION BY x ORDER BY y ROWS UNBOUNDED PRECEDING) AS BIGINT) AS integral
FROM (SELECT x, y, sum(c) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING) AS r FROM p)
""")
def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pixels(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("c"))
    return statistics.integral(counts, "x", "y", "c").select("x", "y", "integral")


@query(f"SELECT x, min(y) AS top, max(y) AS bottom, count(*) FILTER (m > 0.5) AS bright, arg_max(v, (epoch_us(l_shipdate), v)) AS painted FROM {_PIXELS} GROUP BY 1")
def regions_and_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding boxes, mask counts and last-writer-wins painting."""
    last = F.max_by("v", F.struct("l_shipdate", "v"))
    return _pixels(spark, sf_dir).groupBy("x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count_if(F.col("m") > 0.5).alias("bright"), last.alias("painted"))


# ---- filters and relations


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey = 7 AND l_partkey <> 7 THEN l_suppkey ELSE l_partkey END AS img1, CASE WHEN l_suppkey = 7 AND l_partkey <> 7 THEN l_partkey ELSE l_suppkey END AS img2,
       CASE WHEN l_suppkey = 7 AND l_partkey <> 7 THEN l_discount ELSE l_tax END AS x1, CASE WHEN l_suppkey = 7 AND l_partkey <> 7 THEN l_tax ELSE l_discount END AS x2 FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7
""")
def points_of_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("img1"), F.col("l_suppkey").alias("img2"), F.col("l_tax").alias("x1"), F.col("l_discount").alias("x2"))
    return relations.mirrored(t, 7)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 2000")
def threshold_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a positive threshold; below the absolute value of a negative one."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    pick = lambda limit: t.filter(F.col("o_totalprice") > limit if limit >= 0 else F.col("o_totalprice") < -limit)
    return pick(300_000).unionByName(pick(-2_000))


@query("""
SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)
""")
def active_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends must be active: two semi joins and an anti join."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    c = c.join(table(spark, sf_dir, "nation").filter("n_regionkey = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("""
SELECT l_partkey, l_suppkey, any_value(price) AS price FROM (SELECT least(l_partkey, l_suppkey) AS l_partkey, greatest(l_partkey, l_suppkey) AS l_suppkey, printf('%.2f', l_extendedprice) AS price FROM lineitem) GROUP BY l_partkey, l_suppkey, price
""")
def canonical_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected pairs with a printed value, once each."""
    t = table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("l_partkey"), F.greatest("l_partkey", "l_suppkey").alias("l_suppkey"), F.format_string("%.2f", "l_extendedprice").alias("price"))
    return t.distinct()


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS number FROM lineitem
""")
def local_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return relations.local_number(t, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("number").cast("long").alias("number"))


_TWO = "a AS (SELECT c_custkey AS nr, c_name AS name FROM customer WHERE c_acctbal < 5000), b AS (SELECT c_custkey AS nr, c_name AS name FROM customer WHERE c_acctbal >= 0)"


@query(f"""
WITH {_TWO}
SELECT name, b.nr AS nr, CAST(coalesce(a.nr, (SELECT max(nr) FROM a) + row_number() OVER (PARTITION BY a.nr IS NULL ORDER BY b.nr, name)) AS BIGINT) AS merged FROM b LEFT JOIN a USING (name)
""")
def merge_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projects that share the customers with a balance from 0 to 5000, however many there are."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nr"), F.col("c_name").alias("name"), "c_acctbal")
    return relations.merge_by_name(t.filter("c_acctbal < 5000").drop("c_acctbal"), t.filter("c_acctbal >= 0").drop("c_acctbal"), "name", "nr")


@query("""
SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal * 2 FROM customer WHERE c_custkey % 3 = 0
""")
def insert_or_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return relations.upsert(t, t.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), ["c_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relations.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""
WITH i AS (SELECT o_custkey AS img_nr, dense_rank() OVER (ORDER BY o_custkey) - 1 AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'))
SELECT l_orderkey, l_linenumber, CAST(a.n AS BIGINT) AS img1, CAST(b.n AS BIGINT) AS img2 FROM lineitem JOIN i a ON a.img_nr = l_partkey JOIN i b ON b.img_nr = l_suppkey
""")
def subset_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("img_nr"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("img1"), F.col("l_suppkey").alias("img2"))
    return relations.subset(points, images)


@query("SELECT p_partkey, CASE WHEN p_size > 2 THEN dense_rank() OVER (PARTITION BY p_size > 2 ORDER BY p_size) + 2 ELSE p_size END AS mode FROM (SELECT p_partkey, p_size * 3 AS p_size FROM part)")
def renumber_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All part sizes, as line numbers with gaps."""
    return relations.renumber_lines(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3).cast("long").alias("mode")))


# ---- geometry


_POLYGON = [(0.0, 1000.0), (40.0, 900.0), (50.0, 1500.0), (20.0, 1200.0), (10.0, 2000.0)]


def _polygon_sql(x: str, y: str) -> str:
    steps = []
    for (x0, y0), (x1, y1) in zip(_POLYGON, _POLYGON[1:] + _POLYGON[:1], strict=True):
        side = f"(({x1 - x0}) * ({y} - {y0}) - ({x} - {x0}) * ({y1 - y0}))"
        steps.append(f"CASE WHEN {y} >= {y0} AND {y} < {y1} AND {side} > 0 THEN 1 WHEN {y} < {y0} AND {y} >= {y1} AND {side} < 0 THEN -1 ELSE 0 END")
    return " + ".join(steps)


@query(f"SELECT p_partkey, {_polygon_sql('p_size', 'p_retailprice')} <> 0 AS inside, (p_size - 25) * (p_size - 25) + (p_retailprice - 1500) * (p_retailprice - 1500) < 40000 AS circle FROM part")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", G.in_polygon(x, y, _POLYGON).alias("inside"), G.in_circle(x, y, 25.0, 1500.0, 200.0).alias("circle"))


@query("""
WITH p AS (SELECT p_partkey, (p_size - 25) * 4.0 AS x, (p_retailprice - 1450) * 0.1 AS y FROM part),
e AS (SELECT p_partkey, 200 * atan2(x, 200.0) AS x, 200 * atan2(y, sqrt(200.0 * 200.0 + x * x)) AS y FROM p)
SELECT p_partkey, round(x, 6) AS erect_x, round(y, 6) AS erect_y, round(200 * ln(tan(y / 200) + 1 / cos(y / 200)), 6) AS mercator_y, round(x * cos(y / 200), 6) AS sinusoidal_x,
       round(200 * 2 / (1 + cos(y / 200) * cos(x / 200)) * cos(y / 200) * sin(x / 200), 6) AS stereographic_x, round(100 * ln((1 + cos(y / 200) * sin(x / 200)) / (1 - cos(y / 200) * sin(x / 200))), 6) AS transverse_x,
       round(200 * tan(y / 200), 6) AS pano_y FROM e
""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = 200.0
    point = ((F.col("p_size") - 25) * 4.0, (F.col("p_retailprice") - 1450) * 0.1)
    e = G.chain(point, G.rect_to_erect(d))
    back = lambda x: F.round(x, 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", back(e[0]).alias("erect_x"), back(e[1]).alias("erect_y"), back(G.erect_to_mercator(d)(e)[1]).alias("mercator_y"), back(G.erect_to_sinusoidal(d)(e)[0]).alias("sinusoidal_x"),
        back(G.erect_to_stereographic(d)(e)[0]).alias("stereographic_x"), back(G.erect_to_transverse_mercator(d)(e)[0]).alias("transverse_x"), back(G.erect_to_pano(d)(e)[1]).alias("pano_y"),
    )


@query("""
WITH p AS (SELECT p_partkey, (p_size - 25) * 4.0 AS x, (p_retailprice - 1450) * 0.1 AS y FROM part), r AS (SELECT *, sqrt(x * x + y * y) / 150 AS r FROM p)
SELECT p_partkey, round(x * (1.01 + r * (0.0 + r * (-0.03 + r * 0.002))), 6) AS x, round(y * (1.01 + r * (0.0 + r * (-0.03 + r * 0.002))), 6) AS y, round(CAST(x AS DOUBLE), 4) AS back_x, round(CAST(y AS DOUBLE), 4) AS back_y FROM r
""")
def radial_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radial polynomial and its inverse."""
    c = (1.01, 0.0, -0.03, 0.002)
    p = ((F.col("p_size") - 25) * 4.0, (F.col("p_retailprice") - 1450) * 0.1)
    there = G.radial(c, 150.0)(p)
    back = G.undo_radial(c, 150.0)(there)
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")).select("p_partkey", F.round(there[0], 6).alias("x"), F.round(there[1], 6).alias("y"), (F.round(back[0], 4) + 0.0).alias("back_x"), (F.round(back[1], 4) + 0.0).alias("back_y"))


# ---- scalar functions and expressions


@query("SELECT c_custkey, CASE WHEN abs(CAST(c_acctbal > 1000 AS DOUBLE)) > 1e-8 THEN c_acctbal * 0.9 ELSE c_acctbal + c_custkey END AS value, pow(-2.0, 2.0) + fmod(c_custkey, 7) AS quirk FROM customer")
def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    val, i = F.col("c_acctbal"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", apply_expression("VAL > 1000 ? val*0.9 : val + i", val, {"i": i}).alias("value"), apply_expression("-2^2 + i % 7", val, {"i": i}).alias("quirk"))


@query("""
SELECT page_id, regexp_extract(url, '\\.([^./\\\\]*)$', 1) AS ext, regexp_replace(url, '\\.[^./\\\\]*$', '') AS stem, regexp_extract(url, '([^/\\\\]*)$', 1) AS file, regexp_extract(url, '^(.*[/\\\\])', 1) AS prefix FROM pages
""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", S.extension(url).alias("ext"), S.strip_extension(url).alias("stem"), S.strip_path(url).alias("file"), S.path_prefix(url).alias("prefix"))


@query("""
SELECT p_partkey, round(log2((p_size / 10.0) * (p_size / 10.0) / ((p_retailprice / 1000) * 0.01)), 6) AS ev, round(degrees(2 * atan(18.0 / p_size)), 6) AS rectilinear, round(degrees(36.0 / p_size), 6) AS equidistant,
       round(degrees(4 * atan(9.0 / p_size)), 6) AS stereographic, round(degrees(4 * asin(least(1, 9.0 / p_size))), 6) AS equisolid,
       round(CASE WHEN p_size <= 20 THEN p_size ELSE sqrt(20.0 * (2 * p_size - 20)) END, 6) AS huber, round(1 - 0.1 * pow(p_size / 50.0, 2) + 0.05 * pow(p_size / 50.0, 4) - 0.02 * pow(p_size / 50.0, 6), 6) AS vignetting FROM part
""")
def lens_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    six = lambda c: F.round(c, 6)
    return table(spark, sf_dir, "part").select(
        "p_partkey", six(S.exposure_value(F.lit(0.01), size / 10, F.col("p_retailprice") / 10)).alias("ev"), *(six(S.hfov(size, 36.0, name)).alias(name) for name in ("rectilinear", "equidistant", "stereographic", "equisolid")),
        six(S.huber(size, 20.0)).alias("huber"), six(S.vignetting(size / 50, (1.0, -0.1, 0.05, -0.02))).alias("vignetting"),
    )


# ---- order and top-k


@query("""
SELECT l_suppkey, l_returnflag, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC) AS n FROM lineitem) WHERE n <= 5
""")
def top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_extendedprice"), 5, ["l_suppkey", "l_returnflag"], [F.col("l_extendedprice").desc()])


@query("""
WITH c AS (SELECT DISTINCT CAST(floor(p_size * 10 / 51.0) AS INTEGER) AS cell_x, CAST(floor((p_retailprice - 900) * 10 / 1200.0) AS INTEGER) AS cell_y, p_retailprice AS score, p_size AS scale FROM part)
SELECT cell_x, cell_y, score, scale FROM (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY score DESC, scale DESC) AS n FROM c) WHERE n <= 3
""")
def grid_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("score"), F.col("p_size").alias("scale"))
    return ranking.sieve(t, F.col("scale"), F.col("score") - 900, 51.0, 1200.0, 10, 10, 3, ["score", "scale"]).select("cell_x", "cell_y", "score", "scale")


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n,
    min(o_totalprice) OVER (PARTITION BY o_custkey) = max(o_totalprice) OVER (PARTITION BY o_custkey) AS flat FROM orders) WHERE i = CASE WHEN flat THEN 0 ELSE n // 2 END
""")
def median_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.median_row(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query("SELECT name, CAST(row_number() OVER (ORDER BY n, name) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT 'img' || c_custkey || '.tif' AS name, c_custkey AS n FROM customer)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("img"), F.col("c_custkey").cast("string"), F.lit(".tif")).alias("name")).distinct()
    return ranking.row_numbers(names.withColumn("key", S.natural_key(F.col("name"))), "place", ["key", "name"]).select("name", "place")


@query("SELECT c_custkey, c_custkey // 7 AS stack, row_number() OVER (PARTITION BY c_custkey // 7 ORDER BY c_custkey) - 1 AS layer FROM customer")
def fixed_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_custkey", F.floor(F.col("c_custkey") / 7).alias("stack"))
    return t.withColumn("layer", (F.row_number().over(Window.partitionBy("stack").orderBy("c_custkey")) - 1).cast("long"))


# ---- matching


_EMBEDDED = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"""
WITH {_EMBEDDED}, d AS (SELECT a.id AS q, b.id AS t, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e a, e b WHERE a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT q, t, d, row_number() OVER (PARTITION BY q ORDER BY d, t) AS n FROM d),
m AS (SELECT q, max(t) FILTER (n = 1) AS t, max(d) FILTER (n = 1) AS d1, max(d) FILTER (n = 2) AS d2 FROM r WHERE n <= 2 GROUP BY q), k AS (SELECT * FROM m WHERE d1 <= 0.95 * d2)
SELECT q, t, round(d1, 6) AS d1 FROM k WHERE t IN (SELECT t FROM k GROUP BY t HAVING count(*) = 1)
""")
def match_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nearest, ratio test, mutual exclusion."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = matching.two_nearest(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"))
    return matching.exclusive(matching.ratio_test(near, 0.95)).select("q", "t", F.round("d1", 6).alias("d1"))


@query(f"""
WITH {_EMBEDDED}, d AS (SELECT a.id AS q, b.id AS t, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e a, e b WHERE a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT q, t, d, row_number() OVER (PARTITION BY q ORDER BY d, t) AS n FROM d),
m AS (SELECT q, max(t) FILTER (n = 1) AS t, max(d) FILTER (n = 1) AS d1, max(d) FILTER (n = 2) AS d2 FROM r WHERE n <= 2 GROUP BY q), k AS (SELECT * FROM m WHERE d1 <= 0.95 * d2)
SELECT q, t, round(d1, 6) AS d1 FROM k WHERE t IN (SELECT t FROM k GROUP BY t HAVING count(*) = 1)
""")
def match_descriptors_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the k-d forest, opening every cell within reach."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = matching.two_nearest_indexed(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), exact=True, leaf=64)
    return matching.exclusive(matching.ratio_test(near, 0.95)).select("q", "t", F.round("d1", 6).alias("d1"))


@query(f"""
WITH {_EMBEDDED}, z AS (SELECT e.id, list_zip(e.v, o.v) AS p FROM e, (SELECT v FROM e WHERE id = 0) o)
SELECT id, round(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN p]), 6) AS l2, round(list_sum([abs(x[1] - x[2]) FOR x IN p]), 6) AS l1, round(list_max([abs(x[1] - x[2]) FOR x IN p]), 6) AS max,
       round(list_sum([least(x[1], x[2]) FOR x IN p]), 6) AS histogram FROM z
""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    one = e.filter("id = 0").select(F.col("v").alias("o"))  # a single row
    return e.crossJoin(F.broadcast(one)).select("id", *(F.round(S.distance(k, F.col("v"), F.col("o")), 6).alias(k) for k in ("l2", "l1", "max", "histogram")))


@query("""
WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey > a.s_suppkey AND b.s_suppkey <= a.s_suppkey + 3), d AS (SELECT DISTINCT least(l_suppkey, l_linenumber) AS a, greatest(l_suppkey, l_linenumber) AS b FROM lineitem)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.a = p.a AND d.b = p.b)
""")
def banded_unchecked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.banded_pairs(table(spark, sf_dir, "supplier"), "s_suppkey", 3)
    done = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"))
    return matching.unchecked(pairs, done)


# ---- graphs and sessions


_EDGES = "SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000000000 AS b FROM lineitem"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000_000).alias("b"))


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), n AS (SELECT p_partkey AS node FROM part UNION SELECT s_suppkey + 1000000000000 FROM supplier UNION SELECT a FROM s),
r(node, label) AS (SELECT node, node FROM n UNION SELECT s.b, r.label FROM r JOIN s ON s.a = r.node WHERE r.label < s.b)
SELECT node, min(label) AS component FROM r GROUP BY node
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as edges, all parts and suppliers as nodes."""
    e = _edges(spark, sf_dir)
    parts, suppliers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 1_000_000_000_000)
    return graph.components(parts.union(suppliers).union(e.select("a")).union(e.select("b")).distinct(), e)


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, level) AS (SELECT min(a), 0 FROM e UNION SELECT s.b, r.level + 1 FROM r JOIN s ON s.a = r.node WHERE r.level < 12)
SELECT node, min(level) AS level FROM r GROUP BY node
""")
def breadth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as edges, all levels (these tables have fewer than the 12 to which the SQL goes)."""
    e = _edges(spark, sf_dir)
    return graph.levels(e, e.agg(F.min("a").alias("node")))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS grp FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY user_id, grp HAVING count(*) >= 2
""")
def shot_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours").filter("n >= 2").select("user_id", "n", "first", "last")


# ---- overlap, stacks, masks


_RECTANGLES = "r AS (SELECT s_suppkey AS img_nr, CAST(s_suppkey % 10 * 37 AS DOUBLE) AS l, CAST(s_suppkey // 10 * 29 AS DOUBLE) AS t, CAST(s_suppkey % 10 * 37 + 60 + s_suppkey % 7 AS DOUBLE) AS rr, CAST(s_suppkey // 10 * 29 + 50 AS DOUBLE) AS b FROM supplier)"


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    left, top = (k % 10 * 37).cast("double"), (F.floor(k / 10) * 29).cast("double")
    return table(spark, sf_dir, "supplier").select(k.alias("img_nr"), left.alias("left"), top.alias("top"), (left + 60 + k % 7).alias("right"), (top + 50).alias("bottom"))


@query(f"""
WITH {_RECTANGLES}, g AS (SELECT img_nr AS i, l + (rr - l) * (a + 0.5) / 10 AS x, t + (b - t) * (c + 0.5) / 10 AS y FROM r, range(10) q(a), range(10) p(c)),
d AS (SELECT i, img_nr AS j, count(*) / 100 AS ratio FROM g, r WHERE x >= l AND x < rr AND y >= t AND y < b AND i <> img_nr GROUP BY 1, 2)
SELECT least(i, j) AS i, greatest(i, j) AS j, max(ratio) AS ratio FROM d GROUP BY 1, 2
""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.symmetric_overlap(coverage.overlap_ratios(_rectangles(spark, sf_dir)))


@query(f"""
WITH {_RECTANGLES}, p AS (SELECT i.img_nr AS i, j.img_nr AS j, i.l + (i.rr - i.l) * a / 10 AS x, i.t + (i.b - i.t) * c / 10 AS y, (i.l + i.rr) / 2 AS cx, (i.t + i.b) / 2 AS cy, j.l, j.t, j.rr, j.b
    FROM r i JOIN r j ON j.img_nr = i.img_nr + 1, range(11) q(a), range(11) s(c))
SELECT i, j, x, y FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy), 6), y, x) AS n FROM p WHERE x >= l AND x < rr AND y >= t AND y < b) WHERE n = 1
""")
def geometric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rectangles(spark, sf_dir)
    pairs = matching.banded_pairs(r.select("img_nr"), "img_nr", 1).withColumnsRenamed({"a": "i", "b": "j"})
    return coverage.shared_point(r, pairs)


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS anchor FROM part")
def lens_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.lens_anchor(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_type", "p_size").select("p_partkey", "anchor")


@query("SELECT o_orderkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stack FROM orders")
def stacks_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    return coverage.possible_stacks(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", layer).select("o_orderkey", "stack")


@query("""
WITH w AS (SELECT l_linenumber AS img, l_partkey % 40 AS x, l_suppkey % 40 AS y, max(l_discount) AS weight FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT x, y, max((weight, img)) AS b FROM w GROUP BY 1, 2)
SELECT img, x, y, weight > 0.095 OR (b[1] <= 0.095 AND b[2] = img) AS keep FROM w JOIN b USING (x, y)
""")
def threshold_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    w = t.groupBy(F.col("l_linenumber").alias("img"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 40).alias("y")).agg(F.max("l_discount").alias("weight"))
    return coverage.threshold_masks(w, 0.095)


_MASK = "m AS (SELECT l_partkey % 30 AS x, l_suppkey % 30 AS y, CASE WHEN sum(l_linenumber) % 5 < 3 THEN 255 ELSE 0 END AS v FROM lineitem GROUP BY 1, 2)"


@query(f"""
WITH {_MASK}, n AS (SELECT a.x, a.y, count(*) FILTER (b.v = 255) AS white, count(*) FILTER (b.v = 0) AS black FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY 1, 2)
SELECT x, y, CASE WHEN x BETWEEN 1 AND 28 AND y BETWEEN 1 AND 28 AND white > 6 THEN 255 WHEN x BETWEEN 1 AND 28 AND y BETWEEN 1 AND 28 AND black > 6 THEN 0 ELSE v END AS v FROM m LEFT JOIN n USING (x, y)
""")
def denoise_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    m = t.groupBy((F.col("l_partkey") % 30).alias("x"), (F.col("l_suppkey") % 30).alias("y")).agg(F.when(F.sum("l_linenumber") % 5 < 3, 255).otherwise(0).alias("v"))
    return coverage.denoise(m, 30, 30)


@query("""
WITH b AS (SELECT l_returnflag, least(CAST(floor(l_discount * 10 * 10) AS BIGINT), 9) AS bin, l_extendedprice FROM lineitem)
SELECT l_returnflag, bin, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, bin ORDER BY l_extendedprice) AS n FROM b) WHERE n <= 20
""")
def radius_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") * 10).alias("radius"), "l_extendedprice")
    return coverage.radius_sample(t, "radius", "l_extendedprice", 10, 20, "l_returnflag").select("l_returnflag", "bin", "l_extendedprice")


@query("""
WITH s AS (SELECT DISTINCT CAST(floor(p_retailprice) AS BIGINT) % 3600 AS c FROM part), g AS (SELECT (c + 1) % 3600 AS start, coalesce(lead(c) OVER (ORDER BY c), min(c) OVER () + 3600) - c - 1 AS width FROM s)
SELECT start, width FROM g WHERE width > 0 ORDER BY width DESC, start LIMIT 1
""")
def widest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.floor("p_retailprice").alias("c"))
    return coverage.widest_gap(t, "c", 3600)


@query("SELECT round(avg(l_quantity * l_quantity), 4) AS l_quantity_l_quantity, round(avg(l_discount * l_quantity), 6) AS l_discount_l_quantity, round(avg(l_discount * l_discount), 6) AS l_discount_l_discount FROM lineitem")
def axis_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coverage.covariance(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")
    return c.select(F.round("l_quantity_l_quantity", 4).alias("l_quantity_l_quantity"), F.round("l_discount_l_quantity", 6).alias("l_discount_l_quantity"), F.round("l_discount_l_discount", 6).alias("l_discount_l_discount"))


@query("SELECT p_partkey, round(p_size * (p_retailprice / 100) / 2, 4) AS area, CAST(2 + greatest(1, ceil(sqrt(p_size * p_size + pow(p_retailprice / 100, 2)) / 1000)) AS INTEGER) AS corners FROM part")
def mask_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, high = F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    poly = F.array(corner(zero, zero), corner(size, zero), corner(zero, high))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(coverage.polygon_area(poly), 4).alias("area"), F.size(coverage.resample_polygon(poly, 1000.0)).alias("corners"))


@query("SELECT o_custkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS value FROM orders")
def monotone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response table for each customer, made non-decreasing; a table has at most as many entries as a sensor has levels."""
    tables = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("t"))
    return tables.select("o_custkey", F.explode(coverage.monotone(F.col("t"))).alias("value"))


# ---- grouped and iterative estimation


@query("""
WITH RECURSIVE r AS (SELECT o_custkey AS k, list({'n': o_orderkey, 'ev': o_totalprice / 50000} ORDER BY o_orderkey) AS todo, -1 AS layer, list({'n': o_orderkey, 'ev': o_totalprice / 50000} ORDER BY o_orderkey) AS mine FROM orders GROUP BY 1
    UNION ALL SELECT k, list_filter(todo, lambda x: x.n <> todo[1].n AND abs(x.ev - todo[1].ev) >= 0.5), layer + 1, list_filter(todo, lambda x: x.n = todo[1].n OR abs(x.ev - todo[1].ev) < 0.5) FROM r WHERE len(todo) > 0)
SELECT k AS customer, m.n AS img_nr, CAST(layer AS BIGINT) AS layer FROM (SELECT k, layer, unnest(mine) AS m FROM r WHERE layer >= 0)
""")
def exposure_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the images of a project; a project is one bounded group."""
    images = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("img_nr"), (F.col("o_totalprice") / 50_000).alias("ev"))
    return estimation.greedy_layers(images, "customer", 0.5)


def _deghost_sql(rounds: int = 4, sigma: float = 30.0) -> str:
    steps = ["w0 AS (SELECT img, x, y, v, 1 - pow(v / 127.5 - 1, 16) AS w FROM p)"]
    for k in range(rounds):
        steps.append(f"""m{k} AS (SELECT a.img, a.x, a.y, sum(b.w * exp(-(a.v - b.v) * (a.v - b.v) / {2 * sigma * sigma})) / nullif(sum(b.w), 0) AS m
            FROM w{k} a JOIN w{k} b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY 1, 2, 3),
        w{k + 1} AS (SELECT img, x, y, v, w * coalesce(m, 1) AS w FROM w{k} LEFT JOIN m{k} USING (img, x, y))""")
    return f"WITH p AS (SELECT l_linenumber AS img, CAST(l_partkey % 20 AS INTEGER) AS x, CAST(l_suppkey % 20 AS INTEGER) AS y, round(avg(l_discount) * 2550, 3) AS v FROM lineitem GROUP BY 1, 2, 3), {', '.join(steps)} SELECT img, x, y, round(w * 255 / (SELECT max(w) FROM w{rounds}), 2) AS weight FROM w{rounds}"


@query(_deghost_sql())
def deghost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as exposures, keys as pixels, the mean discount as value."""
    t = table(spark, sf_dir, "lineitem")
    p = t.groupBy(F.col("l_linenumber").alias("img"), (F.col("l_partkey") % 20).cast("int").alias("x"), (F.col("l_suppkey") % 20).cast("int").alias("y")).agg(F.round(F.avg("l_discount") * 2550, 3).alias("v"))
    return estimation.deghost(p).select("img", "x", "y", F.round("weight", 2).alias("weight"))


@query()
def ransac_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded draws have no SQL; tests hold the operator against a known homography. A part's lines are its matches."""
    t = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_extendedprice") / 1000).alias("x2"), (F.col("l_tax") * 100).alias("y2"))
    return estimation.ransac(t, ["l_partkey"], distance=20.0)
