"""More registered queries: project edits, filters, lens cases, geometry, photometry, plans of matching. Adapted as those in :mod:`queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import photometry as P
from ..functions import scalar as S
from ..operators import coverage, edits, estimation, filters, graph, lens, ranking, relations, statistics
from ..session import cut, spread
from .queries import _PIXELS, _pixels, query, table

# ---- lens look-ups


@query("""
WITH m AS (SELECT l_returnflag AS lens, l_quantity AS k, sum(l_extendedprice * l_linenumber) / sum(l_linenumber) AS v1, sum(l_discount * l_linenumber) / sum(l_linenumber) AS v2, sum(l_tax * l_linenumber) / sum(l_linenumber) AS v3 FROM lineitem GROUP BY 1, 2),
i AS (SELECT c_custkey AS image, ['A', 'N', 'X'][c_custkey % 3 + 1] AS lens, abs(c_acctbal) % 80 + 0.5 AS f FROM customer),
r AS (SELECT image, f, k, v1, v2, v3, row_number() OVER (PARTITION BY image ORDER BY abs(k - f), k) AS r FROM i JOIN m USING (lens)),
t AS (SELECT image, any_value(f) AS f, max(k) FILTER (r = 1) AS k1, max(k) FILTER (r = 2) AS k2, max(v1) FILTER (r = 1) AS a1, max(v1) FILTER (r = 2) AS a2, max(v2) FILTER (r = 1) AS b1, max(v2) FILTER (r = 2) AS b2, max(v3) FILTER (r = 1) AS c1, max(v3) FILTER (r = 2) AS c2 FROM r WHERE r <= 2 GROUP BY 1),
g AS (SELECT *, sign(k1 - f) * sign(k2 - f) <= 0 OR abs(f - k1) < 0.15 * f AS ok, (f - k1) / (k2 - k1) AS s FROM t)
SELECT image, CASE WHEN ok THEN round(a1 + s * (a2 - a1), 2) END AS a, CASE WHEN ok THEN round(b1 + s * (b2 - b1), 6) END AS b, CASE WHEN ok THEN round(c1 + s * (c2 - c1), 6) END AS c FROM i LEFT JOIN g USING (image)
""")
def lens_lookup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a lens table (distortion has three, colour fringes eight) for every image in one look-up."""
    names = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("X")), (F.col("c_custkey") % 3 + 1).cast("int"))
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"), names.alias("lens"), (F.abs("c_acctbal") % 80 + 0.5).alias("f"))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("lens"), "l_quantity", F.col("l_extendedprice").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("c"), "l_linenumber")
    found = lens.look_up_all(images, "image", "f", t, "lens", "l_quantity", ["a", "b", "c"], "l_linenumber")
    return found.select("image", F.round("a", 2).alias("a"), F.round("b", 6).alias("b"), F.round("c", 6).alias("c"))


_CROPS = "SELECT p_partkey // 3 AS lens, 20 + p_size AS k, CAST(min(p_partkey % 100) AS INTEGER) AS l, CAST(max(p_partkey % 100 + 500) AS INTEGER) AS r FROM part GROUP BY 1, 2"


@query(f"""
WITH m AS ({_CROPS}), i AS (SELECT c_custkey AS image, c_custkey // 3 AS lens, 20 + abs(c_acctbal) % 52 AS f FROM customer),
q AS (SELECT image, f, k, l, r, row_number() OVER (PARTITION BY image ORDER BY abs(k - f), k) AS n FROM i JOIN m USING (lens)),
t AS (SELECT image, any_value(f) AS f, max(k) FILTER (n = 1) AS k1, max(k) FILTER (n = 2) AS k2, max(l) FILTER (n = 1) AS l1, max(l) FILTER (n = 2) AS l2, max(r) FILTER (n = 1) AS r1, max(r) FILTER (n = 2) AS r2 FROM q WHERE n <= 2 GROUP BY 1),
g AS (SELECT *, CASE WHEN k2 IS NULL THEN abs(f - k1) < 0.075 * f ELSE sign(k1 - f) * sign(k2 - f) <= 0 OR abs(f - k1) < 0.15 * f END AS ok, CASE WHEN k2 IS NULL THEN 0 ELSE (f - k1) / (k2 - k1) END AS s FROM t)
SELECT image, CASE WHEN ok THEN CAST(round(l1 + s * (coalesce(l2, l1) - l1)) AS INTEGER) END AS l, CASE WHEN ok THEN CAST(round(r1 + s * (coalesce(r2, r1) - r1)) AS INTEGER) END AS r FROM i LEFT JOIN g USING (image)
""")
def lens_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop sides of one or two rows: alone strictly near, of two between them."""
    part = table(spark, sf_dir, "part")
    crops = part.groupBy(F.floor(F.col("p_partkey") / 3).alias("lens"), (F.col("p_size") + 20).alias("k")).agg(F.min(F.col("p_partkey") % 100).cast("int").alias("l"), F.max(F.col("p_partkey") % 100 + 500).cast("int").alias("r"))
    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image"), F.floor(F.col("c_custkey") / 3).alias("lens"), (F.abs("c_acctbal") % 52 + 20).alias("f"))
    return lens.look_up_crop(images, "image", "f", crops, ["lens"], "k", ["l", "r"])


def _line(x: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f"CASE WHEN abs({x1} - {x0}) < 1e-4 THEN {y0} ELSE {y0} + ({x} - {x0}) / ({x1} - {x0}) * ({y1} - {y0}) END"


def _reach(a: str, b: str) -> str:
    return f"(sign({a} - x) * sign({b} - x) <= 0 OR abs(x - {a}) < 0.15 * x)"


@query(f"""
WITH m AS (SELECT p_partkey // 4 AS lens, 20.0 + p_size % 3 AS f, 2.0 + p_partkey * 7 % 5 * 0.5 AS a, sum(p_retailprice * (1 + p_partkey % 3)) / sum(1 + p_partkey % 3) AS v FROM part GROUP BY 1, 2, 3),
i AS (SELECT c_custkey AS image, c_custkey // 3 AS lens, 19.5 + c_custkey % 8 * 0.5 AS x, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE 2.0 + c_custkey % 9 * 0.25 END AS y FROM customer),
fr AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY abs(f - x), f) AS r FROM i JOIN (SELECT DISTINCT lens, f FROM m) USING (lens)),
ar AS (SELECT image, x, y, f, a, v, row_number() OVER (PARTITION BY image, f ORDER BY abs(a - y), a) AS r FROM fr JOIN m USING (lens, f) WHERE fr.r <= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY f, a) AS k FROM ar WHERE r <= 2),
p AS (SELECT image, any_value(x) AS x, any_value(y) AS y, count(*) AS n, {", ".join(f"max({c}) FILTER (k = {k}) AS {c}{k}" for k in (1, 2, 3, 4) for c in "fav")} FROM o GROUP BY 1),
d AS (SELECT *, abs(y) < 0.001 AS u, (f2 - f1) * (a3 - a1) - (f3 - f1) * (a2 - a1) AS area FROM p)
SELECT i.image, coalesce(n, 0) AS n, value FROM i LEFT JOIN (SELECT image, n, round(CASE n WHEN 1 THEN CASE WHEN abs(f1 - x) <= 0.075 * x AND (u OR abs(a1 - y) < 0.3) THEN v1 END
    WHEN 2 THEN CASE WHEN abs(f1 - f2) < 0.001 THEN CASE WHEN u THEN v1 WHEN a1 - 0.3 <= y AND y <= a2 + 0.3 THEN {_line("y", "a1", "v1", "a2", "v2")} END
        WHEN {_reach("f1", "f2")} AND (u OR abs({_line("x", "f1", "a1", "f2", "a2")} - y) < 0.3) THEN {_line("x", "f1", "v1", "f2", "v2")} END
    WHEN 3 THEN CASE WHEN {_reach("f1", "f3")} THEN CASE WHEN abs(area) < 1e-6 THEN v1 ELSE v1 + ((x - f1) * ((v2 - v1) * (a3 - a1) - (a2 - a1) * (v3 - v1)) + (y - a1) * ((f2 - f1) * (v3 - v1) - (v2 - v1) * (f3 - f1))) / area END END
    WHEN 4 THEN CASE WHEN {_reach("f1", "f3")} THEN CASE WHEN u THEN {_line("x", "f1", "v1", "f3", "v3")}
        WHEN a1 - 0.3 <= y AND y <= a2 + 0.3 AND a3 - 0.3 <= y AND y <= a4 + 0.3 THEN {_line("x", "f1", f"({_line('y', 'a1', 'v1', 'a2', 'v2')})", "f3", f"({_line('y', 'a3', 'v3', 'a4', 'v4')})")} END END END, 4) AS value
FROM d) USING (image)
""")
def lens_vignetting_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vignetting rows of none to four kinds."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(F.floor(k / 4).alias("lens"), (F.col("p_size") % 3 + 20.0).alias("focallength"), (k * 7 % 5 * 0.5 + 2.0).alias("aperture"), F.col("p_retailprice").alias("value"), (k % 3 + 1).alias("weight"))
    c = F.col("c_custkey")
    images = table(spark, sf_dir, "customer").select(c.alias("image"), F.floor(c / 3).alias("lens"), (c % 8 * 0.5 + 19.5).alias("x"), F.when(c % 5 == 0, 0.0).otherwise(c % 9 * 0.25 + 2.0).alias("y"))
    found = lens.look_up_vignetting(images, "image", "lens", "x", "y", t, ["value"], "weight")
    means = statistics.weighted_mean(t, "weight", ["value"], "lens", "focallength", "aperture").drop("value")
    # how many rows each image met, from the plain rule: the two nearest of each level
    first = ranking.top(images.join(means.select("lens", "focallength").distinct(), "lens"), 2, ["image"], [F.abs(F.col("focallength") - F.col("x")), F.col("focallength")])
    both = ranking.top(first.join(means, ["lens", "focallength"]), 2, ["image", "focallength"], [F.abs(F.col("aperture") - F.col("y")), F.col("aperture")])
    met = both.groupBy("image").agg(F.count("*").alias("n"))
    return images.select("image").join(found, "image", "left").join(met, "image", "left").select("image", F.coalesce("n", F.lit(0)).alias("n"), F.round("value", 4).alias("value"))


@query("""
WITH t AS (SELECT p_brand AS maker, p_type AS model, min(p_retailprice) AS crop FROM part WHERE p_size > 40 GROUP BY 1, 2),
i AS (SELECT p_partkey AS image, p_brand AS maker, p_type AS model, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN NULL ELSE p_name END AS own FROM part)
SELECT image, CASE WHEN coalesce(own, '') <> '' THEN own ELSE maker || '|' || model END AS lens, crop FROM i LEFT JOIN t USING (maker, model)
""")
def lens_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by whole keys, and the name under which a lens is filed."""
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "maker", "p_type": "model"})
    crops = part.filter("p_size > 40").groupBy("maker", "model").agg(F.min("p_retailprice").alias("crop"))
    own = F.when(F.col("p_size") % 4 == 0, "").when(F.col("p_size") % 4 == 1, F.lit(None)).otherwise(F.col("p_name"))
    images = part.select(F.col("p_partkey").alias("image"), "maker", "model", S.lens_name(own, F.col("maker"), F.col("model")).alias("lens"))
    return lens.point(crops, images, ["maker", "model"], "crop").select("image", "lens", "crop")


@query("""
WITH f AS (SELECT p_brand, min(p_retailprice) AS v FROM part WHERE p_size > 10 GROUP BY 1)
SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_retailprice END, v) AS value FROM part LEFT JOIN f USING (p_brand)
""")
def lens_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    images = part.select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")).alias("value"))
    by_brand = part.filter("p_size > 10").groupBy("p_brand").agg(F.min("p_retailprice").alias("value"))
    found = lens.point(by_brand, part.select("p_partkey", "p_brand"), ["p_brand"], "value").select("p_partkey", "value")
    return lens.fill(images, found, "p_partkey", "value").select("p_partkey", "value")


@query("""
WITH old AS (SELECT s_suppkey AS k, 0 AS l, 10 AS r, 0 AS t, 10 AS b FROM supplier), new AS (SELECT s_suppkey AS k, 5 AS l, CASE WHEN s_acctbal < 0 THEN 5 ELSE 9 END AS r, 1 AS t, 8 AS b FROM supplier WHERE s_nationkey < 10)
SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new WHERE l < r
""")
def save_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops put in, or taken away where the new rectangle is empty."""
    s = table(spark, sf_dir, "supplier")
    box = lambda l, r, t, b: [F.col("s_suppkey").alias("k"), l.alias("l"), r.alias("r"), t.alias("t"), b.alias("b")]  # noqa: E731, E741
    old = s.select(*box(F.lit(0), F.lit(10), F.lit(0), F.lit(10)))
    new = s.filter("s_nationkey < 10").select(*box(F.lit(5), F.when(F.col("s_acctbal") < 0, 5).otherwise(9), F.lit(1), F.lit(8)))
    return lens.save_crop(old, new, ["k"], ("l", "r", "t", "b"))


_SHOTS = "i AS (SELECT o_custkey AS project_id, o_orderkey AS img_nr, 'lens' || o_custkey % 7 AS lens, 30.0 + o_custkey % 5 AS focallength, CASE WHEN o_custkey % 3 = 0 THEN 2.8 + 0.02 * (o_orderkey % 9) ELSE 4.0 END AS aperture, o_totalprice / 10000 AS hfov, CASE WHEN o_custkey % 11 = 0 THEN o_orderkey % 2 ELSE 0 END AS lens_part FROM orders)"


@query(f"""
WITH {_SHOTS}, e AS (SELECT o_custkey AS project_id, avg(o_totalprice / 20000) AS mean FROM orders GROUP BY 1),
p AS (SELECT project_id, arg_min(lens, img_nr) AS lens, arg_min(focallength, img_nr) AS focallength, arg_min(aperture, img_nr) AS a, arg_min(hfov, img_nr) AS hfov, max(aperture) AS hi, min(aperture) AS lo, count(*) AS n, count(DISTINCT lens_part) AS parts FROM i GROUP BY 1)
SELECT 'hfov' AS kind, lens, focallength, round(hfov, 6) AS value FROM p JOIN e USING (project_id) WHERE n >= 2 AND parts = 1 AND mean < 15
UNION ALL SELECT 'vignetting', lens, focallength, round(a, 6) FROM p WHERE n >= 2 AND parts = 1 AND abs(hi - a) < 0.05 AND abs(lo - a) < 0.05
""")
def lens_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens tables from projects: customers as projects, orders as images."""
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    images = o.select(
        k.alias("project_id"), n.alias("img_nr"), F.concat(F.lit("lens"), (k % 7).cast("string")).alias("lens"), (k % 5 + 30.0).alias("focallength"), F.when(k % 3 == 0, n % 9 * 0.02 + 2.8).otherwise(4.0).alias("aperture"),
        (F.col("o_totalprice") / 10_000).alias("hfov"), F.when(k % 11 == 0, n % 2).otherwise(0).alias("lens_part"), F.lit(0).alias("projection"), F.lit(1.0).alias("distance"),
        F.array(F.lit(0.01), F.lit(0.0), F.lit(0.0)).alias("dist"), F.array(F.lit(1.0), F.lit(-0.1), F.lit(0.0), F.lit(0.0)).alias("vig_coeff"),
    )
    found = lens.populate(images, o.select(k.alias("project_id"), (F.col("o_totalprice") / 20_000).alias("error")))
    part = lambda name, kind, c: found[name].select(F.lit(kind).alias("kind"), "lens", "focallength", c.alias("value"))
    return part("lens_hfov", "hfov", F.round("hfov", 6)).union(part("vignetting", "vignetting", F.round("aperture", 6)))


# ---- project edits: lines as control points between parts and suppliers, customers as images


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cp_id"), F.col("l_partkey").alias("img1"), F.col("l_suppkey").alias("img2"), (F.col("l_linenumber") - 1).alias("mode"), F.col("l_quantity").alias("x1"), F.col("l_discount").alias("y1"), F.col("l_tax").alias("x2"), F.col("l_extendedprice").alias("y2"))


_POINTS = "p AS (SELECT l_orderkey * 10 + l_linenumber AS cp_id, l_partkey AS img1, l_suppkey AS img2, l_linenumber - 1 AS mode, l_quantity AS x1, l_discount AS y1, l_tax AS x2, l_extendedprice AS y2 FROM lineitem)"


@query(f"WITH {_POINTS} SELECT cp_id, img1 - CAST(img1 > 40 AS INTEGER) AS img1, img2 - CAST(img2 > 40 AS INTEGER) AS img2 FROM p WHERE img1 <> 40 AND img2 <> 40")
def remove_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.remove_image(_points(spark, sf_dir), 40, "img1", "img2").select("cp_id", "img1", "img2")


@query(f"""
WITH {_POINTS}, s AS (SELECT cp_id, CASE img1 WHEN 3 THEN 70 WHEN 70 THEN 3 ELSE img1 END AS a, CASE img2 WHEN 3 THEN 70 WHEN 70 THEN 3 ELSE img2 END AS b FROM p)
SELECT cp_id, CASE WHEN a = 10 THEN 50 WHEN a BETWEEN 11 AND 50 THEN a - 1 ELSE a END AS img1, CASE WHEN b = 10 THEN 50 WHEN b BETWEEN 11 AND 50 THEN b - 1 ELSE b END AS img2 FROM s
""")
def swap_and_move_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.move_image(edits.swap_images(_points(spark, sf_dir), 3, 70, "img1", "img2"), 10, 50, "img1", "img2").select("cp_id", "img1", "img2")


@query("""
WITH l AS (SELECT c_custkey AS img_nr, min(c_custkey) OVER (PARTITION BY c_nationkey) AS anchor FROM customer), i AS (SELECT c_custkey AS img_nr, row_number() OVER (ORDER BY c_custkey) - 1 AS n, c_nationkey FROM customer WHERE c_acctbal > 0),
a AS (SELECT c_nationkey, min(n) AS first FROM i GROUP BY 1)
SELECT CAST(n AS BIGINT) AS img_nr, CAST(first AS BIGINT) AS anchor FROM i JOIN a USING (c_nationkey) WHERE n <> first
""")
def subset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the images that a subset keeps, with new numbers and anchors."""
    c = table(spark, sf_dir, "customer")
    return edits.subset_links(_nation_links(c), c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("img_nr"))).select(F.col("img_nr").cast("long"), F.col("anchor").cast("long"))


def _nation_links(c: DataFrame, var: str = "y") -> DataFrame:
    known = coverage.lens_anchor(c.select(F.col("c_custkey").alias("img_nr"), "c_nationkey"), "img_nr", "c_nationkey")
    return known.filter("img_nr <> anchor").select(F.lit(var).alias("var"), "img_nr", "anchor")


@query("""
WITH s AS (SELECT c_custkey AS img_nr, dense_rank() OVER (ORDER BY first) - 1 AS stack FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer))
SELECT l_orderkey * 10 + l_linenumber AS cp_id, CAST(a.stack AS BIGINT) AS img1, CAST(b.stack AS BIGINT) AS img2 FROM lineitem JOIN s a ON a.img_nr = l_partkey JOIN s b ON b.img_nr = l_suppkey WHERE l_linenumber = 1 AND a.stack <> b.stack
""")
def unlinked_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points between stacks."""
    c = table(spark, sf_dir, "customer")
    of = edits.stacks(c.select(F.col("c_custkey").alias("img_nr")), _nation_links(c))
    return edits.unlinked_subset(_points(spark, sf_dir), of).select("cp_id", F.col("img1").cast("long"), F.col("img2").cast("long"))


@query("""
WITH v AS (SELECT c_nationkey, arg_max(c_acctbal * 2, c_custkey) AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 12 GROUP BY 1)
SELECT c_custkey AS img_nr, coalesce(value, c_acctbal) AS hfov FROM customer LEFT JOIN v USING (c_nationkey)
""")
def update_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new value for some images, and all that are linked with them."""
    c = table(spark, sf_dir, "customer")
    images = c.select(F.col("c_custkey").alias("img_nr"), F.col("c_acctbal").alias("hfov"))
    values = c.filter("c_mktsegment = 'BUILDING' AND c_nationkey < 12").select(F.col("c_custkey").alias("img_nr"), (F.col("c_acctbal") * 2).alias("value"))
    return edits.update_linked(images, _nation_links(c), "y", "hfov", values)


@query("SELECT c_custkey AS img_nr, c_name AS filename, c_acctbal * 3 AS hfov, c_nationkey + 1 AS projection FROM customer")
def apply_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    images = c.select(F.col("c_custkey").alias("img_nr"), F.col("c_name").alias("filename"), F.col("c_acctbal").alias("hfov"), F.lit(0).alias("projection"))
    template = c.select(F.col("c_custkey").alias("img_nr"), F.lit("other").alias("filename"), (F.col("c_acctbal") * 3).alias("hfov"), (F.col("c_nationkey") + 1).alias("projection"))
    return edits.apply_template(images, template, ["filename"])


@query("""
WITH a AS (SELECT c_custkey AS nr, c_name AS name FROM customer WHERE c_acctbal < 5000), b AS (SELECT c_custkey AS nr, c_name AS name FROM customer WHERE c_acctbal >= 0),
m AS (SELECT b.nr AS old, coalesce(a.nr, (SELECT max(nr) FROM a) + row_number() OVER (PARTITION BY a.nr IS NULL ORDER BY b.nr)) AS new FROM b LEFT JOIN a USING (name)),
q AS (SELECT l_partkey AS img1, l_suppkey AS img2, l_linenumber - 1 AS mode, l_linenumber AS x1, l_linenumber + 1 AS x2 FROM lineitem),
pa AS (SELECT q.* FROM q JOIN a x ON x.nr = img1 JOIN a y ON y.nr = img2), last AS (SELECT greatest(2, max(mode)) AS l FROM pa),
pb AS (SELECT x.new AS img1, y.new AS img2, CASE WHEN mode > 2 THEN mode + l - 2 ELSE mode END AS mode, x1, x2 FROM q JOIN m x ON x.old = img1 JOIN m y ON y.old = img2, last),
e AS (SELECT mode, CASE WHEN img1 > img2 THEN (img2, x2, img1, x1) ELSE (img1, x1, img2, x2) END AS k FROM (SELECT * FROM pa UNION ALL SELECT * FROM pb))
SELECT mode, count(DISTINCT k) AS n FROM e GROUP BY 1
""")
def merge_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two projects as one: image numbers by name, line points moved on, equal points once; here the points of each mode."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img_nr"), F.col("c_name").alias("filename"), "c_acctbal")
    n = F.col("l_linenumber")
    t = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("o"), F.col("l_partkey").alias("img1"), F.col("l_suppkey").alias("img2"), (n - 1).alias("mode"), n.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (n + 1.0).alias("x2"), F.lit(0.0).alias("y2"))
    t = ranking.row_numbers(t.select("o.*", "img1", "img2", "mode", "x1", "y1", "x2", "y2"), "cp_id", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"])
    names = ["cp_id", "img1", "img2", "x1", "y1", "x2", "y2", "mode"]
    t = cut(t.select(*names))  # both projects read them, each more than once

    def project(images: DataFrame) -> dict[str, DataFrame]:
        none = lambda kind: spark.createDataFrame([], kind)
        return {"images": images.drop("c_acctbal"), "points": filters.both_active(t, images).select(*names), "masks": none("img_nr long, mask_type int, poly array<struct<x: double, y: double>>"), "links": none("var string, img_nr long, anchor long")}

    merged = edits.merge_projects(project(c.filter("c_acctbal < 5000")), project(c.filter("c_acctbal >= 0")))
    return merged["points"].groupBy("mode").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS img_nr, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS part FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer)")
def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenses or stacks, numbered by their first image."""
    c = table(spark, sf_dir, "customer")
    return graph.part_numbers(c.select(F.col("c_custkey").alias("img_nr")), _nation_links(c)).select("img_nr", F.col("part").cast("long"))


@query("SELECT c_custkey AS img_nr FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 7)")
def reference_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return edits.reference_images(c.select(F.col("c_custkey").alias("img_nr")), _nation_links(c), 7)


@query("""
WITH k AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_custkey <> 9 THEN 1000 ELSE c_nationkey END AS part FROM customer),
a AS (SELECT c_custkey, CASE WHEN c_custkey = 9 THEN (SELECT part FROM k WHERE c_custkey = 4) ELSE part END AS p FROM k)
SELECT c_custkey AS img_nr, anchor FROM (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY p) AS anchor FROM a) WHERE c_custkey <> anchor
""")
def change_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment's images become a stack of their own; then image 9 goes over to that of image 4."""
    c = table(spark, sf_dir, "customer")
    own = edits.new_part(_nation_links(c), ["y"], c.filter("c_mktsegment = 'BUILDING' AND c_custkey <> 9").select(F.col("c_custkey").alias("img_nr")))
    return edits.change_part(own, ["y"], 9, 4).select("img_nr", "anchor")


@query("SELECT c_custkey AS img_nr, c_custkey // 7 AS stack FROM customer")
def stacks_of_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.fixed_stacks(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img_nr")), 7)


@query("""
WITH i AS (SELECT o_custkey AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % (2 + o_custkey % 3) AS layer FROM orders)
SELECT p AS project_id, k * 1.0 - 1 >= 1.2 AND k >= 2 AND k <> c AND c % k = 0 AND hit AS possible FROM (
    SELECT p, count(*) AS c, count(DISTINCT layer) AS k, coalesce(bool_or(n = (2 + p % 3) AND layer = 0), false) AS hit FROM i GROUP BY p)
""")
def possible_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which projects look bracketed: customers' orders in turn have two to four exposures, one apart."""
    t = relations.local_number(table(spark, sf_dir, "orders").withColumn("_k", F.col("o_custkey")), "o_custkey", "_k", ["o_orderkey"])
    images = t.select(F.col("o_custkey").alias("project_id"), F.col("number").cast("long").alias("img_nr"), (F.col("number") % (F.col("o_custkey") % 3 + 2)).cast("double").alias("ev"))
    return edits.has_possible_stacks(images, estimation.greedy_layers(images, "project_id", 0.3))


@query(f"""
WITH {_POINTS}, a AS (SELECT o_custkey AS img_nr FROM orders WHERE o_orderstatus = 'F')
SELECT cp_id, x1 FROM p WHERE mode = 0 AND img1 IN (SELECT img_nr FROM a) AND img2 IN (SELECT img_nr FROM a) AND x1 < 30
""")
def active_plain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain points with both ends active, under a (negative) threshold."""
    images = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("img_nr"))
    return filters.over_threshold(filters.both_active(filters.plain_points(_points(spark, sf_dir)), images), "x1", -30.0).select("cp_id", "x1")


@query("""
WITH p AS (SELECT p_partkey, (p_size - 25) * 4.0 AS x, (p_retailprice - 1450) * 0.1 AS y FROM part), e AS (SELECT p_partkey, 200 * atan2(x, 200.0) + 300 AS ex, 200 * atan2(y, sqrt(200.0 * 200.0 + x * x)) + 150 AS ey FROM p)
SELECT p_partkey FROM e WHERE NOT (ex BETWEEN 280 AND 340 AND ey BETWEEN 120 AND 170)
""")
def points_outside_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = G.rect_to_erect(200.0)(((F.col("p_size") - 25) * 4.0, (F.col("p_retailprice") - 1450) * 0.1))
    return filters.in_region(table(spark, sf_dir, "part"), at, 600, 300, (280, 120, 340, 170), inside=False).select("p_partkey")


_BOXES = "r AS (SELECT s_suppkey AS img_nr, CAST(s_suppkey % 10 * 37 AS DOUBLE) AS l, CAST(s_suppkey // 10 * 29 AS DOUBLE) AS t, CAST(s_suppkey % 10 * 37 + 60 + s_suppkey % 7 AS DOUBLE) AS rr, CAST(s_suppkey // 10 * 29 + 50 AS DOUBLE) AS b FROM supplier)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    left, top = (k % 10 * 37).cast("double"), (F.floor(k / 10) * 29).cast("double")
    return table(spark, sf_dir, "supplier").select(k.alias("img_nr"), left.alias("left"), top.alias("top"), (left + 60 + k % 7).alias("right"), (top + 50).alias("bottom"))


@query(f"WITH {_BOXES} SELECT img_nr FROM r WHERE greatest(l, 100.0) < least(rr, 250.0) AND greatest(t, 60.0) < least(b, 210.0)")
def images_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.images_in_region(_boxes(spark, sf_dir), (100.0, 60.0, 250.0, 210.0)).select("img_nr")


@query("""
SELECT l_orderkey, l_partkey, l_extendedprice, l_discount * 10 BETWEEN 0.2 AND 0.7 AS exposed FROM lineitem
WHERE greatest(l_discount * 10, l_tax) BETWEEN 1 / 255.0 AND 250 / 255.0 AND greatest(l_tax * 12, l_discount) BETWEEN 1 / 255.0 AND 250 / 255.0
""")
def good_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumns({"r1": F.col("l_discount") * 10, "g1": F.col("l_tax"), "r2": F.col("l_tax") * 12, "g2": F.col("l_discount")})
    good = coverage.good_pairs(t, ["r1", "g1"], ["r2", "g2"])
    return good.select("l_orderkey", "l_partkey", "l_extendedprice", P.well_exposed(F.col("r1"), 0.2, 0.7).alias("exposed"))


@query("""
SELECT p_partkey, p_size * 0.5 < 15 AS good_error, abs(p_size / 100.0 - 0.2) + 0.01 > 0.001 AND abs(p_size / 100.0 - 0.2 + 0.01) < 0.1 AS good_distortion, 1 - p_size / 60.0 > 0.5 AND 1 - p_size / 60.0 <= 1.01 AS good_vignetting FROM part
""")
def plausible_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    t = table(spark, sf_dir, "part").select("p_partkey", (s * 0.5).alias("e"), (s / 100.0 - 0.2).alias("a"), F.lit(0.01).alias("b"), F.lit(1.0).alias("v0"), (-s / 60.0).alias("v1"))
    return filters.plausible(t, "e", ["a", "b"], ["v0", "v1"]).select("p_partkey", "good_error", "good_distortion", "good_vignetting")


_LINES = "l AS (SELECT l_suppkey AS k, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + l_linenumber - 3 AS x2, l_discount * 100 + l_extendedprice / 1000 AS y2, l_tax AS error FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), q.alias("x1"), d.alias("y1"), (q + F.col("l_linenumber") - 3).alias("x2"), (d + F.col("l_extendedprice") / 1000).alias("y2"), F.col("l_tax").alias("error"))


@query(f"""
WITH {_LINES}, f AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS n FROM l), u AS (SELECT * FROM f WHERE n > 20 AND abs(x2 - x1) < 0.1 * n),
s AS (SELECT k, count(*) AS c, avg(error) + stddev_samp(error) AS lim FROM u GROUP BY 1), g AS (SELECT u.*, c FROM u JOIN s USING (k) WHERE c > 1 AND error <= lim), m AS (SELECT k, max(error) AS most FROM g GROUP BY 1 HAVING max(error) > 0),
r AS (SELECT k, error / most + 1 - least(n, 500) / 500 AS merit FROM g JOIN m USING (k)), o AS (SELECT k, merit, row_number() OVER (PARTITION BY k ORDER BY merit) AS i FROM r)
SELECT k, round(merit, 6) AS merit FROM o WHERE i <= 5 UNION ALL SELECT k, 0.0 FROM u JOIN s USING (k) WHERE c = 1 AND abs(x2 - x1) / n < 0.05
""")
def vertical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long upright lines, and the best five of each key."""
    best = filters.vertical_points(filters.upright_lines(_lines(spark, sf_dir)), "k", 5)
    return best.select("k", F.round("merit", 6).alias("merit"))


@query("""
WITH b AS (SELECT p_partkey, 0.0 AS l, 0.0 AS t, p_size * 1.0 AS r, p_retailprice / 50 AS b FROM part), c AS (SELECT p_partkey, greatest(l, 5.0) AS l, greatest(t, 10.0) AS t, least(r, 30.0) AS r, least(b, 35.0) AS b FROM b)
SELECT p_partkey, round((r - l) * (b - t), 6) AS area, round(100 - (t + b), 6) AS turned_x, round((l + r), 6) AS turned_y FROM c WHERE r > l AND b > t
""")
def masks_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles as masks: clipped, doubled and turned by a right angle; their area and centre."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 50
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    masks = spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")).select("p_partkey", F.array(corner(0, 0), corner(w, 0), corner(w, h), corner(0, h)).alias("poly"))
    clipped = edits.clip_masks(masks, F.lit(5.0), F.lit(10.0), F.lit(30.0), F.lit(35.0)).filter(F.abs(coverage.polygon_area(F.col("poly"))) > 1e-9)
    turned = edits.move_masks(clipped, 2.0, 1, F.lit(100.0), F.lit(100.0)).withColumn("c", coverage.polygon_centre(F.col("poly")))
    return turned.select("p_partkey", F.round(F.abs(coverage.polygon_area(F.col("poly"))) / 4, 6).alias("area"), F.round("c.x", 6).alias("turned_x"), F.round("c.y", 6).alias("turned_y"))


@query("""
SELECT a.event_id AS i, b.event_id AS j FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id
WHERE abs(a.value - b.value) <= 2 AND abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 43200
""")
def close_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one user's events of a kind, alike in value and near in time."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    near = filters.close_matches(e, e, ["user_id", "event_type"], "value", 2.0, "ts", 43_200)
    return near.filter("event_id < r_event_id").select(F.col("event_id").alias("i"), F.col("r_event_id").alias("j"))


@query(f"WITH {_POINTS} SELECT c_custkey AS img_nr FROM customer WHERE c_custkey NOT IN (SELECT img1 FROM p WHERE mode = 0 UNION SELECT img2 FROM p WHERE mode = 0)")
def images_without_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.without_points(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img_nr")), _points(spark, sf_dir))


@query(f"""
WITH {_BOXES}, {_POINTS}, g AS (SELECT img_nr AS i, l + (rr - l) * (a + 0.5) / 10 AS x, t + (b - t) * (c + 0.5) / 10 AS y FROM r, range(10) q(a), range(10) p(c)),
d AS (SELECT i, img_nr AS j, count(*) / 100 AS ratio FROM g, r WHERE x >= l AND x < rr AND y >= t AND y < b AND i <> img_nr GROUP BY 1, 2), o AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(ratio) AS ratio FROM d GROUP BY 1, 2)
SELECT i, j, ratio FROM o WHERE ratio > 0.1 AND NOT EXISTS (SELECT 1 FROM p WHERE least(img1, img2) = i AND greatest(img1, img2) = j)
""")
def unconnected_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs that no point joins."""
    o = coverage.symmetric_overlap(coverage.overlap_ratios(_boxes(spark, sf_dir)))
    return filters.unconnected_overlaps(o, _points(spark, sf_dir), 0.1)


@query("SELECT least(c_custkey, 5) AS i, greatest(c_custkey, 5) AS j FROM customer WHERE c_custkey <> 5")
def focus_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.focus_pairs(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img_nr")), 5)


@query("""
WITH m AS (SELECT l_suppkey AS k, l_partkey AS x, l_quantity AS y, l_extendedprice AS s FROM lineitem), r AS (SELECT k, min(x) AS x0, max(x) - min(x) + 2 AS xs, min(y) AS y0, max(y) - min(y) + 2 AS ys FROM m GROUP BY 1),
c AS (SELECT DISTINCT k, CAST(floor((x - x0) * 5 / xs) AS INTEGER) AS cell_x, CAST(floor((y - y0) * 5 / ys) AS INTEGER) AS cell_y, s FROM m JOIN r USING (k))
SELECT k, cell_x, cell_y, max(s) AS s FROM c GROUP BY 1, 2, 3
""")
def match_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("x"), F.col("l_quantity").alias("y"), F.col("l_extendedprice").alias("s"))
    return filters.match_sieve(m, ["k"], "x", "y", ["s"]).select("k", "cell_x", "cell_y", "s")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n BETWEEN 11 AND 30")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10, 20)


@query("""
WITH d AS (SELECT l_suppkey AS k, l_orderkey AS id, l_linenumber AS ln, abs(l_extendedprice - 40000) AS d FROM lineitem)
SELECT k, id, ln, d FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, id, ln) AS n FROM d WHERE d < 5000) WHERE n <= 3
""")
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest within a radius."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.abs(F.col("l_extendedprice") - 40_000).alias("d"))
    return ranking.within(t, "d", 5000.0, 3, ["k"], ["id", "ln"])


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten orders of each priority by a seeded hash, which DuckDB hasn't; a test holds it."""
    return ranking.seeded_sample(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), 10, ["o_orderpriority"], ["o_orderkey"])


@query()
def sessions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the order of their value join the first session whose span is near; a test holds it by brute force."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    return graph.first_matching_sessions(e, ["user_id"], "ts", ["value", "event_id"], 21_600).select("user_id", "event_id", "session")


@query("SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 3 AS INTEGER) AS half FROM events")
def split_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.split_session(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 3, "event_type").select("user_id", "event_type", "event_id", "half")


# ---- statistics


@query(f"WITH {_POINTS} SELECT count(*) AS n, coalesce(min(y2), 1000000.0) AS min, coalesce(max(y2), 0.0) AS max FROM p WHERE img1 = 7 AND img2 = 7")
def own_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image's own statistics count points with both ends in it."""
    return statistics.error_stats(statistics.own_points(_points(spark, sf_dir), 7), "y2").select("n", "min", "max")


@query("""
WITH e AS (SELECT l_partkey AS img, l_quantity AS x, l_discount * 100 AS y FROM lineitem UNION ALL SELECT l_suppkey, l_linenumber * 5, l_tax * 100 FROM lineitem),
r AS (SELECT sqrt((x - 30) * (x - 30) + (y - (10 + p_size) / 2.0) * (y - (10 + p_size) / 2.0)) / ((10 + p_size) / 2.0) AS r FROM e JOIN part ON p_partkey = img), s AS (SELECT list_sort(list(r)) AS v, count(*) AS n FROM r)
SELECT n, round(v[CAST(floor(0.1 * n) AS BIGINT) + 1], 6) AS q10, round(v[CAST(floor(0.9 * n) AS BIGINT) + 1], 6) AS q90, round((SELECT avg(r) FROM r), 6) AS mean FROM s
""")
def radial_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    points = t.select(F.col("l_partkey").alias("img1"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"), F.col("l_suppkey").alias("img2"), (F.col("l_linenumber") * 5).alias("x2"), (F.col("l_tax") * 100).alias("y2"))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_nr"), F.lit(60).alias("width"), (F.col("p_size") + 10).alias("height"))
    return statistics.radial_stats(points, images).select("n", F.round("q10", 6).alias("q10"), F.round("q90", 6).alias("q90"), F.round("mean", 6).alias("mean"))


@query("SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice) - min(o_totalprice), 4) AS range, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 1")
def exposure_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.exposure_range(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", "o_orderstatus")
    return found.select("o_orderstatus", F.round("mean", 4).alias("mean"), F.round("range", 4).alias("range"), "groups")


@query(f"""
WITH p AS {_PIXELS}, b AS (SELECT x, min(l_suppkey) AS l, max(l_suppkey) AS r, min(y) AS t, max(y) AS b FROM p GROUP BY 1), n AS (SELECT x, count(*) FILTER (m > 0.5) AS n FROM p GROUP BY 1), v AS (SELECT x, arg_max(v, (epoch_us(l_shipdate), v)) AS v FROM p WHERE m > 0.3 GROUP BY 1)
SELECT x, l AS "left", r AS "right", t AS top, b AS bottom, n, v FROM b JOIN n USING (x) JOIN v USING (x)
""")
def regions_counted_and_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    painted = statistics.paint(p, "v", ["l_shipdate"], F.col("m") > 0.3, "x")
    return statistics.boxes(p, "l_suppkey", "y", "x").join(statistics.count_in_mask(p, F.col("m") > 0.5, "x"), "x").join(painted, "x")


@query("""
WITH p AS (SELECT l_partkey % 50 AS x, l_suppkey % 50 AS y, sum(l_linenumber) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.x, a.y, count(*) AS n, round(avg(b.v), 6) AS mean, round(var_pop(b.v), 4) AS variance FROM p a JOIN p b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY 1, 2
""")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y")).agg(F.sum("l_linenumber").alias("v"))
    s = statistics.window_stats(p, "x", "y", "v", 2)
    return s.select("x", "y", F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT o_orderpriority, max(greatest(0, o_totalprice / 1000 - 200)) AS scale, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def scale_and_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest scale that an image needs; jobs of a queue and those that failed."""
    o = table(spark, sf_dir, "orders")
    return statistics.best_scale(o, F.col("o_totalprice") / 1000 - 200, "o_orderpriority").join(statistics.queue_counts(o, "o_orderstatus", "F", "o_orderpriority"), "o_orderpriority")


@query("""
WITH s AS (SELECT p_brand AS k, p_partkey AS n, CAST(p_size % 2 AS DOUBLE) AS m, p_retailprice AS v FROM part), w AS (SELECT k, max(n) FILTER (m > 0) AS last FROM s GROUP BY 1)
SELECT k, v AS hdr FROM s JOIN w USING (k) WHERE n = last
""")
def hdr_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without weight: the kept weight stays 0, so the last bright one is taken."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("n"), (F.col("p_size") % 2).cast("double").alias("m"), F.col("p_retailprice").alias("v"))
    return statistics.hdr_in_order(t, "v", "m", "n", "k")


@query("WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, s WHERE l_extendedprice > CASE WHEN d > m THEN m ELSE m + 1.5 * d END")
def clean_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over the limit of the whole project."""
    return statistics.over_limit(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 1.5)


@query("""
SELECT l_orderkey, min(l_partkey) AS a FROM (SELECT l_orderkey, l_partkey, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, l_linenumber FROM lineitem) GROUP BY l_orderkey, lo, hi, l_linenumber
""")
def distinct_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of an order equal but for their direction, once: the one of the smallest part."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("img1"), F.col("l_suppkey").alias("img2"), F.col("l_linenumber").alias("mode"))
    key = [F.col("l_orderkey"), relations.pair_key(F.col("img1"), F.col("img2")), F.col("mode")]
    return relations.first_of(t, key, ["img1"]).select("l_orderkey", F.col("img1").alias("a"))


@query(f"WITH {_POINTS} SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT mode, CASE WHEN img1 > img2 THEN (img2, printf('%.6g', x2), img1, printf('%.6g', x1)) ELSE (img1, printf('%.6g', x1), img2, printf('%.6g', x2)) END AS k FROM (SELECT mode, img1, img2, x1 / 7 AS x1, x2 + 1 AS x2 FROM p))")
def canonical_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points differ in mode and ends, coordinates as printed to six digits."""
    p = _points(spark, sf_dir).withColumn("cp_id", F.monotonically_increasing_id()).withColumns({"x1": F.col("x1") / 7, "x2": F.col("x2") + 1, "y1": F.lit(0.0), "y2": F.lit(0.0)})
    return relations.distinct_points(p).agg(F.count("*").alias("n"))


# ---- geometry


@query("""
WITH p AS (SELECT p_partkey, (p_size - 25) * 4.0 AS x, (p_retailprice - 1450) * 0.1 AS y FROM part), v AS (SELECT *, abs(y) / 150 AS r FROM p)
SELECT p_partkey, round(y * (1.01 + r * (-0.02 + r * (0.01 + r * 0.001))), 6) AS vertical, round(x + abs(y) * (0.01 + r * (0.02 + r * 0.03)), 6) AS deregister, round(((x - 3) * cos(0.3) - (y - 4) * sin(0.3)) * 1.5, 6) AS turned,
       round(y, 4) AS back, round(x * (1 + 0.1 * sqrt(x * x + y * y) / 150) + 7, 6) AS shifted FROM v
""")
def plane_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("p_size") - 25) * 4.0, (F.col("p_retailprice") - 1450) * 0.1)
    c = (1.01, -0.02, 0.01, 0.001)
    there = G.vertical(c, 150.0)(p)
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")).select(
        "p_partkey", F.round(there[1], 6).alias("vertical"), F.round(G.deregister((0.01, 0.02, 0.03), 150.0)(p)[0], 6).alias("deregister"), F.round(G.shift_scale_rotate(3, 4, 1.5, 0.3)(p)[0], 6).alias("turned"),
        (F.round(G.undo_vertical(c, 150.0)(there)[1], 4) + 0.0).alias("back"), F.round(G.radial_shift((1.0, 0.1, 0.0, 0.0), 150.0, 7, 8)(p)[0], 6).alias("shifted"),
    )


@query("""
WITH p AS (SELECT p_partkey, (p_size - 25.5) * 4.0 AS x, (p_retailprice - 1450.05) * 0.1 AS y FROM part), r AS (SELECT *, sqrt(x * x + y * y) / 200 AS r, 200 * sin(x / 200) AS s FROM p)
SELECT p_partkey, round(tan(r) / r * x, 6) AS sphere_rect, round(atan(r) / r * x, 6) AS rect_sphere, round(200 * atan2(sqrt(s * s + y * y), 200 * cos(x / 200)) / sqrt(s * s + y * y) * s, 6) AS pano_sphere,
       round(200 * atan2(sin(r) / (r * 200) * x, cos(r)), 6) AS sphere_pano, round(200 * atan(x / 200), 6) AS rect_pano, round(y / cos(x / 200), 6) AS pano_rect,
       round(-(y + 10) / (pi() / 2) * cos(-x / (200 * pi() / 2)), 6) AS cp, round(sqrt(x * x + y * y) - 10, 6) AS cp_back, round(200 * tan(y / 200), 6) AS transverse FROM r
""")
def sphere_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = 200.0
    p = ((F.col("p_size") - 25.5) * 4.0, (F.col("p_retailprice") - 1450.05) * 0.1)
    r = lambda q, k, name: F.round(q[k], 6).alias(name)
    return table(spark, sf_dir, "part").select(
        "p_partkey", r(G.sphere_to_rect(d)(p), 0, "sphere_rect"), r(G.rect_to_sphere(d)(p), 0, "rect_sphere"), r(G.pano_to_sphere(d)(p), 0, "pano_sphere"), r(G.sphere_to_pano(d)(p), 0, "sphere_pano"), r(G.rect_to_pano(d)(p), 0, "rect_pano"),
        r(G.pano_to_rect(d)(p), 1, "pano_rect"), r(G.erect_to_sphere_cp(d, 10.0)(p), 0, "cp"), r(G.sphere_cp_to_erect(d, 10.0)(p), 1, "cp_back"), r(G.erect_to_transpano(d)(p), 1, "transverse"),
    )


_TURN = G.rotation(20, 10, 5)


@query(f"""
WITH p AS (SELECT p_partkey, (p_size - 25.5) * 4.0 AS x, (p_retailprice - 1450.05) * 0.1 AS y FROM part), r AS (SELECT *, sqrt(x * x + y * y) AS r FROM p),
v AS (SELECT *, sin(r / 200) / r * x AS a, sin(r / 200) / r * y AS b, cos(r / 200) AS c FROM r),
t AS (SELECT *, {", ".join(f"{m[0]!r}e0 * a + {m[1]!r}e0 * b + {m[2]!r}e0 * c AS u{k}" for k, m in enumerate(_TURN))}, {", ".join(f"{m[0]!r}e0 * (x + 1) + {m[1]!r}e0 * (y + 2) + {m[2]!r}e0 * 200 AS w{k}" for k, m in enumerate(_TURN))} FROM v)
SELECT p_partkey, round(200 * atan2(sqrt(u0 * u0 + u1 * u1), u2) / sqrt(u0 * u0 + u1 * u1) * u0, 5) AS sphere_x, round(w1 * 200 / w2, 4) AS rect_y,
       round(-50 * sin(r / 200 / 2) * cos(atan2(y, x)), 6) AS mirror, round((0.9 * x + 0.1 * y + 3) / (0.0001 * x + 0.0002 * y + 1), 6) AS plane FROM t
""")
def perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ((F.col("p_size") - 25.5) * 4.0, (F.col("p_retailprice") - 1450.05) * 0.1)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(G.persp_sphere(_TURN, 200.0)(p)[0], 5).alias("sphere_x"), F.round(G.persp_rect(_TURN, 200.0, 1.0, 2.0)(p)[1], 4).alias("rect_y"), F.round(G.sphere_cp_to_mirror(200.0, 50.0)(p)[0], 6).alias("mirror"),
        F.round(G.homography((0.9, 0.1, 3, 0.05, 1.1, 4, 0.0001, 0.0002, 1))(p)[0], 6).alias("plane"),
    )


@query("""
WITH i AS (SELECT p_partkey, (p_size - 25.5) * 10 AS x, (p_retailprice - 1450.05) * 0.3 AS y, [0, 1, 2, 4][p_partkey % 4 + 1] AS kind, p_partkey % 60 - 30 AS yaw FROM part),
d AS (SELECT *, CASE WHEN kind = 0 THEN 500 / tan(radians(50.0) / 2) ELSE 1000 / radians(50.0) END AS d, 2000 / radians(360.0) AS t FROM i),
e AS (SELECT *, CASE kind WHEN 0 THEN d * atan2(x, d) WHEN 2 THEN d * atan2(sin(sqrt(x * x + y * y) / d) / sqrt(x * x + y * y) * x, cos(sqrt(x * x + y * y) / d)) ELSE x END AS ex FROM d)
SELECT p_partkey, round(fmod(ex / d * t + radians(yaw) * t + 3000, 2000) - 1000, 3) AS x, round(x, 3) AS back_x, round(y, 3) AS back_y FROM e
""")
def image_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of images of four projections in the panorama, and back: each row is an image of its own."""
    k = F.col("p_partkey")
    p = ((F.col("p_size") - 25.5) * 10, (F.col("p_retailprice") - 1450.05) * 0.3)
    kinds = F.element_at(F.array(*(F.lit(x) for x in (0, 1, 2, 4))), (k % 4 + 1).cast("int"))
    image = {"projection": kinds, "hfov": F.lit(50.0), "width": F.lit(1000.0), "yaw": (k % 60 - 30).cast("double"), "pitch": F.lit(0.0), "roll": F.lit(0.0)}
    q = G.image_to_panorama(p, image, 360.0, 2000.0)
    b = G.panorama_to_image(q, image, 360.0, 2000.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(q[0], 3).alias("x"), (F.round(b[0], 3) + 0.0).alias("back_x"), (F.round(b[1], 3) + 0.0).alias("back_y"))


@query()
def turned_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of all images after the panorama is turned; a test holds them against matrices in numpy."""
    y, p, r = G.turned_angles(F.col("c_acctbal") % 180, (F.col("c_custkey") % 80).cast("double"), (F.col("c_nationkey") * 3).cast("double"), (20.0, -10.0, 5.0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(y, 6).alias("yaw"), F.round(p, 6).alias("pitch"), F.round(r, 6).alias("roll"))


@query(f"WITH {_BOXES} SELECT (min(l) + max(rr)) / 2 AS centre_x, (min(t) + max(b)) / 2 AS centre_y, 2 * greatest(max(abs(l)), max(abs(rr))) AS width, 2 * greatest(max(abs(t)), max(abs(b))) AS height FROM r")
def fitted_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.fitted(_boxes(spark, sf_dir))


@query("""
WITH i AS (SELECT s_suppkey AS img_nr, 100.0 + s_suppkey % 7 * 10 AS w, 80.0 + s_nationkey AS h FROM supplier)
SELECT img_nr, round(-200 * atan2(w / 2, 200.0), 6) AS "left", round(200 * atan2(w / 2, 200.0), 6) AS "right", round(-200 * atan2(h / 2, 200.0), 6) AS top, round(200 * atan2(h / 2, 200.0), 6) AS bottom FROM i
""")
def output_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What images cover, from a grid of their points."""
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img_nr"), (F.col("s_suppkey") % 7 * 10 + 100.0).alias("width"), (F.col("s_nationkey") + 80.0).alias("height"))
    b = coverage.output_boxes(images, G.rect_to_erect(200.0))
    return b.select("img_nr", *(F.round(c, 6).alias(c) for c in ("left", "right", "top", "bottom")))


_BITS = "m AS (SELECT l_partkey % 24 AS x, l_suppkey % 20 AS y, sum(l_linenumber) % 7 > 0 AS ok FROM lineitem GROUP BY 1, 2)"


@query(f"""
WITH {_BITS}, c AS (SELECT a.a AS l, b.b + 1 AS r, t.t AS t, u.u + 1 AS b FROM range(24) a(a), range(24) b(b), range(20) t(t), range(20) u(u) WHERE b.b >= a.a AND u.u >= t.t),
f AS (SELECT l, r, t, b, (r - l) * (b - t) AS area FROM c JOIN m ON ok AND x >= l AND x < r AND y >= t AND y < b GROUP BY ALL HAVING count(*) = (r - l) * (b - t))
SELECT l AS "left", t AS top, r AS "right", b AS bottom, area FROM f ORDER BY area DESC, t, l, b, r LIMIT 1
""")
def largest_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 24).alias("x"), (F.col("l_suppkey") % 20).alias("y")).agg((F.sum("l_linenumber") % 7 > 0).alias("ok"))
    return coverage.largest_rectangle(m, "x", "y", F.col("ok"))


@query()
def levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upright axis of a panorama from its images' side axes; a test holds it against numpy."""
    y = F.radians(F.col("c_acctbal"))
    axes = table(spark, sf_dir, "customer").select(F.cos(y).alias("x"), F.sin(y).alias("y"), (0.1 * F.sin(y) + 0.05).alias("z"))
    found = coverage.levelled(axes)
    return spark.createDataFrame([tuple(round(c, 6) for c in found)] if found else [], "x double, y double, z double")


# ---- scalars and photometry


_D = (36.0 * 36.0 + 24.0 * 24.0) ** 0.5


@query(f"""
WITH s AS (SELECT p_partkey, {_D!r} / 1.5 / sqrt(1 + 1 / ((3000.0 / 2000) * (3000.0 / 2000))) AS w, 8.0 + p_size AS f FROM part), a AS (SELECT *, 2 * atan(w / 2 / f) AS r FROM s)
SELECT p_partkey, round(degrees(r), 6) AS rectilinear, round(degrees(w / f), 6) AS cylinder, round(degrees(2 * asin(w / 2 / f - floor(w / 2 / f)) + floor(w / 2 / f) * pi()), 6) AS orthographic, round(degrees(2 * asin(least(1, w / 2 / f / 1.47)) / 0.713), 6) AS thoby,
       round(degrees(4 * asin(least(1, w / 4 / f))), 6) AS equisolid, round(f, 6) AS back, 1.5 AS crop, round(degrees(2 * atan(0.5 * tan(r / 2))), 6) AS vfov FROM a
""")
def lens_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of view of all lenses from crop factor and focal length, and back."""
    f, w = F.col("p_size") + 8.0, S.sensor_width(1.5, 3000, 2000)
    six = lambda c: F.round(c, 6)
    angle = S.hfov(f, w, "rectilinear")
    return table(spark, sf_dir, "part").select(
        "p_partkey", *(six(S.hfov(f, w, k)).alias(k) for k in ("rectilinear", "cylinder", "orthographic", "thoby", "equisolid")), six(S.focal(S.hfov(f, w, "thoby"), w, "thoby")).alias("back"),
        F.round(S.crop_factor(angle, f * 2, 3000, 2000, "rectilinear"), 6).alias("crop"), six(S.vfov(angle, 2000, 1000, "rectilinear")).alias("vfov"),
    )


@query("""
WITH v AS (SELECT p_partkey, p_retailprice / 4000 AS v, p_size / 60.0 AS r FROM part), l AS (SELECT *, v * (1 - 0.2 * r * r) * 1.5 * 1.1 AS light FROM v)
SELECT p_partkey, round(light, 6) AS linear, round(CASE WHEN light >= 1 THEN 1 ELSE pow(floor(light * 15) / 15, 0.5) + (light * 15 - floor(light * 15)) * (pow((floor(light * 15) + 1) / 15, 0.5) - pow(floor(light * 15) / 15, 0.5)) END, 6) AS recorded, round(v, 6) AS back,
       round(pow(v, 2.2) / 0.8 * 2 + 0.1, 6) AS divided, round(pow(v, 2.2) / (0.8 / 0.5) * 2 + 0.1, 6) AS flat, round((pow(v, 2.2) + 0.8) * 2 + 0.1, 6) AS added FROM l
""")
def camera_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light through vignetting, exposure, white balance and a response table, and back; corrections by factor, flat field and term."""
    v, r = F.col("p_retailprice") / 4000, F.col("p_size") / 60.0
    c, t = (1.0, -0.2, 0.0, 0.0), P.gamma_table(0.5, 16)
    seen = P.respond(v, r, c, 1.5, 1.1, t)
    six = lambda x: F.round(x, 6)
    fixed = lambda how: six(P.corrected(v, F.lit(0.8), how, 0.5, 2.2, 2.0, 0.1)).alias({"divide": "divided", "flat": "flat", "add": "added"}[how])
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")).select("p_partkey", six(P.respond(v, r, c, 1.5, 1.1)).alias("linear"), six(seen).alias("recorded"), F.round(P.unrespond(seen, r, c, 1.5, 1.1, t), 6).alias("back"), fixed("divide"), fixed("flat"), fixed("add"))


@query("""
WITH k AS (SELECT p_partkey, unnest(range(0, 9)) AS k, p_size / 50.0 AS g FROM part)
SELECT p_partkey, round(sum(CASE WHEN k < 5 THEN pow(k / 4.0, g) ELSE 0 END), 8) AS five, round(sum(CASE WHEN k % 2 = 0 THEN pow(k / 8.0, g) ELSE (pow((k - 1) / 8.0, g) + pow((k + 1) / 8.0, g)) / 2 END), 8) AS nine,
       round(sum(CASE WHEN k < 5 THEN pow(k / 4.0, g) + 0.1 * k - 0.2 * k * k ELSE 0 END), 8) AS basis FROM k GROUP BY 1
""")
def response_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a gamma (five entries), resized to nine, and from a basis of two curves."""
    g = F.col("p_size") / 50.0
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.pow(k / 4, g))
    total = lambda t: F.round(F.aggregate(t, F.lit(0.0), lambda a, x: a + x), 8)
    curves = [F.array(*(F.lit(float(k)) for k in range(5))), F.array(*(F.lit(float(k * k)) for k in range(5)))]
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", total(five).alias("five"), total(P.resize_table(five, 9)).alias("nine"), total(P.basis_table(five, curves, [0.1, -0.2])).alias("basis"))


@query("""
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT e.id, list_zip(e.v, o.v) AS p FROM e, (SELECT v FROM e WHERE id = 0) o)
SELECT id, round(list_sum([pow(abs(x[1] - x[2]), 3) FOR x IN p]), 6) AS minkowski3, round(list_sum([CASE WHEN x[1] > 0 AND x[2] > 0 THEN x[1] * ln(x[1] / x[2]) ELSE 0 END FOR x IN p]), 6) AS kullback, round(list_sum([pow(sqrt(abs(x[1])) - sqrt(abs(x[2])), 2) FOR x IN p]), 6) AS hellinger,
       CAST(list_sum([bit_count(xor(CAST(floor(abs(x[1]) * 8) AS INTEGER), CAST(floor(abs(x[2]) * 8) AS INTEGER))) FOR x IN p]) AS INTEGER) AS hamming FROM z
""")
def more_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    one = e.filter("id = 0").select(F.col("v").alias("o"))  # a single row
    bits = lambda c: F.transform(c, lambda x: F.floor(F.abs(x) * 8).cast("int"))
    return e.crossJoin(F.broadcast(one)).select("id", *(F.round(S.distance(k, F.col("v"), F.col("o")), 6).alias(k) for k in ("minkowski3", "kullback", "hellinger")), S.hamming(bits("v"), bits("o")).alias("hamming"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 AND p_partkey % 3 > 0 THEN p_size * 1.0 / 20 ELSE 1 END AS red, round(CASE WHEN p_partkey % 4 > 0 THEN sqrt(36.0 * 36 + 24 * 24) / sqrt(pow(4000 * 25.4 / (2000 + p_size), 2) + pow(3000 * 25.4 / (2000 + p_size), 2)) END, 6) AS crop,
       strptime('2024:01:' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') || ' 10:20:30', '%Y:%m:%d %H:%M:%S') AS taken FROM part
""")
def exif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White balance, crop factor and time from what cameras note."""
    s, k = F.col("p_size"), F.col("p_partkey")
    balance = S.white_balance(F.when(s > 25, s), F.when(k % 3 > 0, 20), F.lit(30))
    per = F.when(k % 4 > 0, s + 2000.0)
    crop = S.exif_crop(F.lit(3000), F.lit(4000), per, per, F.lit(2), F.lit(10), F.lit(10))
    text = F.concat(F.lit("2024:01:"), F.lpad((s % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:20:30"))
    return table(spark, sf_dir, "part").select("p_partkey", balance["red"].alias("red"), F.round(crop, 6).alias("crop"), S.photo_time(text).cast("timestamp_ntz").alias("taken"))


# ---- graphs and plans


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey + 100 AS a, n_regionkey AS b FROM nation UNION ALL SELECT r_regionkey, r_regionkey - 1 FROM region WHERE r_regionkey > 0),
n AS (SELECT a AS n FROM e UNION SELECT b FROM e), r AS (SELECT min(n) AS n FROM n UNION SELECT CASE WHEN e.a = r.n THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.n OR e.b = r.n)
SELECT (SELECT count(*) FROM n) > 0 AND (SELECT count(*) FROM n) = (SELECT count(*) FROM r WHERE n IS NOT NULL) AS connected
""")
def is_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions, joined by their keys and all regions in a row, are one component."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("a"), F.col("n_regionkey").alias("b"))
    r = table(spark, sf_dir, "region").filter("r_regionkey > 0").select(F.col("r_regionkey").alias("a"), (F.col("r_regionkey") - 1).alias("b"))
    e = n.union(r)
    return graph.is_connected(graph.components(e.select(F.col("a").alias("node")).union(e.select("b")).distinct(), e))


@query()
def blending_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first over overlaps from image 12; a test holds it by brute force."""
    b = _boxes(spark, sf_dir)
    o = coverage.symmetric_overlap(coverage.overlap_ratios(b))
    return graph.blending_order(b.select("img_nr"), o, 12)


@query()
def greedy_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that overlap by more than a third, greedily from the first one, in projects of ten images; a test holds it by brute force."""
    b = _boxes(spark, sf_dir)
    o = coverage.symmetric_overlap(coverage.overlap_ratios(b)).withColumn("p", F.floor(F.col("i") / 10)).filter("floor(j / 10) = p")
    return estimation.greedy_stacks(o.select("p", "i", "j", "ratio"), b.select(F.floor(F.col("img_nr") / 10).alias("p"), "img_nr"), "p", 0.3)


@query("""
WITH s AS (SELECT s_suppkey AS n, s_suppkey // 5 AS stack, lead(s_suppkey) OVER (PARTITION BY s_suppkey // 5 ORDER BY s_suppkey) AS m FROM supplier), l AS (SELECT s_suppkey AS n, lead(s_suppkey) OVER (ORDER BY s_suppkey) AS m FROM supplier WHERE s_suppkey % 5 = 0)
SELECT 1 AS step, n AS i, m AS j FROM s WHERE m IS NOT NULL UNION SELECT 1, n, m FROM l WHERE m IS NOT NULL
UNION SELECT 2, a * 25 + d, CASE WHEN e = 0 THEN a * 25 + 20 ELSE (a + 1) * 25 + f END FROM (SELECT unnest(range(0, (SELECT CAST((max(s_suppkey) + 1) // 25 AS BIGINT) FROM supplier))) AS a), (VALUES (0), (20)) d(d), (VALUES (0), (1)) e(e), (VALUES (0), (20)) f(f)
    WHERE (e = 0 AND d = 0 AND f = 0) OR (e = 1 AND (a + 1) * 25 < (SELECT max(s_suppkey) FROM supplier) AND NOT (d = 20 AND f = 0))
""")
def multi_row_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to match of stacks of five: those in stacks, those along the first images, and then ends of what is still apart (blocks of 25)."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    layer = s.filter(k % 5 == 0).select(k.alias("img_nr"))
    stacks = s.select(F.floor(k / 5).alias("stack"), (k % 5).alias("place"), k.alias("img_nr"))
    # points were found along rows of five first images
    points = layer.filter("img_nr % 25 < 20").select(F.col("img_nr").alias("img1"), (F.col("img_nr") + 5).alias("img2"), F.lit(0).alias("mode"))
    return filters.multi_row_plan(layer, stacks, points)


@query(f"""
WITH {_BOXES}, g AS (SELECT img_nr AS i, l + (rr - l) * (a + 0.5) / 10 AS x, t + (b - t) * (c + 0.5) / 10 AS y FROM r, range(10) q(a), range(10) p(c)), o AS (SELECT DISTINCT i, img_nr AS j FROM g, r WHERE x >= l AND x < rr AND y >= t AND y < b AND i <> img_nr),
m AS (SELECT img_nr, img_nr % 3 AS kind FROM r WHERE img_nr % 10 = 0)
SELECT DISTINCT img_nr, kind FROM (SELECT img_nr, kind FROM m UNION ALL SELECT j, kind FROM m JOIN o ON o.i = img_nr UNION ALL SELECT i, kind FROM m JOIN o ON o.j = img_nr)
""")
def masks_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks spread to the images that overlap their own."""
    b = _boxes(spark, sf_dir)
    masks = b.filter("img_nr % 10 = 0").select("img_nr", (F.col("img_nr") % 3).alias("kind"))
    return coverage.spread_masks_by_overlap(masks, coverage.symmetric_overlap(coverage.overlap_ratios(b)))


@query()
def ransac_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robust line of each supplier's lines; draws have no SQL, a test holds the operator against a known line."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return estimation.ransac_line(t, ["k"], 10.0).select("k", F.round("slope", 6).alias("slope"), F.round("offset", 6).alias("offset"), "n", "inliers")


@query("""
SELECT s_suppkey AS cp_id FROM supplier WHERE (s_suppkey % 10) * 10.0 >= 20 AND (s_suppkey % 10) * 10.0 < 60 AND s_suppkey % 4 * 10.0 > 5 AND s_suppkey % 4 * 10.0 < 25 AND s_nationkey < 20
""")
def points_in_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points an end of which is in a mask of its image; of a mask's border, the left and upper sides belong to it."""
    k = F.col("s_suppkey")
    points = table(spark, sf_dir, "supplier").select(k.alias("cp_id"), F.col("s_nationkey").alias("img1"), (k % 10 * 10.0).alias("x1"), (k % 4 * 10.0).alias("y1"), F.lit(-1).alias("img2"), F.lit(0.0).alias("x2"), F.lit(0.0).alias("y2"))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    masks = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("img_nr"), F.array(corner(20.0, 5.0), corner(60.0, 5.0), corner(60.0, 25.0), corner(20.0, 25.0)).alias("poly"))
    return relations.in_masks(points, masks).select("cp_id")


@query("SELECT s_suppkey AS img_nr, s_nationkey % 4 AS kind FROM supplier UNION SELECT s_suppkey, 9 FROM supplier WHERE s_acctbal > 0")
def masks_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New masks join an image's, unless it has their equal."""
    s = table(spark, sf_dir, "supplier")
    old = s.select(F.col("s_suppkey").alias("img_nr"), (F.col("s_nationkey") % 4).alias("kind"))
    new = old.filter("img_nr % 2 = 0").union(s.filter("s_acctbal > 0").select("s_suppkey", F.lit(9)))
    return relations.add_missing_masks(old, new, ["img_nr", "kind"])


@query("""
WITH i AS (SELECT s_suppkey AS img_nr, s_acctbal AS "TrX", s_nationkey * 1.0 AS "TrY" FROM supplier)
SELECT i.img_nr, round(coalesce(a."TrX", i."TrX") + 2.5, 4) AS "TrX", i."TrY" - 1.0 AS "TrY" FROM i LEFT JOIN i a ON i.img_nr % 7 > 0 AND a.img_nr = i.img_nr - i.img_nr % 7
""")
def translated_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's images moved in two directions; groups of seven share the first one's place along x."""
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img_nr"), F.col("s_acctbal").alias("TrX"), (F.col("s_nationkey") * 1.0).alias("TrY"))
    links = images.filter("img_nr % 7 > 0").select("img_nr", F.lit("TrX").alias("name"), (F.col("img_nr") - F.col("img_nr") % 7).alias("anchor"))
    return edits.translated(images, {"TrX": 2.5, "TrY": -1.0}, links).select("img_nr", F.round("TrX", 4).alias("TrX"), F.col("TrY").cast("double").alias("TrY"))
