"""Registered queries of the fits, the neighbour indexes, seams and rasters. Observations are made from the tables' rows by a model with planted
parameters, which the fit doesn't see and the SQL states; pixels and points are the tables' own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import forest, geometric, kmeans_tree, least_squares, lines, photometric, raster, seams
from ..session import cut, spread
from .queries import query, table

# ---- photometric fits


def _planted(g: Column, i: Column) -> dict[str, Column]:
    own = lambda c, neutral: F.when(i == 0, F.lit(neutral)).otherwise(c)
    return {
        "Eev": own(((g * 5 + i * 3) % 11 - 5) / 20, 0.0), "Er": own(1 + ((g + i * 2) % 7 - 3) / 20, 1.0), "Eb": own(1 + ((g * 2 + i) % 5 - 2) / 20, 1.0),
        "Vb": -0.1 - 0.05 * g, "Vc": 0.04 * (g - 1), "Vd": F.lit(0.02) + 0 * g,
    }


_PLANTED_SQL = """CASE WHEN i = 0 THEN 0 ELSE ((g * 5 + i * 3) % 11 - 5) / 20 END AS "Eev", CASE WHEN i = 0 THEN 1 ELSE 1 + ((g + i * 2) % 7 - 3) / 20 END AS "Er", CASE WHEN i = 0 THEN 1 ELSE 1 + ((g * 2 + i) % 5 - 2) / 20 END AS "Eb",
    round(-0.1 - 0.05 * g, 3) AS "Vb", round(0.04 * (g - 1), 3) AS "Vc", 0.02::DOUBLE AS "Vd\""""


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of pixels as two cameras with planted parameters record the same light. rows: group, i, j, x1, y1, x2, y2, r, g, b (the light)."""

    def seen(k: int, image: str) -> list[Column]:
        planted = _planted(F.col("group"), F.col(image))
        radius2 = F.col(f"x{k}") * F.col(f"x{k}") + F.col(f"y{k}") * F.col(f"y{k}")
        vig = 1 + radius2 * (planted["Vb"] + radius2 * (planted["Vc"] + radius2 * planted["Vd"]))
        light = vig * F.pow(F.lit(2.0), -planted["Eev"])
        balance = {"r": planted["Er"], "g": F.lit(1.0), "b": planted["Eb"]}
        return [(F.col(c) * light * balance[c]).alias(f"{c}{k}") for c in "rgb"]

    return rows.select("group", "i", "j", "x1", "y1", "x2", "y2", *seen(1, "i"), *seen(2, "j"))


def _light(a: Column, b: Column, c: Column) -> list[Column]:
    return [(0.1 + 0.5 * (a % 89) / 89).alias("r"), (0.1 + 0.5 * (b % 97) / 97).alias("g"), (0.1 + 0.5 * (c % 83) / 83).alias("b")]


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    part, supp, order = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey"))
    i = (F.col("l_linenumber") - 1).cast("int")
    at = [(0.007 * (part % 201 - 100)).alias("x1"), (0.014 * (supp % 101 - 50)).alias("y1"), (0.007 * (order % 199 - 99)).alias("x2"), (0.028 * (F.col("l_quantity") - 25)).alias("y2")]
    return t.select((supp % 4).cast("int").alias("group"), i.alias("i"), ((i + 1 + part % 6) % 7).cast("int").alias("j"), *at, *_light(order, part, supp))


def _images(pairs: DataFrame) -> DataFrame:
    return pairs.select("group", F.explode(F.array("i", "j")).alias("img")).distinct().select("group", "img", F.col("img").alias("stack"), F.lit(1).alias("lens"))


_three = lambda c: (F.round(c, 3) + 0.0).alias(c)  # noqa: E731 (no negative zero)
_LINE_IMAGES = "i AS (SELECT DISTINCT CAST(l_suppkey % 4 AS INTEGER) AS g, CAST(unnest([l_linenumber - 1, (l_linenumber + l_partkey % 6) % 7]) AS INTEGER) AS i FROM lineitem)"


@query(f'WITH {_LINE_IMAGES} SELECT g AS "group", i AS img, {_PLANTED_SQL} FROM i')
def photometric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure and white balance of all images but the first, and vignetting of their lens, for four projects at once."""
    pairs = _line_pairs(spark, sf_dir)
    own = F.when(F.col("img") > 0, F.col("img"))
    chosen = dict.fromkeys(("Eev", "Er", "Eb"), own) | dict.fromkeys(("Vb", "Vc", "Vd"), F.col("lens"))
    fitted, _ = photometric.fit(_pairs(pairs), _images(pairs), chosen)
    return fitted.select("group", "img", *(_three(c) for c in ("Eev", "Er", "Eb", "Vb", "Vc", "Vd")))


_LN2 = 0.6931471805599453


@query(f"""
WITH o AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS g, l_linenumber - 1 AS i, (l_linenumber + l_partkey % 6) % 7 AS j, unnest([l_discount, l_tax, l_quantity / 100]) AS a, unnest([l_tax + 0.01, l_discount, l_quantity / 90]) AS b FROM lineitem),
e AS (SELECT g, i, j, unnest([a - b, b - a]) AS e, unnest([b, -a]) * {_LN2} AS s FROM o),
h AS (SELECT g, i, j, CASE WHEN abs(e) <= 5 / 255 THEN e ELSE sign(e) * sqrt(5 / 255 * (2 * abs(e) - 5 / 255)) END AS r, CASE WHEN abs(e) <= 5 / 255 THEN s ELSE s * (5 / 255) / sqrt(5 / 255 * (2 * abs(e) - 5 / 255)) END AS d FROM e),
v AS (SELECT g, i AS a, d, i, j, r FROM h UNION ALL SELECT g, j, -d, i, j, r FROM h),
n AS (SELECT g, i AS p, i AS q, d * d AS v FROM h UNION ALL SELECT g, j, j, d * d FROM h UNION ALL SELECT g, i, j, -d * d FROM h UNION ALL SELECT g, j, i, -d * d FROM h
    UNION ALL SELECT g, a, -1, d * r FROM v UNION ALL SELECT g, -1, -1, r * r FROM h UNION ALL SELECT g, -2, -2, 1 FROM o WHERE false UNION ALL SELECT CAST(l_suppkey % 4 AS INTEGER), -2, -2, 1 FROM lineitem)
SELECT g AS "group", CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, round(sum(v), 3) + 0.0 AS v FROM n GROUP BY ALL
""")
def photometric_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round's sums of the fit: the normal equations of all images' exposures at their start, with Huber's weights."""
    t, pairs = table(spark, sf_dir, "lineitem"), _line_pairs(spark, sf_dir)
    i = (F.col("l_linenumber") - 1).cast("int")
    zero = [F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")]
    tax, discount, quantity = (F.col(c) for c in ("l_tax", "l_discount", "l_quantity"))
    values = [discount.alias("r1"), tax.alias("g1"), (quantity / 100).alias("b1"), (tax + 0.01).alias("r2"), discount.alias("g2"), (quantity / 90).alias("b2")]
    rows = t.select((F.col("l_suppkey") % 4).cast("int").alias("group"), i.alias("i"), ((i + 1 + F.col("l_partkey") % 6) % 7).cast("int").alias("j"), *zero, *values)
    images = cut(_images(pairs))
    slots, variables = least_squares.numbered(photometric.variables(images, {"Eev": F.lpad(F.col("img").cast("string"), 3, "0")}))
    state = variables.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "value"))), lambda s: s.value).alias("x"))
    sums = least_squares.normal_sums([(rows, photometric.PairResiduals(None))], slots, state)
    return sums.select("group", "p", "q", (F.round("v", 3) + 0.0).alias("v"))


@query(f"""
WITH i AS (SELECT DISTINCT CAST(o_custkey % 3 AS INTEGER) AS g, CAST(unnest([o_orderkey % 5, (o_orderkey + 1 + o_custkey % 4) % 5]) AS INTEGER) AS i FROM orders)
SELECT g AS "group", i AS img, {_PLANTED_SQL}, 'exposure vignetting balance' AS stages FROM i
""")
def smart_photometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged fit with its roll-backs: exposure, then vignetting, then white balance."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    cents = F.floor(F.col("o_totalprice") * 100)
    at = [(0.007 * (cents % 201 - 100)).alias("x1"), (0.014 * (cust % 101 - 50)).alias("y1"), (0.007 * (F.floor(cents / 7) % 199 - 99)).alias("x2"), (0.014 * (F.floor(cents / 31) % 101 - 50)).alias("y2")]
    i = order % 5
    pairs = table(spark, sf_dir, "orders").select((cust % 3).cast("int").alias("group"), i.cast("int").alias("i"), ((i + 1 + cust % 4) % 5).cast("int").alias("j"), *at, *_light(order, cust, cents))
    done = photometric.smart_fit(_pairs(pairs), _images(pairs), True)
    return done.select("group", "img", *(_three(c) for c in ("Eev", "Er", "Eb", "Vb", "Vc", "Vd")), "stages")


# ---- geometric fits: images of a project stand in a ring, points are directions between two of them


_RING = 8
_STEP = 360.0 / _RING


def _ring(spark: SparkSession, planted: bool) -> DataFrame:
    g, i = F.floor(F.col("id") / _RING).cast("int"), (F.col("id") % _RING).cast("int")
    rows = spark.range(3 * _RING).select(g.alias("group"), i.alias("img"))
    g, i = F.col("group"), F.col("img")
    yaw = (i * _STEP + 180) % 360 - 180
    turned = [(yaw + F.when(i == 0, 0).otherwise((g * 3 + i * 5) % 7 - 3)).alias("y"), F.when(i == 0, 0.0).otherwise((g + i * 3) % 5 - 2.0).alias("p"), F.when(i == 0, 0.0).otherwise((g * 2 + i) % 3 - 1.0).alias("r")]
    start = [yaw.alias("y"), F.lit(0.0).alias("p"), F.lit(0.0).alias("r")]
    return rows.select("group", "img", F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"), F.lit(0).alias("projection"), F.lit(80.0).alias("v"), F.lit(1).alias("lens"), *(turned if planted else start))


def _ring_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a direction between the images i and i + 1 of its project, and what both see of it. ``wrong``: every fortieth is moved in its second image, to either side by turns."""
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"))
    i = (F.col("l_orderkey") % _RING).cast("int")
    rows = t.select(
        (F.col("l_suppkey") % 3).cast("int").alias("group"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), i.alias("i"), ((i + 1) % _RING).alias("j"),
        ((i + 0.5) * _STEP + (F.col("l_partkey") % 101 - 50) / 10).alias("lon"), ((F.col("l_suppkey") % 41 - 20) / 1.5 + F.col("l_discount") * 10).alias("lat"), ((F.col("l_partkey") + 3 * F.col("l_linenumber")) % 40 == 7).alias("wrong"), (F.floor(F.col("l_orderkey") / 8) % 2 * 400 - 200).alias("by"),
    )
    images = _ring(spark, True)
    known = {"projection": F.lit(0), "hfov": F.lit(80.0), "width": F.lit(1000.0)}
    for k, end in ((1, "i"), (2, "j")):
        of = images.select("group", F.col("img").alias(end), F.col("y").alias(f"_y{k}"), F.col("p").alias(f"_p{k}"), F.col("r").alias(f"_r{k}"))
        rows = rows.join(F.broadcast(of), ["group", end])  # 24 images
        rows = rows.withColumns({f"x{k}": (F.col("lon") + 540) % 360 - 180, f"y{k}": F.col("lat")})
        rows = G.with_image_places(rows, f"x{k}", f"y{k}", known | {"yaw": F.col(f"_y{k}"), "pitch": F.col(f"_p{k}"), "roll": F.col(f"_r{k}")}, 360.0, 360.0)
    return rows.select("group", "id", "i", "j", "x1", "y1", F.when(F.col("wrong"), F.col("x2") + F.col("by")).otherwise(F.col("x2")).alias("x2"), "y2", F.lit(0).alias("mode"), "wrong")


@query("""
WITH i AS (SELECT g, i FROM range(3) a(g), range(8) b(i))
SELECT CAST(g AS INTEGER) AS "group", CAST(i AS INTEGER) AS img, round(((i * 45 + 180) % 360 - 180 + CASE WHEN i = 0 THEN 0 ELSE (g * 3 + i * 5) % 7 - 3 END + 540) % 360 - 180, 3) + 0.0::DOUBLE AS y,
       round(CASE WHEN i = 0 THEN 0 ELSE (g + i * 3) % 5 - 2 END, 3) + 0.0::DOUBLE AS p, round(CASE WHEN i = 0 THEN 0 ELSE (g * 2 + i) % 3 - 1 END, 3) + 0.0::DOUBLE AS r FROM i WHERE g IN (SELECT l_suppkey % 3 FROM lineitem)
""")
def geometric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all images of three rings: first each by those nearer to the reference image, then all together."""
    points = _ring_points(spark, sf_dir).filter(~F.col("wrong"))
    fitted, _ = geometric.fit_all(points, _ring(spark, False))
    turn = ((F.col("y") + 540) % 360 - 180).alias("y")
    return fitted.select("group", "img", turn, "p", "r").select("group", "img", _three("y"), _three("p"), _three("r"))


@query("SELECT l_suppkey % 3 AS \"group\", l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE (l_partkey + 3 * l_linenumber) % 40 = 7")
def clean_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points over their pair's limit, each pair of images fitted by itself: the planted wrong ones."""
    points = _ring_points(spark, sf_dir)
    return geometric.clean_by_pair(points, _ring(spark, False)).select(F.col("group").cast("long").alias("group"), "id")


# ---- neighbour indexes


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query()
def forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest odd vectors of each even one, by the k-d forest; a test measures its recall."""
    e = _vectors(spark, sf_dir)
    return forest.nearest(e.filter("id % 2 = 0"), e.filter("id % 2 = 1")).select("q", "t", F.round("d", 6).alias("d"), "rank")


@query()
def kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest odd vectors of each even one, by the k-means tree; a test measures its recall."""
    e = _vectors(spark, sf_dir)
    nodes, rows = kmeans_tree.tree(e.filter("id % 2 = 1"))
    return kmeans_tree.nearest(e.filter("id % 2 = 0"), nodes, rows).select("q", "t", F.round("d", 6).alias("d"), "rank")


@query("""
WITH s AS (SELECT c_custkey AS q, c_acctbal / 100 AS x, c_nationkey * 4.0 AS y FROM customer), t AS (SELECT s_suppkey AS t, s_acctbal / 100 AS x, s_nationkey * 4.0 AS y FROM supplier),
d AS (SELECT q, t, (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) AS d FROM s, t), r AS (SELECT q, t, d, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rank FROM d)
SELECT q, t, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def forest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's three nearest suppliers in two dimensions, exactly: cells within reach are opened, and no others."""
    at = lambda t, p: table(spark, sf_dir, t).select(F.col(f"{p}key").alias("id"), F.array(F.col(f"{p[0]}_acctbal") / 100, F.col(f"{p[0]}_nationkey") * 4.0).alias("v"))
    found = forest.nearest(at("customer", "c_cust"), at("supplier", "s_supp"), 3, leaf=32, exact=True)
    return found.select("q", "t", F.round("d", 6).alias("d"), "rank")


# ---- seams


_GRID = "p AS (SELECT s_suppkey AS n, s_suppkey % 10 AS x, s_suppkey // 10 AS y, CAST(round(s_acctbal * 100) AS BIGINT) AS c, s_suppkey % 37 = 5 AS seed FROM supplier)"


def _supplier_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k % 10).alias("x"), F.floor(k / 10).alias("y"), F.round(F.col("s_acctbal") * 100).cast("long").alias("c"), F.when(k % 37 == 5, k).alias("seed"))


@query(f"""
WITH RECURSIVE {_GRID}, e AS (SELECT a.n AS a, b.n AS b, greatest(a.c, b.c) AS w, least(a.y * 10 + a.x, b.y * 10 + b.x) AS lo, greatest(a.y * 10 + a.x, b.y * 10 + b.x) AS hi FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
f AS (SELECT list(n) AS seen, list(n) AS root, 0 AS step FROM p WHERE seed
    UNION ALL SELECT list_append(seen, b), list_append(root, root[list_position(seen, a)]), step + 1 FROM (SELECT f.*, e.a, e.b, row_number() OVER (ORDER BY w, lo, hi) AS k FROM f, e WHERE list_contains(seen, e.a) AND NOT list_contains(seen, e.b)) WHERE k = 1),
l AS (SELECT unnest(seen) AS n, unnest(root) AS label FROM (SELECT * FROM f ORDER BY step DESC LIMIT 1))
SELECT x, y, label FROM p LEFT JOIN l USING (n)
""")
def watershed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of seeds over a grid of costs; the SQL floods it step by step."""
    return seams.watershed(_supplier_grid(spark, sf_dir), "c", "seed").select("x", "y", "label")


_PROBLEM = "p AS (SELECT l_partkey % 23 AS x, l_suppkey % 19 AS y, CAST(sum(l_quantity) % 50 AS DOUBLE) AS v, (l_partkey % 23 + l_suppkey % 19) % 11 = 0 AS fixed, CAST(sum(l_linenumber) % 5 - 2 AS DOUBLE) AS b FROM lineitem GROUP BY 1, 2, 4), n AS (SELECT a.x, a.y, count(*) AS n FROM p a JOIN p b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2)"


def _problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 23).alias("x"), (F.col("l_suppkey") % 19).alias("y")
    rows = t.groupBy(x, y).agg((F.sum("l_quantity") % 50).alias("v"), (F.sum("l_linenumber") % 5 - 2).cast("double").alias("b"))
    fixed = (F.col("x") + F.col("y")) % 11 == 0
    return rows.select("x", "y", "v", fixed.alias("fixed"), F.col("b").alias("b"))


def _sweep_sql(before: str, after: str, odd: int, omega: float = 1.0) -> str:
    return f"""{after} AS (SELECT a.x, a.y, CASE WHEN a.fixed OR n.n IS NULL OR (a.x + a.y) % 2 <> {odd} THEN a.v ELSE (1 - {omega}) * a.v + {omega} * (coalesce(s, 0) + a.b) / n.n END AS v, a.fixed, a.b
        FROM {before} a LEFT JOIN n USING (x, y) LEFT JOIN (SELECT c.x, c.y, sum(d.v) AS s FROM {before} c JOIN {before} d ON abs(c.x - d.x) + abs(c.y - d.y) = 1 GROUP BY 1, 2) q USING (x, y))"""


@query(f"WITH {_PROBLEM}, {_sweep_sql('p', 'q0', 0, 1.25)}, {_sweep_sql('q0', 'q1', 1, 1.25)}, {_sweep_sql('q1', 'q2', 0, 1.25)}, {_sweep_sql('q2', 'q3', 1, 1.25)} SELECT x, y, round(v, 9) AS v FROM q3")
def poisson_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two red-black sweeps, over-relaxed, on tiles of eight pixels."""
    return seams.relax(_problem(spark, sf_dir), 2, 1.25, tile=8).select("x", "y", F.round("v", 9).alias("v"))


@query(f"""
WITH {_PROBLEM}, r AS (SELECT a.x, a.y, a.fixed, CASE WHEN a.fixed THEN 0 ELSE a.b + coalesce(s, 0) - coalesce(n, 0) * a.v END AS r FROM p a LEFT JOIN n USING (x, y) LEFT JOIN (SELECT c.x, c.y, sum(d.v) AS s FROM p c JOIN p d ON abs(c.x - d.x) + abs(c.y - d.y) = 1 GROUP BY 1, 2) q USING (x, y))
SELECT x // 2 AS x, y // 2 AS y, bool_or(fixed) AS fixed, round(CASE WHEN bool_or(fixed) THEN 0 ELSE sum(r) / 2 END, 6) + 0.0 AS b FROM r GROUP BY 1, 2
""")
def poisson_coarser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second level's problem, from the first one's residuals."""
    return seams.coarser(seams.residual(_problem(spark, sf_dir))).select("x", "y", "fixed", (F.round("b", 6) + 0.0).alias("b"))


# ---- rasters


_RASTER = "s AS (SELECT CAST(l_returnflag = 'A' AS INTEGER) AS img, l_partkey % 90 AS x, l_suppkey % 70 AS y, sum(l_quantity) AS v, CAST(sum(l_linenumber) % 4 AS INTEGER) AS m FROM lineitem GROUP BY 1, 2, 3)"


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy((F.col("l_returnflag") == "A").cast("int").alias("img"), (F.col("l_partkey") % 90).alias("x"), (F.col("l_suppkey") % 70).alias("y")).agg(F.sum("l_quantity").alias("v"), (F.sum("l_linenumber") % 4).cast("int").alias("m"))


def _remap_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 1.7 is a decimal in SQL, so that its product is rounded once; the product of doubles may be off by a bit
    sy = F.col("p_size") * 17 / 10 + F.col("p_retailprice") % 1 - 4
    return table(spark, sf_dir, "part").select((F.col("p_size") % 2).cast("int").alias("img"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 20 - 5).alias("sx"), sy.alias("sy"))


def _tap_sql(kernel: str) -> str:
    """Weight of tap k (0 up) at fraction f."""
    n = raster.taps(kernel)
    d = f"abs(k - {n // 2 - 1} - f)"
    if kernel == "nearest":
        return "CASE WHEN (f < 0.5) = (k = 0) THEN 1.0 ELSE 0.0 END"
    if kernel in raster.SINCS:
        sinc = lambda x: f"CASE WHEN {x} = 0 THEN 1 ELSE sin(pi() * {x}) / (pi() * {x}) END"
        return f"({sinc(d)}) * ({sinc(f'({d} / {n // 2})')})"
    if kernel == "cubic":
        return f"CASE WHEN {d} < 1 THEN (1.25 * {d} - 2.25) * {d} * {d} + 1 ELSE ((-0.75 * {d} + 3.75) * {d} - 6) * {d} + 3 END"
    return "CASE k " + " ".join(f"WHEN {k} THEN (({a!r} * f + {b!r}) * f + {c!r}) * f + {e!r}" for k, (a, b, c, e) in enumerate(raster.POLYNOMIALS[kernel])) + " END"


def _remap_sql(kernel: str) -> str:
    n = raster.taps(kernel)
    axis = lambda a: f"{a}t AS (SELECT p.img, p.id, CAST(floor(s{a}) AS BIGINT) + k - {n // 2 - 1} AS {a}, {_tap_sql(kernel)} AS w{a} FROM (SELECT *, s{a} - floor(s{a}) AS f FROM p) p, range({n}) r(k))"
    return f"""SELECT '{kernel}' AS kernel, img, id, CASE WHEN sum(w) > 0.2 THEN round(sum(w * v) / sum(w), 6) END AS v, CASE WHEN sum(w) > 0.2 THEN round(sum(w * m) / sum(w), 6) END AS m FROM (
        WITH {axis('x')}, {axis('y')} SELECT p.img, p.id, s.v, s.m, coalesce(wx * wy, 0) * CASE WHEN s.m <> 0 THEN 1 ELSE 0 END AS w FROM p LEFT JOIN xt ON xt.img = p.img AND xt.id = p.id LEFT JOIN yt ON yt.img = p.img AND yt.id = p.id
        LEFT JOIN s ON s.img = p.img AND s.x = xt.x AND s.y = yt.y) GROUP BY img, id"""


@query(f"WITH {_RASTER}, p AS (SELECT CAST(p_size % 2 AS INTEGER) AS img, p_partkey AS id, p_retailprice / 20 - 5 AS sx, p_size * 1.7 + p_retailprice % 1 - 4 AS sy FROM part) {' UNION ALL '.join(_remap_sql(k) for k in raster.KERNELS if k != 'sinc1024')}")
def remap_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of two images at the parts' places, by seven kernels; the eighth, of 32 taps, is tested like them."""
    source = _raster(spark, sf_dir)
    places = _remap_places(spark, sf_dir)
    out = None
    for kernel in (k for k in raster.KERNELS if k != "sinc1024"):
        one = raster.remap(source, places, kernel).select(F.lit(kernel).alias("kernel"), "img", "id", F.round("v", 6).alias("v"), F.round("m", 6).alias("m"))
        out = one if out is None else out.unionByName(one)
    return out


def _reduce_sql(before: str, after: str) -> str:
    weight = lambda a: f"CASE abs({a} - 2 * k{a}) WHEN 0 THEN 6.0 WHEN 1 THEN 4.0 ELSE 1.0 END"
    return f"""{after} AS (SELECT img, kx AS x, ky AS y, sum(w * v) / sum(w) AS v FROM (SELECT img, v, kx, ky, {weight('x')} * {weight('y')} AS w FROM {before} JOIN (SELECT img, max(x) AS mx, max(y) AS my FROM {before} GROUP BY 1) USING (img), range(64) a(kx), range(64) b(ky)
        WHERE abs(x - 2 * kx) <= 2 AND abs(y - 2 * ky) <= 2 AND 2 * kx <= mx AND 2 * ky <= my) GROUP BY 1, 2, 3)"""


@query(f"WITH {_RASTER}, {_reduce_sql('s', 'a')}, {_reduce_sql('a', 'b')} SELECT img, level, x, y, round(v, 6) AS v FROM (SELECT img, 0 AS level, x, y, v FROM s UNION ALL SELECT img, 1, x, y, v FROM a UNION ALL SELECT img, 2, x, y, v FROM b)")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reductions of two images."""
    return raster.pyramid(_raster(spark, sf_dir), 2).select("img", "level", "x", "y", F.round("v", 6).alias("v"))



# ---- lines


_PATHS = "p AS (SELECT CAST(c_nationkey AS INTEGER) AS img, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS x FROM customer)"


@query(f"WITH {_PATHS} SELECT img, x, x // 2 AS y, x AS place FROM p WHERE img IN (SELECT img FROM p GROUP BY img HAVING count(*) >= 5)")
def traced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a rising line for each nation, a pixel a customer, put in order from their neighbourhood alone."""
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    pixels = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("img"), place.cast("long").alias("x")).withColumn("y", F.floor(F.col("x") / 2))
    return lines.lines(pixels, 5).select("img", "x", "y", "place")


_GRAY = "p AS (SELECT 0 AS img, l_partkey % 40 AS x, l_suppkey % 30 AS y, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 2, 3)"


def _sobel_sql() -> str:
    weigh = lambda turn: "sum(b.v * CASE " + " ".join(f"WHEN b.x - a.x = {y if turn else x} AND b.y - a.y = {x if turn else y} THEN {w}" for (x, y), w in lines.SOBEL.items()) + " ELSE 0 END)"
    return f"SELECT a.img, a.x, a.y, CAST({weigh(False)} AS BIGINT) AS gx, CAST({weigh(True)} AS BIGINT) AS gy FROM p a JOIN p b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY 1, 2, 3 HAVING count(*) = 8"


@query(f"WITH {_GRAY}, g AS ({_sobel_sql()}) SELECT img, x, y, gx, gy, round(sqrt(gx * gx + gy * gy), 6) AS size FROM g")
def edge_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of a picture over each pixel's eight neighbours."""
    t = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 30).alias("y")).agg(F.sum("l_quantity").cast("long").alias("v"))
    found = lines.gradients(t.select(F.lit(0).alias("img"), "x", "y", "v"))
    return found.select("img", "x", "y", "gx", "gy", F.round("size", 6).alias("size"))
