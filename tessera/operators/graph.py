"""Graph operators on edge tables; iterations cut their lineage in the shared checkpoint folder."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranking import row_numbers

#: Levels that are taken one by one, and edges of a block beyond them.
SHALLOW, BLOCK_EDGES = 8, 200_000


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) in both directions, without loops."""
    e = edges.select("a", "b").filter("a <> b")
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least node that can be reached); a node without edges is its own.

    Edges are rewired by turns: each node's larger neighbours to its least neighbour (large star), then each node's smaller
    ones (small star), until every node points at its component's least node. A round halves the depth, rows are never more than
    the edges, and both steps aggregate before they shuffle. A hub's neighbours meet its least one by a join that Spark can split.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        near = e.union(e.select("b", "a"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.filter("a <> b").distinct())
        # the same edges as before: sums of a 64-bit hash over distinct rows
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (now.n, now.h) == before:
            break
        before = (now.n, now.h)
    return nodes.select("node").join(e, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def is_connected(components_: DataFrame) -> DataFrame:
    """connected: one component; an empty graph isn't."""
    return components_.agg((F.countDistinct("component") == 1).alias("connected"))


def levels(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, level: breadth-first distance from start (node): a few levels one by one, what lies deeper by blocks (see :func:`_deeper`)."""
    e = cut(both_ways(edges))
    front = cut(start.select("node", F.lit(0).alias("level")).distinct())
    seen = [front]
    for level in range(1, SHALLOW + 1):
        known = reduce(DataFrame.union, seen)
        new = e.join(front.select("node"), e.a == F.col("node")).select(F.col("b").alias("node")).distinct()
        front = cut(new.join(known, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return known
        seen.append(front)
    return _deeper(e, cut(reduce(DataFrame.union, seen)), front)


def _deeper(e: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    """node, level: known levels, carried on from the fresh ones among them.

    Nodes are dealt into blocks of about ``BLOCK_EDGES`` edges, in their order, as neighbours often have numbers that are near. A round lowers levels inside
    the blocks that fresh nodes are in until nothing changes there, and then by edges between blocks; lowered nodes are fresh. So a long path
    costs a round for each time it leaves a block, not for each node, and never more rounds than levels.
    """
    blocks = cut(row_numbers(e, "_k", ["a", "b"]).groupBy(F.col("a").alias("node")).agg(F.floor(F.min("_k") / BLOCK_EDGES).cast("long").alias("block")))
    of = lambda c: blocks.select(F.col("node").alias(c), F.col("block").alias(f"_{c}"))
    dealt = cut(e.join(of("a"), "a").join(of("b"), "b"))
    inner, between = dealt.filter("_a = _b").select(F.col("_a").alias("block"), "a", "b"), dealt.filter("_a <> _b").select("a", "b")
    kind = dict(known.dtypes)["node"]
    known, fresh = (df.join(blocks, "node", "left").select(F.coalesce("block", F.lit(-1)).alias("block"), "node", "level") for df in (known, fresh))  # a start may have no edges

    def lower(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values("a", kind="stable")
        ends, first = np.unique(links["a"].to_numpy(), return_index=True)
        to, upto = links["b"].tolist(), np.append(first, len(links))[1:]
        near = {a: (s, t) for a, s, t in zip(ends.tolist(), first.tolist(), upto.tolist(), strict=True)}
        old = rows[~rows["fresh"]]
        level = dict(zip(old["node"].tolist(), old["level"].tolist(), strict=True))
        lowered: dict = {}
        todo = [(v, n) for v, n in rows.loc[rows["fresh"], ["level", "node"]].itertuples(index=False)]
        heapq.heapify(todo)
        while todo:
            v, n = heapq.heappop(todo)
            if n in lowered or level.get(n, v + 1) <= v:
                continue
            level[n] = lowered[n] = v
            s, t = near.get(n, (0, 0))
            for m in to[s:t]:
                if level.get(m, v + 2) > v + 1:
                    heapq.heappush(todo, (v + 1, m))
        block = rows["block"].iloc[0] if len(rows) else 0
        return pd.DataFrame({"block": block, "node": list(lowered), "level": list(lowered.values())})

    known = cut(known.join(fresh.select("node"), "node", "left_anti").select("block", "node", "level"))
    fresh = cut(fresh)
    while True:
        here = fresh.select("block").distinct()
        rows = fresh.withColumn("fresh", F.lit(True)).unionByName(known.join(here, "block", "left_semi").withColumn("fresh", F.lit(False)))
        links = inner.join(here, "block", "left_semi")
        lowered = cut(rows.groupBy("block").cogroup(links.groupBy("block")).applyInPandas(lower, f"block long, node {kind}, level int"))
        known = cut(known.unionByName(lowered).groupBy("block", "node").agg(F.min("level").alias("level")))
        reached = between.join(lowered, F.col("a") == F.col("node")).groupBy("b").agg((F.min("level") + 1).alias("_to"))
        fresh = reached.join(blocks, F.col("b") == F.col("node")).select("block", "node", "_to").join(known, ["block", "node"], "left")
        fresh = cut(fresh.filter("level IS NULL OR _to < level").select("block", "node", F.col("_to").alias("level")))
        if fresh.isEmpty():
            return known.select("node", "level")


def visit_all(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, component, level: breadth-first from start in its component, and from the least node in each other one."""
    parts = cut(components(nodes, edges))
    begun = parts.join(start.select("node").distinct(), "node", "left_semi").groupBy("component").agg(F.min("node").alias("_s"))
    first = parts.select("component").distinct().join(begun, "component", "left").select(F.coalesce("_s", "component").alias("node"))
    return parts.join(levels(edges, first), "node")


def point_edges(points: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """a, b: images joined by a plain control point (mode 0) of two images, or by a link (img_nr, anchor)."""
    e = points.filter("mode = 0 AND img1 <> img2").select(F.least("img1", "img2").alias("a"), F.greatest("img1", "img2").alias("b"))
    if links is not None:
        e = e.union(links.filter("img_nr <> anchor").select(F.least("img_nr", "anchor"), F.greatest("img_nr", "anchor")))
    return e.distinct()


def overlap_edges(overlaps: DataFrame, least: float = 0.001) -> DataFrame:
    """a, b of pairs (i, j, ratio) that overlap by more than least."""
    return overlaps.filter(F.col("ratio") > least).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def blending_order(images: DataFrame, overlaps: DataFrame, reference: int) -> DataFrame:
    """img_nr, level: order of blending, breadth-first over overlaps from the reference image (the first one if it isn't among them)."""
    known = images.select(F.col("img_nr").alias("node"))
    start = known.agg(F.coalesce(F.max(F.when(F.col("node") == reference, F.col("node"))), F.min("node")).alias("node"))
    return visit_all(known, overlap_edges(overlaps), start).select(F.col("node").alias("img_nr"), "component", "level")


def part_numbers(images: DataFrame, links: DataFrame) -> DataFrame:
    """img_nr, part: images linked in a variable of a group (links: img_nr, anchor) are one part; parts are numbered from 0 by their first image."""
    linked = links.select(F.col("img_nr").alias("a"), F.col("anchor").alias("b"))
    parts = components(images.select(F.col("img_nr").alias("node")), linked)
    numbers = row_numbers(parts.select("component").distinct(), "part", ["component"])
    return parts.join(numbers, "component").select(F.col("node").alias("img_nr"), "part")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: str) -> DataFrame:
    """group: number of the rows with a true ``starts`` up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("group", F.sum(F.col(starts).cast("int")).over(w))


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, least: int = 1) -> DataFrame:
    """keys, n, first, last: rows of a key whose times are at most gap apart, one after another; sessions of fewer than least rows are left out.

    Attributes that all rows of a session must share (camera, lens, size, focal length in hundredths) are keys.
    """
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    fresh = df.withColumn("_new", before.isNull() | (F.col(time) > before + F.expr(f"INTERVAL {gap}")))
    numbered = islands(fresh, keys, [time], "_new")
    return numbered.groupBy(*keys, "group").agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).filter(F.col("n") >= least)


def first_matching_sessions(df: DataFrame, keys: list[str], time: str, order: list[str], gap_seconds: int) -> DataFrame:
    """df with session (from 0 within its keys): rows in the given order join the first session whose span, widened by the gap at both ends,
    holds their time; sessions are never joined, so the order matters. A key (one folder's images of one camera, say) is one group."""
    import pandas as pd

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        spans: list[list[int]] = []
        out = []
        for t in group["_t"].tolist():
            k = next((k for k, (a, b) in enumerate(spans) if a - gap_seconds <= t <= b + gap_seconds), len(spans))
            if k == len(spans):
                spans.append([t, t])
            else:
                spans[k] = [min(spans[k][0], t), max(spans[k][1], t)]
            out.append(k)
        return group.assign(session=out).drop(columns="_t")

    timed = df.withColumn("_t", F.unix_seconds(time))
    return timed.groupBy(*keys).applyInPandas(assign, df.withColumn("session", F.lit(0).cast("long")).schema)


def split_session(df: DataFrame, keys: list[str], order: list[str], at: int, session: str = "session") -> DataFrame:
    """df with the rows of each session from place ``at`` (from 0) on in a session of their own: session becomes (session, 0 or 1)."""
    place = F.row_number().over(Window.partitionBy(*keys, session).orderBy(*order)) - 1
    return df.withColumn("half", (place >= at).cast("int"))
