"""Audit of how far sources of a language differ in their words.

A term's share in a group, in units of 1e-9 and smoothed, is p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)). Two groups differ by the sum
of |p - q| over the language's V kept terms. That sum is split by how many groups a term is in, and both parts are whole numbers,
added exactly:

- heavy terms (in more than ``HEAVY`` groups) stand in dense numpy tiles of ``TILE_GROUPS`` groups by about ``TILE_TERMS`` terms; each
  pair of groups in a pair of tiles gives a partial sum;
- light terms are mostly absent, and an absent term has a group's base share b. Were all of them absent, they would give |b - c| each.
  A term that only one of the groups has corrects this by |p - c| - |b - c|: these are summed over a group's histogram of shares,
  which has few values. A term that both have corrects it once more by |p - q| - |p - c| - |b - q| + |b - c|: a posting has at most
  ``HEAVY`` groups, so it makes at most HEAVY * (HEAVY - 1) / 2 pairs.

Terms are counted in each task before anything is shuffled. Sources of a language form pairs because the result names each pair.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, give_back, written

LEAST_DOCUMENTS = 30
SMOOTH = 5
UNIT = 1_000_000_000
RANKS = 50
HEAVY = 8
TILE_GROUPS, TILE_TERMS = 64, 512
#: Entries of a task's counters before they are sent on.
ENTRIES = 200_000
PIECE = 1 << 20

_LETTERS = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 text, in pieces: runs of letters A-Z, in lower case, and characters beyond ASCII."""
    plain = text.translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term in each group, summed over all of docs, and a row with a null term
    for each group. Written to the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        grown = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                terms = [None, *times]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
                columns += [pa.array([0, *times.values()], pa.int64()), pa.array([0, *(docs[t] for t in times)], pa.int64())]
                whole = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
                for at in range(0, len(terms), 20_000):
                    yield whole.slice(at, 20_000)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                times, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, seen = len(times), set()
                for piece in words(text.as_py()):
                    times.update(piece)
                    seen.update(piece)
                docs.update(seen)
                grown += len(times) - before
                if grown > ENTRIES:
                    yield from sent()
                    grown = 0
        yield from sent()
        give_back()

    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    partial = read.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * terms)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    scaled = wide(count + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, wide(total + SMOOTH * terms))


def _singles(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """lang, a, b, v: for each pair, the corrections by terms that a has, against b's base share."""

    def corrected(key: tuple, ours: pa.Table, shares: pa.Table) -> pa.Table:
        p, n = np.asarray(shares.column("p").combine_chunks(), np.int64), np.asarray(shares.column("n").combine_chunks(), np.int64)
        order = np.argsort(p)
        p, n = p[order], n[order]
        base, other = (np.asarray(ours.column(c).combine_chunks(), np.int64) for c in ("base", "other_base"))
        many, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
        at = p.searchsorted(other)
        above = (total[-1] - total[at]) - other * (many[-1] - many[at])
        v = above + other * many[at] - total[at] - many[-1] * np.abs(base - other)
        return pa.table({"lang": ours.column("lang"), "a": ours.column("a"), "b": ours.column("b"), "v": pa.array(v, pa.int64())})

    shares = light.groupBy("lang", F.col("k").alias("a"), "p").agg(F.count("*").alias("n"))
    return pairs.groupBy("lang", "a").cogroup(shares.groupBy("lang", "a")).applyInArrow(corrected, "lang string, a int, b int, v long")


def _doubles(light: DataFrame) -> DataFrame:
    """lang, a, b, v: the corrections by light terms that both groups have; a posting holds at most HEAVY groups."""
    posting = light.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("k", "p", "base"))).alias("x")).filter(F.size("x") > 1)
    one = posting.select("lang", F.posexplode("x").alias("i", "s"), "x")
    two = one.select("lang", "s", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("t"))
    gap = lambda x, y: F.abs(F.col(f"s.{x}") - F.col(f"t.{y}"))
    v = gap("p", "p") - gap("p", "base") - gap("base", "p") + gap("base", "base")
    return two.groupBy("lang", F.col("s.k").alias("a"), F.col("t.k").alias("b")).agg(F.sum(v).alias("v"))


def _tiles(heavy: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, v: partial sums over heavy terms. heavy: lang, term, k, p; terms: lang, term (each heavy term once);
    groups: lang, k, base."""
    sizes = terms.groupBy("lang").agg(F.ceil(F.count("*") / TILE_TERMS).cast("int").alias("tiles"))
    dealt = terms.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int"))
    in_tile = Window.partitionBy("lang", "tile")
    slots = written(dealt.select("lang", "term", "tile", (F.row_number().over(in_tile.orderBy("term")) - 1).alias("slot"), F.count("*").over(in_tile).cast("int").alias("width")), "slots")
    blocks = groups.groupBy("lang").agg((F.floor(F.max("k") / TILE_GROUPS) + 1).cast("int").alias("blocks"))

    def paired(rows: DataFrame) -> DataFrame:
        """Each row for each pair of blocks that its own block is in."""
        mine = F.floor(F.col("k") / TILE_GROUPS).cast("int")
        rows = rows.join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return rows.select("lang", "tile", F.least(mine, "other").alias("i"), F.greatest(mine, "other").alias("j"), "k", "slot", "p")

    # a group stands in each tile with its base share and, as a negative slot, the tile's width; its postings lie over that
    marks = groups.join(slots.select("lang", "tile", "width").distinct(), "lang").select("lang", "tile", "k", (-F.col("width")).alias("slot"), F.col("base").alias("p"))
    stands = heavy.join(slots, ["lang", "term"]).select("lang", "tile", "k", "slot", "p")

    def summed(table: pa.Table) -> pa.Table:
        k, slot, p = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("k", "slot", "p"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        mark = slot < 0
        order = np.argsort(k[mark])
        names, base = k[mark][order], p[mark][order]
        dense = np.repeat(base[:, None], -slot[mark][0], axis=1)
        dense[names.searchsorted(k[~mark]), slot[~mark]] = p[~mark]
        out = []
        for x in np.flatnonzero(names // TILE_GROUPS == i):
            y = np.flatnonzero((names // TILE_GROUPS == j) & (names > names[x]))
            out.append(np.stack([np.full(len(y), names[x]), names[y], np.abs(dense[y] - dense[x]).sum(axis=1)]))
        a, b, v = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "v": pa.array(v, pa.int64())})

    work = paired(marks).unionByName(paired(stands))
    return work.groupBy("lang", "tile", "i", "j").applyInArrow(summed, "lang string, a int, b int, v long")


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: each other source of the language and the sum of |p - q|, the
    largest first; part ``term``: terms more frequent in the group than in the language, by the difference, up to ``ranks``.

    A null text, lang or source counts as empty; an empty or termless document still makes its group occur; a language without
    kept terms has pairs of value 0. Each row is a document, repeated rows too. Ties go to the smaller item, byte by byte. An empty
    table gives no rows; other columns are ignored.
    """
    found = counted(docs)
    some = found.filter(F.col("term").isNotNull())
    kept = some.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("groups"))
    kept = written(kept.filter(F.col("docs") >= least_documents).drop("docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"), F.sum((F.col("groups") <= HEAVY).cast("long")).alias("light"))
    posted = some.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    sums = posted.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = found.filter(F.col("term").isNull()).select("lang", "source").withColumn("k", number).join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumn("group_total", F.coalesce("group_total", F.lit(0))).withColumn("base", share(F.lit(0).cast("long"), F.col("group_total"), F.col("terms")))
    groups = written(groups, "groups")
    shares = posted.join(groups.select("lang", "source", "k", "base", "group_total", "lang_total", "terms"), ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("group_total"), F.col("terms"))).withColumn("q", share(F.col("total"), F.col("lang_total"), F.col("terms")))
    shares = written(shares.select("lang", "source", "k", "term", "groups", "p", "q", "base"), "shares")

    size = F.col("value").desc()
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(size, "item"))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= ranks)

    side = groups.select("lang", "k", "base")
    directed = side.withColumnsRenamed({"k": "a"}).join(side.withColumnsRenamed({"k": "b", "base": "other_base"}), "lang").filter("a <> b")
    light, heavy = shares.filter(F.col("groups") <= HEAVY), shares.filter(F.col("groups") > HEAVY)
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    plain = directed.filter("a < b").join(langs.select("lang", "light"), "lang", "left").select("lang", "a", "b", F.coalesce(F.col("light") * F.abs(F.col("base") - F.col("other_base")), F.lit(0)).alias("v"))
    parts = [
        plain,
        _singles(directed.filter(F.col("base").isNotNull()), light).select("lang", *ordered, "v"),
        _doubles(light),
        _tiles(heavy.select("lang", "term", "k", "p"), kept.filter(F.col("groups") > HEAVY).select("lang", "term"), side.filter(F.col("base").isNotNull())),
    ]
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other)
    summed = written(both.groupBy("lang", "a", "b").agg(F.sum("v").alias("value")), "divergences")
    names = groups.select("lang", "k", "source")
    mirrored = summed.union(summed.select("lang", "b", "a", "value"))
    pairs = mirrored.join(names.withColumnRenamed("k", "a"), ["lang", "a"]).join(names.withColumnsRenamed({"k": "b", "source": "item"}), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    discard(found)
    return pairs.unionByName(terms)
