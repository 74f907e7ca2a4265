"""Near-duplicate documents by 64-bit SimHash fingerprints and the generalised pigeonhole principle.

If two fingerprints differ in at most t bits and the bits are dealt to m partitions with thresholds whose sum is t - m + 1, some partition
differs by at most its own threshold (-1 stands for a partition that isn't looked at). So each fingerprint may choose its thresholds:

1. Bits that are correlated over all fingerprints are grouped into four blocks of 16, so that the blocks among them are as independent as
   can be. Partitions are single blocks, pairs of blocks, or the whole fingerprint.
2. For each block's 65,536 values, all fingerprints are counted; so are those one and two bits away from each value.
3. For each fingerprint, dynamic programming over the partitions finds the thresholds with the fewest estimated candidates and
   probes. A value that very many fingerprints have is avoided, or its partition gets a threshold of -1.
4. A probe is a partition's value with at most that many bits changed; it meets the fingerprints that have that value there. The real
   number of candidates of each fingerprint is counted first, by joining counts: one that would have more than probes of the whole
   fingerprint take (``WHOLE``) takes these instead, which have no false candidates. So no bucket, however hot, makes its pairs.
5. Candidates are verified by their differing bits.

Equal fingerprints are one to begin with. Links stay in Spark, and components are found by rounds of joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, written
from .near_dedup import components

WORDS, SEED, NEAR = 3, 42, 2
BITS, BLOCKS, WIDTH = 64, 4, 16
PIECE = 1 << 20
HASHES = 20_000
#: Partitions as numbers of blocks: singles, two pairs, the whole. The bits of a unit's number are its blocks.
SCHEMES = ((1, 2, 4, 8), (3, 12), (15,))
UNITS = (1, 2, 4, 8, 3, 12, 15)
#: Probes of a unit of b bits within r: all values with at most r bits changed.
PROBES = {u: [sum([1, b, b * (b - 1) // 2][: r + 1]) for r in range(NEAR + 1)] for u in UNITS for b in [WIDTH * u.bit_count()]}
WHOLE = PROBES[15][NEAR]
_SPACE = re.compile(rb"[ \t-\r]")


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the three-word shingles of UTF-8 text, repeats included, in pieces; of fewer words, one of all."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    low, at, tail, some = text.lower(), 0, [], False
    while at < len(low):
        space = _SPACE.search(low, at + PIECE)
        end = space.start() if space else len(low)
        words = tail + low[at:end].split()
        at = end
        if len(words) < WORDS:
            tail = words
            continue
        some = True
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = list(zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True))
        for i in range(0, len(spans), HASHES):
            part = spans[i : i + HASHES]
            yield np.fromiter((digest(joined[s:e], SEED) for s, e in part), np.uint64, len(part))
        tail = words[1 - WORDS :]
    if tail and not some:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """A bit is 1 if more than half the hashes have it; 0 without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f (the fingerprint as a signed long): written to the shared folder."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                f = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64), pa.int64())], ["doc_id", "f"])
        give_back()

    read = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return written(read.mapInArrow(sign, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f long"), "fingerprints")


def _bits(f: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, the highest first."""
    return np.unpackbits(f.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_order(distinct: DataFrame) -> np.ndarray:
    """The 64 bits (0: the highest) in four groups of 16 after each other, correlated bits together. Counts are summed in Spark: 4,096 numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                x = _bits(np.asarray(batch.column(0).slice(at, 10_000))).astype(np.float64)
                total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(BITS * BITS), pa.int32()), "n": pa.array(total.ravel(), pa.int64())})

    both = np.zeros(BITS * BITS)
    for r in distinct.select("f").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        both[r.i] = r.n
    both = both.reshape(BITS, BITS)
    n = max(1.0, float(distinct.count()))
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    near = np.abs(both / n - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0.0)
    free, order = list(range(BITS)), []
    for _ in range(BLOCKS):
        first = max(free, key=lambda b: (near[b, free].sum(), -b))
        group = [first]
        free.remove(first)
        while len(group) < WIDTH:
            nearest = max(free, key=lambda b: (near[b, group].sum(), -b))
            group.append(nearest)
            free.remove(nearest)
        order += group
    return np.array(order)


def ordered_blocks(f: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The four blocks of each fingerprint as numbers of 16 bits (rows by blocks)."""
    bits = _bits(f)[:, order]
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u2").astype(np.int64)


def rings(distinct: DataFrame, order: np.ndarray) -> np.ndarray:
    """[block, distance 0 to 2, value]: how many fingerprints are that far from the value in that block. At most 4 * 65,536 counts come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BLOCKS, 1 << WIDTH), np.int64)
        for batch in batches:
            x = ordered_blocks(np.asarray(batch.column(0)), order)
            for b in range(BLOCKS):
                total[b] += np.bincount(x[:, b], minlength=1 << WIDTH)
        at = np.flatnonzero(total.ravel())
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_pydict({"at": pa.array(at[i : i + 50_000], pa.int32()), "n": pa.array(total.ravel()[at[i : i + 50_000]], pa.int64())})

    out = np.zeros((BLOCKS, NEAR + 1, 1 << WIDTH), np.float32)
    sums = distinct.select("f").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    exact = np.zeros(BLOCKS << WIDTH, np.float64)
    exact[sums["at"].to_numpy()] = sums["n"].to_numpy()
    exact = exact.reshape(BLOCKS, -1)
    values = np.arange(1 << WIDTH)
    for r in range(NEAR + 1):
        for flips in combinations(range(WIDTH), r):
            out[:, r] += exact[:, values ^ sum(1 << b for b in flips)]
    return out


def allocated(blocks: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Per fingerprint the threshold of each unit (-1: not looked at), by dynamic programming on estimated candidates and probes.

    A unit's candidates at each distance are estimated from its blocks' counts as if these were independent.
    """
    ring = {1 << b: [counts[b, r, blocks[:, b]].astype(np.float64) for r in range(NEAR + 1)] for b in range(BLOCKS)}

    def joined(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
        return [sum(x[i] * y[r - i] for i in range(r + 1)) / max(n, 1) for r in range(NEAR + 1)]

    ring[3], ring[12] = joined(ring[1], ring[2]), joined(ring[4], ring[8])
    ring[15] = joined(ring[3], ring[12])
    cost = {u: [np.zeros(len(blocks)), *(np.cumsum(ring[u], axis=0)[r] + PROBES[u][r] for r in range(NEAR + 1))] for u in UNITS}
    best, chosen = np.full(len(blocks), np.inf), np.full((len(blocks), len(UNITS)), -1, np.int8)
    for scheme in SCHEMES:
        # thresholds are counted from -1, so each partition spends 0 to 3 of a budget of t - m + 1 + m = 3
        budget = NEAR + 1
        table = [[np.zeros(len(blocks)) if s == 0 else np.full(len(blocks), np.inf) for s in range(budget + 1)]]
        picks = []
        for u in scheme:
            options = [np.stack([table[-1][s - t] + cost[u][t] for t in range(s + 1)]) for s in range(budget + 1)]
            picks.append([o.argmin(axis=0) for o in options])
            table.append([o.min(axis=0) for o in options])
        better = table[-1][budget] < best
        best = np.where(better, table[-1][budget], best)
        row = np.full((len(blocks), len(UNITS)), -1, np.int8)
        left = np.full(len(blocks), budget)
        for u, pick in zip(reversed(scheme), reversed(picks), strict=True):
            spent = np.stack(pick)[left, np.arange(len(blocks))]
            row[:, UNITS.index(u)] = spent - 1
            left = left - spent
        chosen[better] = row[better]
    return chosen


def _masks(unit: int, radius: int) -> np.ndarray:
    """All changes of at most radius bits among the unit's, as 64-bit masks; blocks stand in the fingerprint from the highest."""
    places = [16 * (BLOCKS - 1 - b) + i for b in range(BLOCKS) if unit >> b & 1 for i in range(WIDTH)]
    return np.array([sum(1 << p for p in flips) for r in range(radius + 1) for flips in combinations(places, r)], np.uint64)


def _keys(unit: int, x: np.ndarray) -> np.ndarray:
    """The fingerprints (blocks in order) with the unit's bits only."""
    return x & np.uint64(sum(0xFFFF << 16 * (BLOCKS - 1 - b) for b in range(BLOCKS) if unit >> b & 1))


def _in_order(f: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blocks = ordered_blocks(f, order)
    return blocks, np.ascontiguousarray(blocks.astype(">u2")).view(">u8").ravel().astype(np.uint64)


def _batch(unit: list[np.ndarray], key: list[np.ndarray], f: list[np.ndarray]) -> pa.RecordBatch:
    put = lambda x, kind, of: pa.array(np.concatenate(x).astype(of) if x else np.zeros(0, of), kind)
    return pa.RecordBatch.from_pydict({"unit": put(unit, pa.int8(), np.int8), "key": pa.array(np.concatenate(key).view(np.int64) if key else np.zeros(0, np.int64), pa.int64()), "f": put(f, pa.int64(), np.int64)})


def _index(distinct: DataFrame, order: np.ndarray) -> DataFrame:
    """unit, key, f: the value of each unit of each fingerprint."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.asarray(batch.column(0))
            x = _in_order(f, order)[1]
            yield _batch([np.full(len(f), u) for u in UNITS], [_keys(u, x) for u in UNITS], [f] * len(UNITS))

    return distinct.select("f").mapInArrow(keyed, "unit tinyint, key long, f long")


def _probes(distinct: DataFrame, order: np.ndarray, counts: np.ndarray | None, n: int) -> DataFrame:
    """unit, key, f: the probes of each fingerprint; without counts those of the whole fingerprint."""
    # a broadcast of fixed size (3 MB), whatever the input
    shared = distinct.sparkSession.sparkContext.broadcast(counts) if counts is not None else None

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000 if shared else 50):
                f = np.asarray(whole.column(0).slice(at, 2000 if shared else 50))
                blocks, x = _in_order(f, order)
                if shared:
                    chosen = allocated(blocks, shared.value, n)
                else:
                    chosen = np.full((len(f), len(UNITS)), -1, np.int8)
                    chosen[:, UNITS.index(15)] = NEAR
                out: tuple[list, list, list] = ([], [], [])
                for k, u in enumerate(UNITS):
                    for r in range(NEAR + 1):
                        rows = np.flatnonzero(chosen[:, k] == r)
                        if len(rows):
                            masks = _masks(u, r)
                            out[0].append(np.full(len(rows) * len(masks), u))
                            out[1].append((_keys(u, x[rows])[:, None] ^ masks).ravel())
                            out[2].append(np.repeat(f[rows], len(masks)))
                yield _batch(*out)

    return distinct.select("f").mapInArrow(probed, "unit tinyint, key long, f long")


def links(distinct: DataFrame) -> DataFrame:
    """a, b (a > b): the distinct fingerprints (column f) that differ in at most two bits, each link once; written to the shared folder."""
    n = distinct.count()
    order = bit_order(distinct)
    index = written(_index(distinct, order), "index")
    probes = written(_probes(distinct, order, rings(distinct, order), n), "probes")
    sizes = index.groupBy("unit", "key").agg(F.count("*").alias("c"))
    # a fingerprint meets itself once a partition that is looked at
    real = probes.join(sizes, ["unit", "key"]).groupBy("f").agg(F.sum("c").alias("candidates"))
    heavy = written(real.filter(F.col("candidates") > WHOLE).select("f"), "heavy")
    probes = probes.join(heavy, "f", "left_anti").unionByName(_probes(heavy, order, None, n))
    met = probes.withColumnRenamed("f", "a").join(index.withColumnRenamed("f", "b"), ["unit", "key"])
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > NEAR
    near = met.filter("a <> b").filter(~far).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = written(near, "near")
    for table in (index, heavy):
        discard(table)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id of those it is linked with, over any steps).

    Null or empty text has fingerprint zero and is linked like any other; repeated rows are linked; a null doc_id is the smallest only
    where there is no other; an empty table gives no rows; other columns are ignored.
    """
    rows = fingerprints(docs)
    distinct = written(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(distinct)).withColumnRenamed("rid", "f")
    classes = distinct.join(labels, "f", "left").select("f", "least", F.coalesce("label", "f").alias("label"))
    ids = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = written(classes.select("f", "label").join(ids, "label").select("f", "component_id"), "classes")
    return rows.join(classes.hint("merge"), "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
