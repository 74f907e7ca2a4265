"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct five-word shingles (64-bit hashes). For each bucket of the hash space
a register keeps the number of leading zeros of the bucket's least hash and some bits of mantissa after
them, twice:

- ``REGISTERS`` registers of 16 bits, of which bands of ``ROWS`` give keys; an empty bucket borrows from
  another in an order that is fixed for each bucket. Documents that share a key are candidates.
- ``SKETCH`` registers of 8 bits (0: empty), from which the Jaccard index is estimated, corrected for registers equal by
  chance. Candidates whose sizes allow it and whose estimate is ``LEAST_ESTIMATE`` or more (over four
  standard errors below the threshold) are verified on full sets. A set of at most ``EXACT`` shingles is kept
  whole in the place of its registers, as few shingles make the estimate coarse; two such sets are compared exactly.

Only connectivity matters, so a group never makes all its pairs:

1. Documents of equal sets count once.
2. Star rounds: in each bucket of a band the members are paired with one of them. After each
   round, components are taken from the verified links; the next one looks at buckets that still hold several.
3. What is left: in such buckets, members outside the hub's component meet those of other components, in
   blocks of at most about ``BLOCK`` each; pairs whose estimate passes are verified.

So a link between candidates is lost only if its ends are connected anyway. Keys, pairs and links stay in Spark;
rounds are written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, written
from .tokens import forget

WORDS = 5
SIMILAR = (75, 100)
REGISTERS, ROWS, MANTISSA = 128, 4, 10
SKETCH, SKETCH_MANTISSA = 1024, 4
LEAST_ESTIMATE = 0.69
EXACT = SKETCH // 8
BLOCK = 256
#: Ids that are broadcast, to fetch texts without a shuffle of all of them, at most; more take a shuffle.
BROADCAST_IDS = 1_000_000
MAX_ROUNDS = 12
#: Words whose hashes a worker keeps while it reads a partition, about 130 bytes each.
MEMO_ENTRIES = 150_000

#: Two different leasts fall in one register of the sketch: the same leading zeros (a third), the same mantissa.
BY_CHANCE = 1 / 3 / (1 << SKETCH_MANTISSA)
_memo: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Finisher of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, 2 * WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_ORDER = np.argsort(_mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of UTF-8 text; of fewer words, one of all."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    memo = _memo
    if len(memo) > MEMO_ENTRIES:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WORDS + 1)
    if len(h) < WORDS:
        total = (h * _FACTORS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + _FACTORS[WORDS + len(h)]
    else:
        total = sum((h[i : i + n] * _FACTORS[i] for i in range(WORDS)), np.zeros(n, np.uint64))
    return np.unique(_mix(total))


def _leasts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of sorted distinct hashes in each bucket of the first bits, without these; and which buckets have one."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    least = hashes[np.minimum(hashes.searchsorted(starts), len(hashes) - 1)]
    full = (least >> np.uint64(64 - bits) == np.arange(1 << bits, dtype=np.uint64)) & (least >= starts)
    return least & np.uint64((1 << 64 - bits) - 1), full


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the bands of sorted distinct hashes, of which there is one at least."""
    least, full = _leasts(hashes, REGISTERS.bit_length() - 1)
    m, e = np.frexp(least.astype(np.float64))
    out = (e.astype(np.uint16) << MANTISSA) | ((m - 0.5).clip(0) * (2 << MANTISSA)).astype(np.uint16)
    if not full.all():
        out = np.where(full, out, out[_ORDER[np.arange(REGISTERS), full[_ORDER].argmax(axis=1)]])
    packed = np.ascontiguousarray(out.reshape(-1, ROWS)).view(np.uint64).reshape(-1)
    return _mix(packed ^ _mix(np.arange(len(packed), dtype=np.uint64) + np.uint64(77))).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 8-bit registers of sorted distinct hashes, of which there is one at least."""
    bits = SKETCH.bit_length() - 1
    least, full = _leasts(hashes, bits)
    m, e = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - bits - e, 15)
    out = 1 + (zeros << SKETCH_MANTISSA) + ((m - 0.5).clip(0) * (2 << SKETCH_MANTISSA)).astype(np.int64)
    return np.where(full, np.minimum(out, 255), 0).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard index from sketches (last axis): equal registers among those that either has, corrected for chance."""
    either = ((a | b) != 0).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    return np.clip((equal / np.maximum(either, 1) - BY_CHANCE) / (1 - BY_CHANCE), 0, 1)


def _may_link(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sets of n and m shingles may be similar, from rows of the sketch column: exact if both are kept whole."""
    share, of = SIMILAR
    whole = (n <= EXACT) & (m <= EXACT)
    out = np.zeros(len(n), bool)
    if whole.any():
        n_, m_ = n[whole], m[whole]
        both = np.sort(np.concatenate([a[whole].view(np.uint64), b[whole].view(np.uint64)], axis=1), axis=1)
        # zeros that fill the rows are equal neighbours, too
        equal = (both[:, 1:] == both[:, :-1]).sum(axis=1) - np.maximum(2 * EXACT - n_ - m_ - 1, 0)
        out[whole] = of * equal >= share * (n_ + m_ - equal)
    if not whole.all():
        rest = ~whole
        x, y = _registers(n[rest], a[rest]), _registers(m[rest], b[rest])
        out[rest] = estimate(x, y) >= LEAST_ESTIMATE
    return out


def _registers(n: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows (a copy), with the registers in the place of sets that are kept whole."""
    for i in np.flatnonzero(n <= EXACT):
        rows[i] = sketch(rows[i].view(np.uint64)[: n[i]])
    return rows


def _utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _split(small: DataFrame) -> DataFrame:
    """The side of a join that has one row a key. Both sides are sorted, so that Spark splits a hot key of the other side over
    tasks (skew join); with a hash or broadcast join after the shuffle its rows would stay in one task."""
    return small.hint("merge")


def numbered(docs: DataFrame, *names: str) -> DataFrame:
    """rid (a number of the row), doc (the named columns): written to the shared folder, as the number must not change."""
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc")), "numbered")


def signatures(rows: DataFrame) -> DataFrame:
    """rid, doc_id, n, d1, d2 (digest of the set), keys, sketch: written to the shared folder."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, d1, d2, keys, sketches = [], [], [], [], []
                for text in _utf8(batch.column(2)):
                    s = shingles(text)
                    n.append(len(s))
                    digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                    d1.append(digest[0])
                    d2.append(digest[1])
                    keys.append(band_keys(s) if len(s) else None)
                    sketches.append((sketch(s).tobytes() if len(s) > EXACT else s.tobytes().ljust(SKETCH, b"\0")) if len(s) else None)
                columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n", "d1", "d2", "keys", "sketch"])
        _memo.clear()
        give_back()

    texts = rows.select("rid", "doc.doc_id", F.coalesce("doc.text", F.lit("")).alias("text"))
    return written(texts.mapInArrow(sign, "rid long, doc_id long, n long, d1 long, d2 long, keys array<bigint>, sketch binary"), "signatures")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _close(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate, or exact index, passes."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keep = pa.array(_may_link(np.asarray(batch.column(4)), np.asarray(batch.column(5)), _sketches(batch.column(2)), _sketches(batch.column(3))))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sketches = sigs.select("rid", "n", "sketch")
    joined = pairs.join(_split(sketches.withColumnsRenamed({"rid": "a", "n": "n_x", "sketch": "x"})), "a").join(_split(sketches.withColumnsRenamed({"rid": "b", "n": "n_y", "sketch": "y"})), "b")
    return joined.select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(passed, "a long, b long")


def _sets(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """rid, s (the sorted hashes of its shingles) of the documents in pairs, written to the shared folder."""
    need = written(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "rid"), "needed")
    need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in _utf8(batch.column(1))], pa.binary())], ["rid", "s"])
        _memo.clear()
        give_back()

    texts = rows.join(need, "rid", "left_semi").select("rid", F.coalesce("doc.text", F.lit("")).alias("text"))
    return written(texts.mapInArrow(hashed, "rid long, s binary"), "sets")


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar, written to the shared folder. Pair rows hold hashes, never texts."""
    share, of = SIMILAR

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(of * both >= share * (len(s) + len(t) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    sets = _sets(pairs, rows)
    joined = pairs.join(_split(sets.withColumnsRenamed({"rid": "a", "s": "x"})), "a").join(_split(sets.withColumnsRenamed({"rid": "b", "s": "y"})), "b")
    found = written(joined.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "verified")
    discard(sets)
    return found


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """rid, label (the least rid of its component) for rids in links (a, b) or in labels from before."""
    both = links.select("a", "b").union(links.select("b", "a"))
    if before is not None:
        both = both.union(before.select("rid", "label")).union(before.select("label", "rid"))
    edges = written(both.filter("a <> b").distinct(), "links")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("rid"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(_split(labels), edges.b == labels.rid).groupBy("a").agg(F.min("label").alias("m"))
        moved = labels.join(near, labels.rid == near.a).select("rid", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("rid").alias("to"), F.col("label").alias("further"))
        new = written(moved.join(_split(jump), "to", "left").select("rid", F.least(F.coalesce("further", "to"), "to").alias("label"), "was"), "labels")
        labels = new.select("rid", "label")
        if not new.filter("label <> was").head(1):
            return labels


def _buckets(sigs: DataFrame) -> DataFrame:
    """key, rid, n: bands' buckets that hold two documents at least."""

    rows = sigs.select("rid", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    return written(rows.join(_split(written(shared, "keys")), "key"), "buckets")


def _left(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """key, rid, n, label of the buckets that hold several components."""
    if labels is None:
        return buckets.withColumn("label", F.col("rid"))
    now = written(buckets.join(labels, "rid", "left").select("key", "rid", "n", F.coalesce("label", "rid").alias("label")), "labelled")
    several = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return written(now.join(_split(written(several, "several")), "key"), "left")


def _star(left: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b): members of a bucket and the one of them that comes first in the turn's order."""
    order = F.struct(F.xxhash64("rid", F.lit(turn)).alias("o") if turn else F.col("rid").alias("o"), "rid", "label", "n")
    hubs = written(left.groupBy("key").agg(F.min(order).alias("h")).select("key", F.col("h.rid").alias("b"), F.col("h.label").alias("hub_label"), F.col("h.n").alias("hub_n")), "hubs")
    sizes = SIMILAR[1] * F.least("n", "hub_n") >= SIMILAR[0] * F.greatest("n", "hub_n")
    return left.join(_split(hubs), "key").filter("label <> hub_label").filter(sizes).select(F.col("rid").alias("a"), "b").distinct()


def _rest(left: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in one bucket whose estimate, or exact index, passes, found block by block."""
    hubs = left.groupBy("key").agg(F.min(F.struct("rid", "label")).alias("h"), F.count("*").alias("m"))
    mine = left.join(_split(written(hubs.select("key", F.col("h.label").alias("main"), "m"), "mains")), "key")
    outside = mine.groupBy("key").agg(F.sum((F.col("label") != F.col("main")).cast("long")).alias("o"))
    mine = written(mine.join(_split(written(outside, "outside")), "key").join(sigs.select("rid", "keys", "sketch"), "rid"), "members")
    members, outer = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("o") / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["rid", "label", "n", "keys", "sketch"]
    a = mine.filter("label <> main").select("key", part(outer).alias("i"), every(members).alias("j"), F.lit(0).alias("side"), *columns)
    b = mine.select("key", every(outer).alias("i"), part(members).alias("j"), F.lit(1).alias("side"), *columns)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, of = SIMILAR

        def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
            plain = [np.asarray(batch.column(k)) for k in range(7)]
            return [*plain, np.asarray(batch.column(7).flatten()).reshape(batch.num_rows, -1), _sketches(batch.column(8))]

        def pairs(key: int, side: np.ndarray, rid: np.ndarray, label: np.ndarray, n: np.ndarray, keys: np.ndarray, sketches: np.ndarray) -> list[np.ndarray]:
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            out = []
            for x in one:
                y = two[(label[two] != label[x]) & (of * np.minimum(n[two], n[x]) >= share * np.maximum(n[two], n[x]))]
                # a pair is looked at in the first of the buckets that it shares
                y = y[keys[x][(keys[y] == keys[x]).argmax(axis=1)] == key] if len(y) else y
                y = y[_may_link(np.full(len(y), n[x]), n[y], np.repeat(sketches[x : x + 1], len(y), axis=0), sketches[y])] if len(y) else y
                if len(y):
                    out.append(np.stack([np.maximum(rid[x], rid[y]), np.minimum(rid[x], rid[y])]))
            return out

        def found(held: list[np.ndarray], edges: list[int]) -> pa.RecordBatch:
            out = [p for at, end in zip(edges, edges[1:]) for p in pairs(held[0][at], *(x[at:end] for x in held[3:]))]
            both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_pydict({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

        held: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                held = arrays(batch) if held is None else [np.concatenate(x) for x in zip(held, arrays(batch), strict=True)]
                changed = (np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)
                edges = [0, *(np.flatnonzero(changed) + 1).tolist()]
                yield found(held, edges)
                held = [x[edges[-1] :] for x in held]
        if held is not None:
            yield found(held, [0, len(held[0])])

    work = a.union(b).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return work.mapInArrow(met, "a long, b long").distinct()


def linked(sigs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """rid, label for documents of the signature table (of different sets) that have a link."""
    buckets = _buckets(sigs)
    labels, known = None, 0
    for turn in range(MAX_ROUNDS):
        left = _left(buckets, labels)
        each = left.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
        size = each.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs"), F.sum("m").alias("rows")).first()
        if not size.pairs:
            return labels
        if turn and size.pairs <= 4 * size.rows:
            break  # few pairs are left: they are looked at one by one
        links = _verified(written(_close(_star(left, turn), sigs), "close"), rows)
        if not links.head(1):
            break
        labels = components(links, labels)
        merged = labels.filter("label <> rid").count()
        if merged < 1.02 * known:
            break
        known = merged
    left = _left(buckets, labels)
    links = _verified(written(_rest(left, sigs), "close"), rows)
    return components(links, labels) if links.head(1) else labels


def groups(rows: DataFrame) -> DataFrame:
    """Per row of a numbered table (rid, doc with doc_id and text): rid, doc_id, n_shingles, component_id (the smallest doc_id of
    its group) and first (whether the row is the first of its group by doc_id and rid).

    Null or empty text has no shingles and is linked with nothing; repeated rows are equal sets; a null
    doc_id is the smallest only where the group has no other; an empty table gives no rows; other columns are ignored.
    """
    sigs = signatures(rows)
    some = sigs.filter("n > 0")
    id_order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    sets = written(some.groupBy("d1", "d2").agg(F.min("rid").alias("rep"), F.min(id_order).alias("least")), "sets")
    distinct = some.join(sets.select(F.col("rep").alias("rid")), "rid", "left_semi")
    distinct = written(distinct.select("rid", "n", "keys", "sketch"), "distinct")
    slim = written(sigs.drop("keys", "sketch"), "slim")
    discard(sigs)
    some, sigs = slim.filter("n > 0"), slim
    labels = linked(distinct, rows)
    if labels is not None:
        sets = sets.join(labels, sets.rep == labels.rid, "left").select("d1", "d2", "least", F.coalesce("label", "rep").alias("label"))
        by_label = sets.groupBy("label").agg(F.min("least").alias("least"))
        sets = sets.select("d1", "d2", "label").join(by_label, "label").select("d1", "d2", "least")
        sets = written(sets, "sets")
    columns = ["rid", "doc_id", F.col("n").alias("n_shingles")]
    full = some.select("rid", "doc_id", "n", "d1", "d2").join(sets.select("d1", "d2", "least"), ["d1", "d2"])
    full = full.select(*columns, F.col("least.doc_id").alias("component_id"), (F.col("least.rid") == F.col("rid")).alias("first"))
    empty = sigs.filter("n = 0").select(*columns, F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id = component_id; both null counts as equal)."""
    return groups(numbered(docs, "doc_id", "text")).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The first row of each group, by doc_id; the columns of docs. Rows without words all stay."""
    rows = numbered(docs, *docs.columns)
    return rows.join(groups(rows).filter("first").select("rid"), "rid", "left_semi").select("doc.*")
