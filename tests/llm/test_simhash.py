import random

import numpy as np
import xxhash

from tessera.llm import simhash as S

SCHEMA = "doc_id long, text string, fingerprint string, f long, key int"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """component of each of (doc_id, fingerprint), by all pairs."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(prints))]


def texts(n=260, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghiäß日", k=rng.randint(2, 6)))
    vocabulary = [word() for _ in range(400)]
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(150, 900))
        out.append(" ".join(words))
        if rng.random() < 0.4:  # near copies, a word or two changed, in chains
            for _ in range(rng.randint(1, 3)):
                words = list(words)
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
                out.append("\t".join(w if w.upper() != w.upper().lower().upper() or "ß" in w else w.upper().replace("Ä", "ä") for w in words))
    return out + [None, "", " \n", "one", "One two", "one  two", "ONE TWO three", out[0]]


def test_near_duplicates_against_brute_force(spark):
    rows = [(7 * i + 3, t, "x", 1, None) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    want = brute(prints)
    assert len(set(want)) < len(rows) - 60
    for (i, f), c in zip(prints, want, strict=True):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == c


def test_links_of_skewed_fingerprints(spark):
    """Most fingerprints share three blocks, so no single block or pair of blocks tells them apart."""
    rng = np.random.default_rng(3)
    hot = np.uint64(0x0123456789AB0000) + rng.choice(1 << 16, 4000, replace=False).astype(np.uint64)
    spread = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = spread[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    f = np.unique(np.concatenate([hot, spread, near]))
    frame = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f long")
    got = {(r.a, r.b) for r in S.links(frame).collect()}
    signed = f.view(np.int64)
    want = set()
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 2):
            a, b = int(signed[i]), int(signed[j])
            want.add((max(a, b), min(a, b)))
    assert len(want) > 4000 and got == want


def test_thresholds_keep_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    f = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    order = rng.permutation(64)
    blocks, x = S._in_order(f, order)
    counts = rng.integers(0, 500, (4, 3, 1 << 16)).astype(np.float32)
    chosen = S.allocated(blocks, counts, 100_000)
    for row in chosen:
        sums = {s: sum(int(row[S.UNITS.index(u)]) for u in s) for s in S.SCHEMES if any(row[S.UNITS.index(u)] >= 0 for u in s)}
        assert len(sums) == 1
        (scheme, total), = sums.items()
        assert total == S.NEAR - len(scheme) + 1
    for u in S.UNITS:
        for r in range(3):
            assert len(set(S._masks(u, r).tolist())) == S.PROBES[u][r]
            assert all(int(S._keys(u, m[None])[0]) == int(m) for m in S._masks(u, r))
    assert all(int(k) == int("".join(f"{int(v) % (1 << 64):064b}"[b] for b in order), 2) for k, v in zip(x[:20], f[:20], strict=True))


def test_empty_and_repeated(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d", "", 0, 0), (5, "a b c d", "", 0, 0), (None, "A B C D", "", 0, 0), (9, "", "", 0, 0), (4, None, "", 0, 0)]
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(5, 5), (5, 5), (None, 5), (9, 4), (4, 4)], key=repr)


def test_long_texts_are_read_whole():
    text = "x" * 3_000_000 + " aa bb cc " + " ".join(f"w{i % 5000}" for i in range(600_000)) + " " * 2_000_000
    pieces = np.concatenate(list(S.shingle_hashes(text.encode())))
    words = text.split()
    assert len(pieces) == len(words) - 2
    assert int(pieces[-1]) == xxhash.xxh64(" ".join(words[-3:]).encode(), seed=42).intdigest()
    assert S.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * int((pieces >> np.uint64(b) & np.uint64(1)).sum()) > len(pieces))
    assert S.fingerprint(b"a b" + b" " * 3_000_000) == plain_fingerprint("a b")
