import random
import re

import numpy as np

from tessera.llm import near_dedup as D

DOCS = "doc_id long, text string, rid string, label long, doc string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(docs):
    sets = [shingle_set(t) for _, t, *_ in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * len(a) >= 3 * len(b) and 4 * len(b) >= 3 * len(a) and 100 * len(a & b) >= 75 * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(str((d, len(sets[i]), least[find(i)], d == least[find(i)])) for i, (d, *_) in enumerate(docs))


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["Ä", "É x"]
    docs = []
    shared = " ".join(rng.choices(words, k=60))
    while len(docs) < n:
        base = rng.choices(words, k=rng.choice([1, 3, 5, 8, 20, 60, 150, 400]))
        if rng.random() < 0.2:
            base += shared.split()
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), rng.choice([" ", "\n", "\t "]).join(copy), "x", 1, "y"))
    rng.shuffle(docs)
    return docs + [(9000, None, None, None, None), (9001, "  ", None, None, None), (9002, "One two", "x", 1, "y"), (9003, "one  TWO", "x", 1, "y"), (None, docs[0][1], "x", 1, "y"), (None, "alone for ever and a day", "x", 1, "y"), docs[3], docs[3]]


def test_groups_agree_with_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        got = D.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(docs)


def test_blocks_find_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_ROUNDS", 1)
    monkeypatch.setattr(D, "BLOCK", 3)
    docs = corpus(3, 120)
    got = D.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs)


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = corpus(4, 80)
    df = spark.createDataFrame(docs, DOCS)
    kept = D.deduplicate(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    want = {x.split(", ")[2] for x in brute(docs) if not x.endswith("0, None, None)")}
    assert sorted({str(r.doc_id) for r in rows if r.doc_id is not None}) == sorted(w for w in want if w != "None")
    assert len(rows) == len({r.doc_id for r in rows if r.doc_id is not None}) + 1  # and the one without an id
    assert D.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_estimate_is_near_the_index():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        found = []
        for _ in range(40):
            common, a, b = rng.integers(0, 1 << 63, int(1000 * share)), rng.integers(0, 1 << 63, int(500 * (1 - share))), rng.integers(0, 1 << 63, int(500 * (1 - share)))
            x, y = (np.unique(np.concatenate([common, z]).astype(np.uint64) << np.uint64(1)) for z in (a, b))
            found.append(D.estimate(D.sketch(x), D.sketch(y)))
        assert abs(np.mean(found) - share) < 0.03


def test_longest_text(spark):
    text = " ".join(str(i) for i in range(120_000))
    got = D.near_duplicates(spark.createDataFrame([(5, text, "", 0, ""), (2, text + " more", "", 0, "")], DOCS)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 2, False), (2, 2, True)}


def test_small_sets_are_not_lost_by_the_estimate(spark, monkeypatch):
    docs = []
    for i in range(4000):  # 4 shingles and 3 of them: exactly 0.75
        words = [f"s{i}q{k}" for k in range(8)]
        a, b = " ".join(words), " ".join(words[:7])
        x, y = D.shingles(a.encode()), D.shingles(b.encode())
        if D.estimate(D.sketch(x), D.sketch(y)) < D.LEAST_ESTIMATE and (D.band_keys(x) == D.band_keys(y)).any():
            docs += [(2 * i, a, "", 0, ""), (2 * i + 1, b, "", 0, "")]
    assert len(docs) >= 4
    for rounds in (D.MAX_ROUNDS, 0):  # by stars, and by blocks
        monkeypatch.setattr(D, "MAX_ROUNDS", rounds)
        got = D.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
        assert sorted(str(tuple(r)) for r in got) == brute(docs)


def test_sets_kept_whole_are_compared_exactly():
    rng = np.random.default_rng(5)
    for n, m, both in ((4, 3, 3), (4, 4, 3), (128, 96, 96), (128, 128, 110), (128, 128, 109), (1, 1, 0), (128, 150, 128), (150, 128, 60)):
        x = np.unique(rng.integers(1, 1 << 63, n + m - both).astype(np.uint64) << np.uint64(1))
        a, b = x[:n], x[n - both :]
        rows = [D.sketch(s).tobytes() if len(s) > D.EXACT else s.tobytes().ljust(D.SKETCH, b"\0") for s in (a, b)]
        rows = [np.frombuffer(r, np.uint8).reshape(1, -1) for r in rows]
        assert D._may_link(np.array([n]), np.array([m]), *rows)[0] == (100 * both >= 75 * (n + m - both))


def test_no_link_is_lost_at_the_threshold():
    """Pairs of exactly 0.75: how many have no shared band, or an estimate too low to be looked at. README gives the figures of a larger run."""
    rng = np.random.default_rng(11)
    lost, lowest = 0, 1.0
    for n in (132, 400, 1200, 4000):
        for _ in range(120):
            x = np.unique(rng.integers(1, 1 << 63, n + 100).astype(np.uint64) << np.uint64(1))[: n // 8 * 8]
            rng.shuffle(x)
            both, own = len(x) * 6 // 8, len(x) // 8  # 6/8 shared, 1/8 each: 0.75
            a, b = np.sort(x[: both + own]), np.sort(np.concatenate([x[:both], x[both + own :]]))
            e = float(D.estimate(D.sketch(a), D.sketch(b)))
            lowest = min(lowest, e)
            lost += e < D.LEAST_ESTIMATE or not (D.band_keys(a) == D.band_keys(b)).any()
    assert lost == 0 and lowest > 0.69


def test_ids_that_are_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_IDS", 0)
    docs = corpus(6, 60)
    got = D.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs)
