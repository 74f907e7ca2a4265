import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import source_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, k int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, ranks):
    times, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        times[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = sorted(s for x, s in groups if x == lang)
        whole = sum((times[lang, s] for s in mine), Counter())

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(times[lang, s]) for s in mine}
        for s in mine:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if times[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def corpus(n=900, seed=2, sources=15):
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in "abcdefgh" for b in "ijklmn"]
    names = ["".join(rng.choices("abcdefghijkläß日", k=5)) for _ in range(200)]
    rare = defaultdict(lambda: rng.sample(names, 25))
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["hot"] * 6 + [f"s{k}" for k in range(sources)] + [None, ""])
        words = rng.choices(common, k=rng.randint(0, 40)) + rng.choices(rare[source], k=rng.randint(0, 15))
        rows.append((i, rng.choice([" ", "1", "\n_"]).join(rng.choice([w, w.upper(), w.title()]) for w in words) if rng.random() < 0.97 else None, lang, source, "t", 1, 2))
    return rows + [(n, None, "xx", "only", "", 0, 0), (n + 1, "lonely words", "xx", "other", "", 0, 0), rows[0], rows[0]]


def got(df):
    return [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()]


@pytest.mark.parametrize(("tile_groups", "tile_terms", "heavy"), [(64, 4096, 8), (4, 7, 3), (3, 10, 0), (2, 5, 100)])
def test_against_brute_force(spark, monkeypatch, tile_groups, tile_terms, heavy):
    monkeypatch.setattr(D, "TILE_GROUPS", tile_groups)
    monkeypatch.setattr(D, "TILE_TERMS", tile_terms)
    monkeypatch.setattr(D, "HEAVY", heavy)
    rows = corpus()
    found = got(D.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), least_documents=12, ranks=7))
    assert len(found) == len(set(found)) and set(found) == brute(rows, 12, 7)


def test_counters_are_sent_on_when_large(spark, monkeypatch):
    monkeypatch.setattr(D, "ENTRIES", 50)
    monkeypatch.setattr(D, "PIECE", 10)
    rows = corpus(200)
    assert set(got(D.divergence(spark.createDataFrame(rows, SCHEMA), least_documents=5))) == brute(rows, 5, 50)


def test_share_is_exact_beyond_64_bits(spark):
    counts = [0, 7, 10**12, 123_456_789_012_345]
    frame = spark.createDataFrame([(c, 10**15, 10**6) for c in counts], "c long, n long, v long")
    import pyspark.sql.functions as F

    assert [r.p for r in frame.select(D.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()] == [1 + 10**9 * (c + 5) // (10**15 + 5 * 10**6) for c in counts]


def test_empty(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_of_long_texts():
    text = ("ÄBc,dé1" * 400_000).encode()
    assert sum((Counter(p) for p in D.words(text)), Counter()) == Counter(t.translate({c: c + 32 for c in range(65, 91)}).encode() for t in TERM.findall(text.decode()))
    assert np.array_equal([len(x) for x in D.words(b"")], [])
