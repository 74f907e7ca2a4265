import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S

DOCS = "doc_id long, text string, chunk long, ids string, data string"


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + S.LENGTH] for b in data for k in range(len(b) - S.LENGTH + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - S.LENGTH + 1):
            if count[b[k : k + S.LENGTH]] > 1:
                gone[k : k + S.LENGTH] = b"\1" * S.LENGTH
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def corpus(seed, n=90):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdé\n xyz", k=k))
    shared = [text(k) for k in (195, 199, 200, 201, 230, 260, 400, 900)]
    texts = []
    for _ in range(n):
        parts = [text(rng.choice([0, 1, 30, 150, 700]))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            s = rng.choice(shared)
            a, b = sorted((rng.randint(0, len(s)), rng.randint(0, len(s))))
            parts += [rng.choice([s, s, s[a:b]]), text(rng.choice([0, 5, 300]))]
        texts.append("".join(parts))
    return texts + [texts[5], texts[5], texts[7][:-1], "a" * 450, "ab" * 90, "", None, "b" * 199, "b" * 199, "c" * 200, "c" * 200, shared[2], shared[1], shared[1]]


def test_cover_and_lengths():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
    assert S.WEAK + S.PERIOD - 1 == S.LENGTH == S.STRONG - S.PERIOD + 1


@pytest.mark.parametrize(("seed", "chunk", "part"), [(1, 1 << 22, 4_000_000), (2, 3000, 500), (3, 1, 50), (4, 20_000, 1000)])
def test_repeats_agree_with_brute_force(spark, seed, chunk, part):
    texts = corpus(seed)
    ids = [None if i == 3 else 4 if i == 5 else i for i in range(len(texts))]
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in zip(ids, texts, strict=True)], DOCS)
    got = S.repeats(df, chunk, part, confirm=True).drop("begins", "ends").collect()
    want = [(d, *w) for d, w in zip(ids, brute(texts), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_and_long(spark):
    assert S.repeats(spark.createDataFrame([], DOCS)).count() == 0
    rng = np.random.default_rng(0)
    long = "".join(map(chr, rng.integers(97, 123, 700_000)))
    rows = S.repeats(spark.createDataFrame([(1, long, 0, "", ""), (2, "q" + long[300_000:301_000], 0, "", "")], DOCS)).collect()
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in rows} == {(1, 1000, 1), (2, 1000, 1)}


def test_names_that_collide_are_found_out(spark, monkeypatch):
    """With names of a few bits different strings share them; the bytes tell, and with other names all is done again."""
    real, seeds = S.joined, []

    def coarse(*names):
        seeds.append(1)
        return real(*names) & np.uint64(0xFFFF << 40)

    texts = corpus(5, 30)
    chunks = [S.Chunk(b"".join(t.encode() for t in part if t), np.array([len(t.encode()) for t in part if t], np.int64)) for part in (texts[:15], texts[15:])]
    good = S._passes(chunks[0], 1, 5, [None, None, None])
    _, equal = S._claims(chunks[0], 1, [None, None, None])
    assert equal and good
    monkeypatch.setattr(S, "joined", coarse)
    assert not S._claims(chunks[0], 1, [None, None, None])[1]
    assert seeds


def test_catalog_is_left_as_it_was(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert S.repeats(spark.createDataFrame([(1, "a" * 500, 0, "", "")], DOCS)).first().n_removed == 500
    assert {t.name for t in spark.catalog.listTables()} == before
