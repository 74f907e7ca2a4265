import hashlib
import random
import re

from pyspark.sql import types as T

from tessera.llm import decontamination as D

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("items", T.StringType()), T.StructField("starts", T.LongType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, names = split(text), set(), set()
    for name, item in items:
        t = split(item)
        n = min(window, len(t))
        grams = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} if t else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
                names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def case(seed, vocabulary, n_items=12, n_docs=80):
    rng = random.Random(seed)
    w = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, w(rng.choice([0, 1, 2, 5, 12, 13, 14, 40]))) for i in range(n_items)] + [(98, None), (99, "Über-ß 9x!")]
    docs = [(i, w(rng.randint(0, 60)) + rng.choice(["", " " + (rng.choice(items)[1] or "").upper() + ". ", "über ß 9X"]) + w(rng.randint(0, 300)), "z", 4) for i in range(n_docs)]
    return docs + [(200, None, None, None), (200, "", None, None), (None, items[3][1], None, None), (None, items[3][1], None, None)], items


def test_matches_agree_with_brute_force(spark):
    for seed, vocabulary, window in ((1, ["a", "b", "c"], 13), (2, ["a", "b"], 5), (3, [f"w{i}" for i in range(9)], 13)):
        docs, items = case(seed, vocabulary)
        bench = spark.createDataFrame(items, "item_id long, text string")
        for block_words in (D.BLOCK_WORDS, 60):  # in one block, and in several
            got = D.contamination(spark.createDataFrame(docs, DOCS), bench, window, block_words).collect()
            want = [(d, *brute(t, items, window)) for d, t, _, _ in docs]
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_tables(spark):
    docs, items = case(4, ["a", "b", "c"])
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(spark.createDataFrame(docs, DOCS), none).collect()
    assert len(got) == len(docs) and all(r.n_hit == 0 and not r.contaminated for r in got)
    assert D.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontaminate_drops_or_cuts(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rest = " ".join(f"r{i}" for i in range(900))
    docs = [(1, item, "x", 1), (2, f"Start, {item}; {rest}", "x", 1), (3, rest, "x", 1), (4, None, "x", 1)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(docs[1:])
    cut = {r.doc_id: r for r in D.decontaminate(df, bench, span_words=20).collect()}
    assert cut[2].text == f"Start, ; {rest}" and cut[3].text == rest and cut[4].text is None and cut[2].items == "x" and cut[2].starts == 1


def test_longest_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    text = "a " * 300_000 + item
    got = D.contamination(spark.createDataFrame([(1, text, None, None)], DOCS), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (300_020, 20, False)
