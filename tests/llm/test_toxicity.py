import random
import zlib

import pytest

from tessera.llm import toxicity as T

DOCS = "doc_id long, text string, score string, toxic long"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_agrees_with_edit_distances():
    rng = random.Random(4)
    words = {"".join(rng.choices("abc", k=rng.randint(3, 8))): 1.0 for _ in range(25)}
    stems = {"cab": 1.0, "bbaca": 1.0}
    a = T.LexiconAutomaton(T.Model(words, stems, known=frozenset({"aaaaaa"})))
    for _ in range(4000):
        w = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        exact = w in words or any(w.startswith(s) for s in stems)
        near = any(len(t) >= T.FUZZY_LETTERS and edits(w, t) <= 1 for t in words) and w != "aaaaaa"
        got = a.hit(w)
        assert (got is not None) == (exact or near), w
        assert got is None or (got[1] == 1.0) == exact


def test_quotation_counts_less():
    a = T.LexiconAutomaton(T.Model({"idiot": 5.0}, {}))
    free = a.features("you are an idiot today")[1]
    for text in ('he was “an idiot” there', 'the sign "some idiot here" hung', "she wrote that an idiot did it"):
        assert a.features(text)[1] == pytest.approx(free * T.QUOTED)
    assert a.features("you are an idiiot today")[1] == T.FUZZY and a.features("")[1] == 0


def corpus():
    rng = random.Random(8)
    plain = ["".join(rng.choices("aeioumnrst", k=rng.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(0, 60))
        bad = i % 6 == 0
        if bad:
            words += rng.choices(["wretchling", "zounderkin", "zounderous", "zounderful"], k=3)
            rng.shuffle(words)
        docs.append((i, " ".join(words), "x", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return docs + [(900, None, None, None), (901, "", None, None), (None, "wretchling", None, None), (5, "wretchlimg you", None, None)], labels + [(None, 1, 1), (3, 1, None)]


def test_learns_from_labelled_rows_and_scores_all(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = T.toxicity(df, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    got = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id != 5}
    held = [i for i in range(600) if i != 5 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} & set(range(600)) == set(held)
    assert sum(got[i].predicted == int(i % 6 == 0) for i in held) >= 0.98 * len(held)
    assert got[900].score == got[901].score < 0.5
    assert next(r for r in rows if r.doc_id is None).predicted == 1
    assert sorted(r.predicted for r in rows if r.doc_id == 5)[-1] == 1  # misspelled
    assert T.score(df, T.Model({}, {})).columns == ["doc_id", "text", "toxic", "score"]


def test_empty_tables_and_one_class(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in T.toxicity(df, none).collect()} == {0}
    assert T.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_misspelled_forms_of_a_stem_family(spark):
    docs, labels = corpus()
    model = T.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any("zounderful".startswith(s) for s in model.stems) and "zounderful" not in model.words
    a = T.LexiconAutomaton(model)
    for word in ("zonderful", "zounnderful", "zoinderous", "ounderkin"):
        assert a.hit(word)[1] == T.FUZZY and a.score(f"you {word} there") >= 0.5, word
    assert a.hit("zounderful")[1] == 1.0
