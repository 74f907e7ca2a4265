import hashlib
import random
import re

from pyspark.sql import types as T

from tessera.llm import secrets as S

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("row", T.StringType()), T.StructField("spans", T.LongType())])
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [sum(k == n for _, k, _ in found) for n in range(3)] + [",".join(x for *_, x in sorted(found))]


def test_base_spans_agree_with_brute_force(spark):
    rng = random.Random(1)
    parts = ["password=", "token: '", "Secret", "API_KEY\"", "apikey  :  ", "=", ":", " ", "é", "😀", "abc", "Abc-123/", "AKIA", "AKIA" + "Z9" * 9, "deadbeef" * 3, "0f" * 14, "\n", "x=y", "'", "passwd==short ", "tok"]
    docs = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60))), f"s{i % 3}", "r", 1) for i in range(500)] + [(501, None, None, None, None), (501, "", None, None, None), (None, "token=abcdef12", None, None, None), (None, "token=abcdef12", None, None, None)]
    got = S.scan(spark.createDataFrame(docs, DOCS)).collect()
    want = sorted(str((d, *(b := base(t or ""))[:3], hashlib.sha256(b[3].encode()).hexdigest())) for d, t, *_ in docs)
    assert sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got) == want
    assert S.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_ownership_separates_examples_from_live_values(spark):
    hosted = "ghp_" + "a1B2c3D4e5" * 4
    live, example = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "9b2cc06d11e14faf9bd0a7c0e5f0a1b2c3d4e5f6"
    docs = [(i, f"token = \"{example}\" end", f"owner{i}", "r", 1) for i in range(40)]
    docs += [(100, f"x {hosted} y", "a", "r", 1), (101, f"password: {live} and token={live}", "a", "r", 1), (102, "no secrets", "a", "r", 1)]
    docs += [(110 + i, "ghp_" + "Zz9Yy8Xx7W" * 4, f"owner{i}", "r", 1) for i in range(9)]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r for r in S.scan(df).collect()}
    assert got[100].spans == "hosting:2:46" and got[100].n_live == 1 and got[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[101].n_live == 4 and got[0].n_live == 0 and got[0].n_copied == 2 and got[0].n_assign == 1
    assert got[110].spans == ""  # an added kind whose value is widely copied
    clean = {r.doc_id: r for r in S.redact(df).collect()}
    assert S.redact(df).columns == df.columns and len(clean) == len(docs)
    assert clean[101].text == "[secret] and [secret]" and clean[100].text == "x [secret] y"
    assert clean[0].text == docs[0][1] and clean[102].row == "r" and clean[102].spans == 1


def test_many_repositories_of_one_owner_are_a_copied_example(spark):
    value = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    docs = [(i, f"token = {value}", "one", "r", 1) for i in range(S.MAX_REPOSITORIES + 1)] + [(900, "token = 0a1b2c3d4e5f60718293a4b5c6d7e8f901234567", "one", "r", 1)]
    got = {r.doc_id: r for r in S.scan(spark.createDataFrame(docs, DOCS)).collect()}
    assert (got[0].n_live, got[0].n_copied, got[0].max_owners, got[0].max_repositories) == (0, 2, 1, S.MAX_REPOSITORIES + 1)
    assert got[900].n_live == 2 and got[900].max_repositories == 1


def test_scan_is_native(spark):
    df = spark.createDataFrame([(1, "token = abcdef12", "a")], "doc_id long, text string, source string")
    for out in (S.scan(df), S.redact(df)):
        plan = out._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_runs_take_time_in_proportion(spark):
    text = "eyJ" * 200_000 + " eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
    row = S.scan(spark.createDataFrame([(1, text, "a", "r", 1)], DOCS)).first()
    assert row.spans == f"signed:600001:{len(text)}"


def test_rows_that_are_too_many_to_broadcast(spark, monkeypatch):
    docs = [(i, f"token = {i:02d}a1b2c3d4e5f60718293a4b5c6d7e8f9012345 end", f"o{i}", "r", 1) for i in range(20)] + [(99, None, None, None, None)]
    df = spark.createDataFrame(docs, DOCS)
    few = sorted(map(str, S.redact(df).collect()))
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert sorted(map(str, S.redact(df).collect())) == few and "[secret]" in few[0]
