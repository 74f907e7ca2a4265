import random

import corpus_pipeline
from tessera.llm import stages

from .test_near_dedup import brute as near_brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(folder, spark):
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeioumnrst", k=rng.randint(3, 8))) for _ in range(400)]
    item = " ".join(f"bench{i}" for i in range(20))
    docs, labels, kinds = [], [], {}
    for i in range(400):
        text = " ".join(rng.choices(plain, k=rng.randint(30, 120)))
        kind = ["plain", "toxic", "copy", "near", "bench", "secret"][i % 6]
        if kind == "toxic":
            text += " wretchling zounderkin zounderkin"
        elif kind == "copy":
            text = docs[i - 2][1]
        elif kind == "near":
            text = docs[i - 3][1] + " more"
        elif kind == "bench":
            text = text[:200] + " " + item
        elif kind == "secret":
            text += f" token = \"{rng.getrandbits(160):040x}\""
        docs.append((i, text, "en", f"src{i % 5}", len(text)))
        kinds[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    docs += [(900, None, None, None, None), (901, "", "en", "src1", 0)]
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return docs, kinds


def test_each_decision_takes_effect(spark, tmp_path):
    docs, kinds = corpus(str(tmp_path), spark)
    sf_dir = str(tmp_path)
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "decontamination", "secrets", "packing"]
    clean = stages.drop_toxic(spark, read, sf_dir)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert clean.columns == read.columns and ids(clean) == {d for d, *_ in docs if kinds.get(d) != "toxic"}
    one = stages.drop_near_duplicates(spark, clean, sf_dir)
    rest = [d for d in docs if kinds.get(d[0]) != "toxic"]
    want = {int(x.strip("()").split(", ")[0]) for x in near_brute(rest) if x.strip("()").split(", ")[3] == "True" or x.strip("()").split(", ")[1] == "0"}
    assert one.columns == read.columns and ids(one) == want
    apart = stages.drop_contaminated(spark, one, sf_dir)
    assert apart.columns == read.columns and ids(apart) == {d for d in want if kinds.get(d) != "bench"}
    masked = stages.mask_secrets(spark, apart, sf_dir)
    assert masked.columns == read.columns and ids(masked) == ids(apart)
    before = {d[0]: d for d in docs}
    for r in masked.collect():
        if kinds.get(r.doc_id) == "secret":
            assert r.text.endswith(' [secret]"') and r.n_chars == len(r.text)
        else:
            assert tuple(r) == before[r.doc_id]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert ids(packed) == ids(masked)


def test_empty_documents(spark, tmp_path):
    corpus(str(tmp_path), spark)
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_extra_and_missing_columns_and_odd_rows(spark, tmp_path):
    docs, _ = corpus(str(tmp_path), spark)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id < 40 OR doc_id >= 900")
    odd = read.drop("n_chars", "source").selectExpr("*", "'r' AS rid", "1 AS spans", "'x' AS doc", "2.0 AS score", "3 AS label", "'s' AS starts")
    odd = odd.union(odd.limit(2)).unionByName(odd.limit(1).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a long text of no one' AS text", "lang", "rid", "spans", "doc", "score", "label", "starts"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, stage
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert 900 in ids and 901 in ids and None in ids, stage
