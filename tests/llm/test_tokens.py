import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from tessera.llm import packing, token_output
from tessera.llm.tokens import Encoder, tokenizer_path


def library(path):
    """The tokenizers library, set as the vocabularies' description shows; nothing of this repository."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "\n", "a\n\nb", "  x  y", "tab\tz \n q", "é́  x, y", "foo |bar| \n| x", "don't  WE'LL 12 3", "A\r\nB", "x  y", "İΣ ΑΣ.", "<|endoftext|> a", "x " * 5000, None]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("start", T.StringType()), T.StructField("h", T.StringType())])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_library_ids(name):
    enc, plain = Encoder(tokenizer_path(name)), library(tokenizer_path(name))
    rng = random.Random(3)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", ",", ".", "'s", "12", "|", "ß", "中", "　", "\x1c"]
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(1500)]
    for text, ids in zip(texts, enc.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 31, 32])
def test_bit_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = token_output.write_segment([(5, ids[:400]), (None, ids[400:400]), (9, ids[400:])], bits, block=64)
    assert (token_output.read_ids(data) == ids).all()
    for a, b in ((0, 1), (63, 65), (100, 900), (1002, 1003), (5, 5)):
        assert (token_output.read_ids(data, a, b) == ids[a:b]).all()
    index, _ = token_output.read_index(data)
    assert index["end"].tolist() == [400, 400, 1003] and index["null"].tolist() == [0, 1, 0]


def rows():
    out = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "again", None, None), (3, "again", None, None), (None, "no id", None, None)]
    random.Random(1).shuffle(out)
    return out


def test_packed_documents_come_back(spark):
    path, docs = tokenizer_path("byte_bpe_50k.json"), rows()
    got = token_output.packed_documents(spark.createDataFrame(docs, DOCS), path, 2).collect()
    plain = library(path)
    want, start = [], 0
    crc = lambda t: plain(t or "") + [2]
    assert len(got) == len(docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d if d is not None else -1, len(a := crc(t)), zlib.crc32(np.array(a, "<u4").tobytes())) for d, t, _, _ in docs)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        want.append(r.doc_id)
    assert want == sorted(want, key=lambda x: (x is not None, x or 0))
    assert token_output.packed_documents(spark.createDataFrame([], DOCS), path, 2).count() == 0


def check_pieces(got, docs, path, end_id, tokens, segments):
    plain = library(path)
    ids = {d: np.array(plain(t or "") + [end_id], "<u4") for d, t in docs}
    seen, bins = {d: [] for d in ids}, {}
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.length == len(piece) > 0
        seen[r.doc_id].append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    for parts in bins.values():
        at = 0
        assert len(parts) <= segments
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= tokens
    return sum(map(len, ids.values())) / (len(bins) * tokens)


def test_packing_places_each_id_once_with_little_padding(spark):
    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(5)
    docs = [(i, None if i == 7 else " ".join(rng.choices(["alpha", "beta", "gamma,", "of"], k=rng.choice([0, 1, 30, 300, 5000])))) for i in range(120)]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], DOCS).coalesce(1)
    got = packing.pack_documents(df, path, 1).collect()
    assert check_pieces(got, docs, path, 1, 2048, 2048) > 0.97
    assert packing.pack_documents(df.limit(0), path, 1).count() == 0


def test_packing_keeps_all_limits():
    rng = random.Random(2)
    rows = []
    for i in range(400):
        n = rng.randint(1, 90)
        rows.append((i, np.arange(n, dtype="<u4"), np.array([rng.random() < 0.5 for _ in range(n)])))
    tokens, segments, loss = 64, 4, 24
    bins, covered = {}, {i: 0 for i, _, _ in rows}
    for doc, start, n, _, _, seq, at, bearing in packing.pack_rows(iter(rows), tokens, segments, loss, 0):
        assert bearing == int(rows[doc][2][start : start + n].sum())
        b = bins.setdefault(seq, [0, 0, 0])
        assert at == b[0]
        bins[seq] = [b[0] + n, b[1] + 1, b[2] + bearing]
        covered[doc] += n
    assert all(b[0] <= tokens and b[1] <= segments and b[2] <= loss for b in bins.values())
    assert covered == {i: len(a) for i, a, _ in rows}


@pytest.mark.parametrize("sizes", [[1], [3], [5], list(range(2, 10)) * 40 + [600]])
def test_short_documents_fill_sequences(sizes):
    rows = [(i, np.arange(sizes[i % len(sizes)], dtype="<u4"), None) for i in range(20_000)]
    bins = {}
    for _, _, n, _, _, seq, _, _ in packing.pack_rows(iter(rows), 2048, 2048, 2048, 0):
        bins[seq] = bins.get(seq, 0) + n
    full = [bins[s] for s in sorted(bins)][:-1]  # the last one has what is left
    assert sum(bins.values()) == sum(len(a) for _, a, _ in rows) and sum(full) > 0.98 * 2048 * len(full) > 0


def test_very_long_document(spark):
    path, text = tokenizer_path("word_bpe_49k.json"), " ".join(f"w{i % 977} q" for i in range(150_000))
    got = packing.pack_documents(spark.createDataFrame([(1, text, "", "")], DOCS), path, 1).collect()
    assert check_pieces(got, [(1, text)], path, 1, 2048, 2048) > 0.99


@pytest.mark.parametrize("parts", ["1", "5"])
def test_conversations_stay_whole(spark, parts):
    path = tokenizer_path("word_bpe_49k.json")
    plain, rng = library(path), random.Random(9)
    turns = [(c, k, rng.choice(["user", "assistant", None]), " ".join(rng.choices(["yes", "no", "maybe,"], k=rng.choice([0, 3, 40, 900])))) for c in range(8) for k in range(rng.randint(1, 9))]
    turns += [(50, k, "assistant", f"turn {k} of a long one " * 30) for k in range(200)] + [(None, 0, None, None), (60, 0, "assistant", "twice"), (60, 0, "assistant", "twice")]
    rng.shuffle(turns)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = packing.pack_conversations(spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, shard string, start long"), path, 1).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, bears = {}, {}
    for c, k, role, text in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1])):
        ids = plain(text or "") + [1]
        want.setdefault(c, []).extend(ids)
        bears.setdefault(c, []).extend([role == "assistant"] * len(ids))
    seen, bins = {c: 0 for c in want}, {}
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        a, b = r.start, r.start + r.length
        assert a == seen[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][a:b], "<u4").tobytes()) and r.loss_tokens == sum(bears[r.doc_id][a:b])
        seen[r.doc_id] = b
        bins.setdefault(r.sequence_id, []).append((r.length, r.loss_tokens))
    assert seen == {c: len(x) for c, x in want.items()}
    assert all(sum(n for n, _ in b) <= 2048 and sum(m for _, m in b) <= 1536 and len(b) <= 16 for b in bins.values())
    assert packing.pack_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), path, 1).count() == 0


def test_a_range_is_read_without_the_rest(spark, tmp_path):
    path, folder = tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "packed")
    docs = [(i, f"document {i} " * (i % 7 + 1)) for i in range(300)]
    token_output.write_packed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), folder, path, 2, segment_ids=64)
    plain = library(path)
    every = [x for _, t in docs for x in plain(t) + [2]]
    for a, b in ((0, 10), (100, 900), (len(every) - 5, len(every) + 50), (777, 778)):
        df = token_output.read_range(spark, folder, a, b)
        got = sorted((r["at"], np.frombuffer(r["ids"], "<u4").tolist()) for r in df.collect())
        assert [x for _, ids in got for x in ids] == every[a:b] and got[0][0] == a
        assert "ids_before" in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]
    assert len(got) == 1  # of over a hundred segments
