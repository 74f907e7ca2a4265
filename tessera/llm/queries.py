"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, hard_negatives, html_text, licences, near_dedup, neighbours, packing, secrets, simhash, source_divergence, suffix_dedup, token_output, toxicity
from .tokens import tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).drop("begins", "ends")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruction-data form of op5."""
    return packing.pack_conversations(table(spark, sf_dir, "conversations"), tokenizer_path("word_bpe_49k.json"), 1)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_suffix_dedup, op3_decontamination, op4_toxicity, op5_packing, op6_licences, op7_token_output, op8_secrets, op9_neighbours, op10_near_dedup, op11_source_divergence, op12_hard_negatives, op13_simhash, pack_conversations)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS3 = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS3} AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, w FROM (SELECT item_id, {_WORDS3} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw)),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))),
hits AS (SELECT doc_id, i, n, item FROM pos JOIN win USING (n, g)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _kind_sql(number: int) -> str:
    name, pattern, group, least = secrets.KINDS[number]
    begin = "s"
    if name == "signed":  # no look-behind here: the character before belongs to the match, and the span begins behind it
        pattern, group, begin = "(?:^|[^A-Za-z0-9_-])(" + pattern.replace("(?<![A-Za-z0-9_-])", "").replace("}+", "}") + ")", 1, "s + length(m) - length(v)"
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {number} AS kind, '{name}' AS name, m AS whole, v AS val, {begin} AS start, s + length(m) AS stop FROM (
        SELECT doc_id, source, m[i] AS m, v[i] AS v, list_sum([length(x) FOR x IN b[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS s
        FROM (SELECT doc_id, source, m, v, b, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, source, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v, string_split_regex(text, '{p}') AS b
            FROM documents WHERE text IS NOT NULL)))
        WHERE length(v) >= {least}"""


OP8_SQL = f"""
WITH cand AS ({" UNION ALL ".join(_kind_sql(k) for k in range(len(secrets.KINDS)))}),
own AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (coalesce(source, chr(0)), coalesce(CAST(doc_id AS VARCHAR), chr(0)))) AS repositories FROM cand GROUP BY val),
kept AS (SELECT doc_id, kind, name, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, owners, repositories,
                owners > {secrets.MAX_OWNERS} OR repositories > {secrets.MAX_REPOSITORIES} AS copied,
                owners <= {secrets.MAX_OWNERS} AND repositories <= {secrets.MAX_REPOSITORIES} AND len(list_distinct(string_split(val, ''))) >= {secrets.MIN_CHARACTERS} AS live
         FROM cand JOIN own USING (val)),
agg AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
               string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {len(secrets.BASE)}) AS base,
               string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied, max(owners) AS o, max(repositories) AS r
        FROM kept WHERE kind < {len(secrets.BASE)} OR live GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(o, 0) AS max_owners, coalesce(r, 0) AS max_repositories
FROM documents LEFT JOIN agg USING (doc_id)
"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * suffix_dedup.LENGTH})) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {suffix_dedup.LENGTH - 1})) AS i FROM d)),
twice AS (SELECT g FROM w GROUP BY g HAVING count(*) > 1),
starts AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix_dedup.LENGTH}, true) AS fresh FROM w SEMI JOIN twice USING (g)),
spans AS (SELECT doc_id, min(i) AS b, max(i) + {suffix_dedup.LENGTH} AS e FROM (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM starts) GROUP BY doc_id, grp),
ordered AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS f FROM spans),
cut AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (b - f) AS BIGINT)), '' ORDER BY b) || substr(any_value(h), CAST(2 * max(e) + 1 AS BIGINT)) AS kept FROM ordered JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM c JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT i AS a, j AS b FROM l UNION SELECT j, i FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node WHERE r.label < e.b),
m AS (SELECT node AS doc_id, min(label) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


OP11_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {source_divergence.LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (gn.n + 5 * v.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v)::HUGEINT AS q
      FROM gn JOIN k ON gn.lang = k.lang JOIN v ON v.lang = k.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {source_divergence.RANKS}
"""

OP12_SQL = """
WITH r AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.id AS anchor_id, a.label AS own, c.id, c.label, CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
      FROM r a JOIN r c ON a.id <> c.id WHERE a.id % 100 = 0),
pos AS (SELECT r, anchor_id, own, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS place FROM s WHERE label = own QUALIFY place <= 5)
SELECT pos.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY pos.r, place ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s ON s.r = pos.r AND s.label <> pos.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op2_suffix_dedup": OP2_SQL, "op10_near_dedup": OP10_SQL, "op3_decontamination": OP3_SQL, "op6_licences": licences.oracle_sql(), "op8_secrets": OP8_SQL}
