"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

One pass over the texts finds candidate spans and keeps their place and the hash of their value. The
hashes are aggregated over the corpus by distinct repositories and owners: a value that many owners have,
or many repositories of whatever owners, is a widely copied example; others are owner-specific. A candidate is
*live-looking* if it is owner-specific and its characters are varied enough.

Spans of the base kinds (assign, access, hex) are always reported. The method adds spans of the kinds
in ``ADDED`` where their value is live-looking. Place and counts are in code points.

Null text is empty; a null owner or repository counts as one of its own; repeated rows are each
reported (and are one repository if they share its id); an empty table gives no rows; other columns
are ignored. A text of any length is scanned whole; its matches are placed by running sums, in time proportional to their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: The patterns of the base kinds (a value's own group, if it isn't the whole match).
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Kinds the method adds: tokens of hosting and chat services, signed web tokens, private keys.
ADDED = [
    ("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 25),
    # from the beginning of a run only, and without going back in it: else a long run of eyJ takes quadratic time
    ("signed", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30),
    ("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", 0, 60),
]
KINDS = BASE + ADDED
#: What any text with a candidate contains; looked for first.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|gh[pousr]_|xox[abprs]-|eyJ|-----BEGIN"""
#: A value that more owners or more repositories have is a widely copied example; a live-looking value has so many different characters.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
MIN_CHARACTERS = 8
#: Parts into which the rows of one value are dealt for the join with its verdict.
SALTS = 16
#: Documents with live-looking spans whose spans are broadcast to mask them, at most; more take a shuffle.
BROADCAST_ROWS = 200_000

MATCH = "struct<kind:int,gap:int,size:int,value:bigint,varied:boolean,enough:boolean>"


def _found(text: Column, number: int) -> Column:
    """Matches of a kind in order, each with the length of the gap before it (what stands between matches)."""
    _, pattern, group, least = KINDS[number]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(between, 1, F.size(matches)), F.length).alias("gap"), F.transform(matches, F.length).alias("size"), values.alias("value"))

    def match(x: Column) -> Column:
        varied = F.size(F.array_distinct(F.split(x["value"], ""))) >= MIN_CHARACTERS
        return F.struct(F.lit(number).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), F.xxhash64(x["value"]).alias("value"), varied.alias("varied"), (F.length(x["value"]) >= least).alias("enough"))

    return F.transform(pairs, match)


def candidates(docs: DataFrame, owner: str, repository: str, id_col: str = "doc_id") -> DataFrame:
    """row (a number of the row), doc_id, owner, repository, matches: one row for each of docs, written to the shared folder."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("\0")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("\0")).alias("repository"), text_of().alias("text"))
    none = F.array().cast(f"array<{MATCH}>")
    found = F.when(F.col("text").rlike(_ANY), F.concat(*(_found(F.col("text"), k) for k in range(len(KINDS))))).otherwise(none)
    return written(named.select("row", "doc_id", "owner", "repository", found.alias("matches")), "candidates")


def placed(found: DataFrame) -> DataFrame:
    """row, owner, repository, start, kind, end, value, varied: the matches that are long enough, with their places (running sums)."""
    each = found.filter(F.size("matches") > 0).select("row", "owner", "repository", F.posexplode("matches").alias("i", "m")).select("row", "owner", "repository", "i", "m.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.withColumn("end", end).filter("enough")
    return written(spans.select("row", "owner", "repository", (F.col("end") - F.col("size")).alias("start"), "kind", "end", "value", "varied"), "spans")


def ownership(spans: DataFrame) -> DataFrame:
    """Per value: owners and repositories, distinct ones over the corpus."""
    each = spans.select("value", "owner", "repository").distinct().groupBy("value", "owner").agg(F.count("*").alias("n"))
    return each.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def judged(found: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """row, doc_id of found, and the spans that are reported, with their verdicts as fields owners, repositories, copied and live."""
    spans = placed(found)
    salts = F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("salt")
    verdicts = ownership(spans).select("*", salts)
    some = spans.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    live = ~copied & F.col("varied")
    rows = some.join(verdicts, ["value", "salt"]).filter((F.col("kind") < len(BASE)) | live)
    span = F.struct("start", "kind", "end", live.alias("live"), copied.alias("copied"), "owners", "repositories")
    by_row = rows.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    with_spans = found.filter(F.size("matches") > 0).select("row", "doc_id").join(by_row, "row", "left")
    empty = found.filter(F.size("matches") == 0).select("row", "doc_id", F.lit(None).alias("spans"))
    return with_spans.unionByName(empty)


def _text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (live-looking spans), n_copied (spans whose
    value is a widely copied example), and the most owners and repositories that any of its spans' values has (0 without spans)."""
    rows = judged(candidates(docs, owner, repository))
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,copied:boolean,owners:bigint,repositories:bigint>>"))
    rows = rows.select("doc_id", spans.alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("s", lambda x: x["kind"] < len(BASE))
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text_of(base).cast("binary"), 256).alias("base_sha256"), _text_of(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("s", lambda x: x["copied"])).cast("long").alias("n_copied"),
        *(F.coalesce(F.array_max(F.col("s").getField(k)), F.lit(0).cast("long")).alias(f"max_{k}") for k in ("owners", "repositories")),
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mask: str = "[secret]") -> DataFrame:
    """docs with live-looking spans replaced by mask in their text; widely copied examples stay. The columns of docs.

    Spans that overlap are replaced as one. Only documents with candidates take part in the join.
    """
    packed = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    numbered = written(packed, "numbered")
    found = candidates(numbered.select(F.col("_row").alias("_id"), F.col(f"doc.{owner}").alias("o"), F.col(f"doc.{repository}").alias("r"), F.col("doc.text").alias("text")), "o", "r", "_id")
    each = judged(found).select(F.col("doc_id").alias("_row"), F.explode("spans").alias("s")).filter("s.live").select("_row", "s.start", "s.end")
    earlier = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    pieces = F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("before"), F.struct("start", "before"))))
    live = written(each.groupBy("_row").agg(pieces.alias("_pieces"), F.max("end").alias("_last")), "live")
    live = F.broadcast(live) if live.count() <= BROADCAST_ROWS else live
    # what stands before each span (from the end of those before it) and the mask, then what stands after the last
    text = F.col("doc.text")
    parts = F.transform("_pieces", lambda p: F.concat(text.substr(p["before"] + 1, p["start"] - p["before"]), F.lit(mask)))
    text = F.when(F.col("_pieces").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), text.substr(F.col("_last") + 1, F.length(text))))
    return numbered.join(live, "_row", "left").select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
