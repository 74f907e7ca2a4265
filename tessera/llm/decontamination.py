"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The automaton of all items (words as symbols; no match runs from one item into the next) is built on
the driver from a block of at most ``BLOCK_WORDS`` words, broadcast, and each document's words are
streamed through it: after each word it knows the longest suffix read that some item contains. Where
that is at least a window long, the words of the match are hit. Documents aren't shuffled. Benchmarks of more words take several
blocks, a pass over the texts each; their matches are kept by row number and put beside the documents at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import dealt, text_of, written

WINDOW = 13
#: Words of items in one automaton; it takes about 400 bytes a word in the driver and each worker.
BLOCK_WORDS = 100_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MATCHES = "n_words long, starts array<long>, ends array<long>, items array<string>"


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z in lower case."""
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        texts = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]) for name, text in items]
        texts = [(name, t) for name, t in texts if t]
        self.shortest = min((min(window, len(t)) for _, t in texts), default=0)
        for _, t in texts:
            state = 0
            for c in t:
                state = self._extend(state, c)
        #: state of a window's words -> items that contain them; state of a short item's words -> (its length, item)
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, t in texts:
            state = 0
            for i, c in enumerate(t):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.windows.setdefault(self._at(state, window), set()).add(name)
            if len(t) < window:
                self.short.setdefault(state, []).append((len(t), name))
        #: the nearest state on the way of suffix links, itself included, that ends a short item
        self.near = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__) if self.short else ():
            self.near[s] = s if s in self.short else self.near[self.link[s]] if s else -1

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _at(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (start, end) hit, joined where they meet, and the items of which a window occurs."""
        if not self.shortest or len(text) < self.shortest:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, text, repeat(-1)), dtype=np.int64, count=len(text))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]])))
        runs = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= self.shortest]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        moves, link, length, window = self.next, self.link, self.length, self.window
        for a, b in runs:  # a word that no item has ends every match
            state = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while state and c not in moves[state]:
                    state = link[state]
                    n = length[state]
                state = moves[state].get(c, 0)
                n = n + 1 if state else 0
                start = i + 1
                if n >= window:
                    items |= self.windows[self._at(state, window)]
                    start = i + 1 - n
                short = self.near[state]
                while short > 0:
                    for m, name in self.short[short]:
                        if m <= n:
                            items.add(name)
                            start = min(start, i + 1 - m)
                    short = self.near[link[short]]
                if start <= i:
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


def blocks_of(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items (item_id as string, UTF-8 text) in blocks of about limit words; no item is left out."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_of().alias("text"))
    between = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    count = items.select(F.sum(F.size(F.split("text", between))).alias("n")).first().n or 0
    blocks = max(1, -(-count // limit))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for k in range(blocks):
        yield [(r["item"], r["text"].encode()) for r in dealt.filter(F.col("block") == k).collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, and starts, ends (spans of words hit) and items (ids, sorted as strings).

    Columns of docs stay, but for clashes with these four names, which are replaced. Null text has no
    words; an item without words hits nothing; a null item_id counts as the id ""; repeated rows are each matched; empty
    tables give empty results; a text of any length is read whole, word by word.
    """
    docs = dealt(docs.drop("n_words", "starts", "ends", "items"))
    kinds = _parse_datatype_string(MATCHES).fields
    blocks = blocks_of(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:  # matches stand beside the documents, which nothing moves
        return docs.mapInArrow(_matcher(first, window, docs.sparkSession, docs.columns.index("text"), len(docs.columns)), StructType(docs.schema.fields + kinds))
    # more blocks: a pass each over numbered texts, of which only matches are written; then they are put together by number
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "numbered")
    texts = rows.select("row", F.col("doc.text").alias("text"))
    passes = []
    for k, items in enumerate(chain([first, second], blocks)):
        found = texts.mapInArrow(_matcher(items, window, docs.sparkSession, 1, 2), StructType([*texts.schema.fields, *kinds])).drop("text")
        passes.append(written(found if k == 0 else found.filter(F.size("items") > 0), "matches"))
    span = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    both = reduce(DataFrame.union, passes).groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_sort(span).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    both = both.select("row", "n_words", _joined_spans(F.col("spans")).alias("spans"), "items")
    whole = rows.join(both, "row").select("doc.*", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")
    return whole


def _matcher(items: list[tuple[str, bytes]], window: int, spark: SparkSession, at: int, n: int):
    """A function of Arrow batches: their first n columns, then the matches of the text in column at with the items."""
    shared = spark.sparkContext.broadcast(Automaton(items, window))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            counts, starts, ends, found = [], [], [], []
            for text in batch.column(at).cast(_binary(batch.column(at).type)).to_pylist():
                w = words(text or b"")
                spans, hit = automaton.match(w)
                counts.append(len(w))
                starts.append([a for a, _ in spans])
                ends.append([b for _, b in spans])
                found.append(sorted(hit))
            columns = [pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:n] + columns, [*batch.schema.names[:n], "n_words", "starts", "ends", "items"])

    return matched


def _joined_spans(spans: Column) -> Column:
    """Sorted spans (starts, ends) as one array, those that meet as one."""

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], s["ends"]).alias("ends"))
        apart = (F.size(done) == 0) | (s["starts"] > last["ends"])
        return F.when(apart, F.concat(done, F.array(s))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))

    return F.aggregate(spans, F.array().cast("array<struct<starts:bigint,ends:bigint>>"), add)


def _binary(kind: pa.DataType) -> pa.DataType:
    return pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of its words hit, or more)."""
    m = find_matches(docs.select("doc_id", "text"), benchmark, window, block_words)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans, and without what stands between the words of one span."""
    data = text.encode()
    plain = data.translate(_TABLE)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.frombuffer(plain, np.uint8) != 32).astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : int(starts[a])])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.05, span_words: int | None = None, window: int = WINDOW) -> DataFrame:
    """docs without those of which the hit words reach ``coverage`` of all; in the others, spans of more
    than ``span_words`` words (None: no limit) are cut out of the text. The columns of docs."""
    m = find_matches(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text"), benchmark, window)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    kept = m.filter(~((hit > 0) & (hit >= F.lit(coverage) * F.col("n_words"))))
    if span_words is None:
        return kept.select("doc.*")
    long = F.filter(F.arrays_zip("starts", "ends"), lambda s: s["ends"] - s["starts"] > span_words)

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: cut_words(t, [(x["starts"], x["ends"]) for x in s]) if len(s) else t)

    text = F.when(F.size(long) > 0, cut(text_of(), long)).otherwise(F.col("text"))
    return kept.withColumn("doc", F.col("doc").withField("text", text)).select("doc.*")
