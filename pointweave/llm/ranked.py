"""Ranked lexical search with range-maximum sparse tables on posting lists.

Documents are cut into shards of bounded size where they are read, each with its posting lists: for a term, the documents
that hold it in the order of their ids, and how often. Shards are independent, so a term in every document is many short
lists, and no list grows with the corpus. A shard and a block of queries meet in one task. There every list gets a sparse
table, which gives the position of the highest impact in any range of documents. The sum of a query's weighted maxima over an
interval of documents bounds each score within it. The search goes best first: the interval with the highest bound is split
at its document of highest single impact, that document is scored in full, and what is left on both sides is bounded again,
until no bound reaches the query's k-th score.

That is done twice. The first round looks at a few intervals of each shard and query; the k-th of its scores over all shards
is a score that k documents reach, so a bar for the second round, in which most shards end at their first bounds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import discard, stored

#: ASCII letters and digits and all characters beyond ASCII make terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SHARD_DOCS = 8192
SHARD_TOKENS = 8_000_000
#: Up to so many different query terms are known to every task, and other terms are not indexed. Beyond it all terms are.
SMALL_VOCABULARY = 200_000
BLOCK_QUERIES = 256
#: Intervals that are split at once, at most, and in the first round altogether.
WIDEST = 256
LOOK = 24
_LONG_TEXT = 4_000_000


def _counts(text: str) -> tuple[Counter, int]:
    raw = text.encode().lower()
    if len(raw) < _LONG_TEXT:
        found = _TERM_BYTES.findall(raw)
        return Counter(found), len(found)
    counts = Counter(m.group() for m in _TERM_BYTES.finditer(raw))
    return counts, counts.total()


class _Shard:
    """Posting lists of some documents while they are gathered."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.tokens = 0
        self.numbers: dict[bytes, int] = {}
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: str, vocabulary: frozenset[bytes] | None) -> None:
        counts, length = _counts(text)
        known = counts.keys() if vocabulary is None else counts.keys() & vocabulary
        number = self.numbers
        self.terms.append(np.fromiter((number.setdefault(t, len(number)) for t in known), np.int64, len(known)))
        self.counts.append(np.fromiter((counts[t] for t in known), np.int64, len(known)))
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.tokens += length

    def batch(self, shard: int) -> pa.RecordBatch:
        """A row without a term for the documents (ids, lengths), and one for each term (places, counts)."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        terms = np.concatenate(self.terms)
        places = place[np.repeat(np.arange(n), [len(t) for t in self.terms])]
        by_term = np.lexsort((places, terms))
        ends = np.concatenate([[0, n], n + np.cumsum(np.bincount(terms, minlength=len(self.numbers)))]).astype(np.int32)
        ids = pa.concat_arrays([pa.array([self.ids[i] for i in order], pa.int64()), pa.array(places[by_term])])
        values = np.concatenate([np.array(self.lengths, np.int64)[order], np.concatenate(self.counts)[by_term]])
        names = pa.array([None, *(t.decode() for t in self.numbers)], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(names), shard)), names, pa.ListArray.from_arrays(pa.array(ends), ids),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["shard", "term", "ids", "values"])


def _indexer(vocabulary, shard_docs: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else vocabulary.value
        first = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                shard.add(doc_id.as_py(), text.as_py() or "", known)
                if len(shard.ids) >= shard_docs or shard.tokens >= shard_tokens:
                    yield shard.batch(first)
                    first, shard = first + 1, _Shard()
        if shard.ids:
            yield shard.batch(first)

    return run


def index(docs: DataFrame, vocabulary=None, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Posting lists ``shard, term, ids, values`` of whole texts; of the broadcast ``vocabulary`` only, if one is given."""
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()),
                           T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.LongType()))])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_indexer(vocabulary, shard_docs, shard_tokens), schema)


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The share of a term's weight that a document gets, for its count and the document's length."""
    if 90 * n_docs * int(lengths.max(initial=0)) < 2**63:
        norm = 10 + 90 * lengths * n_docs // n_terms
    else:
        norm = np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * norm)


class Lists:
    """The posting lists of a shard, one after the other, with their sparse tables."""

    def __init__(self, n_docs: int, places: list[np.ndarray], impact: list[np.ndarray]):
        self.n_docs, self.stride = n_docs, n_docs + 1
        self.place = np.concatenate([*places, [0]]).astype(np.int64)
        #: A place after the end, of no impact, for empty ranges.
        self.impact = np.concatenate([*impact, [0]]).astype(np.int64)
        sizes = [len(p) for p in places]
        self.key = self.place[:-1] + np.repeat(np.arange(len(places)) * self.stride, sizes)
        # Row j: where the highest impact of the 2 ** j entries from here on is, the first of equal ones. Ranges within a
        # list never ask for entries of the next.
        n = len(self.impact)
        self.table = [np.arange(n, dtype=np.int32)]
        while 2 ** len(self.table) <= max(sizes, default=1):
            half, last = 2 ** (len(self.table) - 1), self.table[-1]
            other = last[np.minimum(np.arange(n) + half, n - 1)]
            self.table.append(np.where(self.impact[last] >= self.impact[other], last, other))
        self.table = np.stack(self.table)

    def highest(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of highest impact of each term (columns) in documents low to high (rows); the end if there is none."""
        base = terms * self.stride
        start = np.searchsorted(self.key, base + low[:, None])
        size = np.searchsorted(self.key, base + high[:, None]) - start
        level = np.maximum(0, np.frexp(size.astype(np.float64))[1] - 1)
        left = self.table[level, np.minimum(start, len(self.impact) - 1)]
        right = self.table[level, np.maximum(start + size - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(size > 0, best, len(self.impact) - 1)

    def scores(self, terms: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = terms * self.stride + places[:, None]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.impact[at] * weights, 0).sum(axis=1)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, bar: int = 1, look: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the k best documents that score ``bar`` or more, ties to the lower place.

        With ``look``, only so many documents are looked at, those that best-first search comes to first.
        """
        found, where = np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = np.array([0]), np.array([self.n_docs])
        bound, split = self._bounds(terms, weights, low, high)
        seen, width = 0, 1
        while True:
            alive = bound >= bar
            if len(found) == k:
                alive &= (bound > found[-1]) | (bound == found[-1]) & (low < where[-1])
            low, high, bound, split = low[alive], high[alive], bound[alive], split[alive]
            if not len(bound) or look is not None and seen >= look:
                return found, where
            order = np.lexsort((low, -bound))
            now, later = order[:width], order[width:]
            scored = self.scores(terms, weights, split[now])
            seen += len(now)
            good = scored >= bar
            found, where = np.concatenate([found, scored[good]]), np.concatenate([where, split[now][good]])
            first = np.lexsort((where, -found))[:k]
            found, where = found[first], where[first]
            new_low, new_high = np.concatenate([low[now], split[now] + 1]), np.concatenate([split[now], high[now]])
            some = new_low < new_high
            new_bound, new_split = self._bounds(terms, weights, new_low[some], new_high[some])
            low, high = np.concatenate([low[later], new_low[some]]), np.concatenate([high[later], new_high[some]])
            bound, split = np.concatenate([bound[later], new_bound]), np.concatenate([split[later], new_split])
            width = min(2 * width, WIDEST)

    def _bounds(self, terms: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What no document between low and high can exceed, and the document of the highest single impact there."""
        best = self.highest(terms, low, high)
        parts = self.impact[best] * weights
        top = parts.argmax(axis=1) if len(terms) else np.zeros(len(low), np.int64)
        return parts.sum(axis=1), self.place[np.take_along_axis(best, top[:, None], axis=1)[:, 0]]


def _searcher(k: int, n_docs: int, n_terms: int, look: int | None):
    names = ["query", "item_id", "doc_id", "score"]

    def run(rows: pa.Table) -> pa.Table:
        terms = rows.column("term").to_pylist()
        whole = terms.index(None)
        ids = rows.column("ids")[whole].values
        lengths = rows.column("values")[whole].values.to_numpy()
        places, impact = [], []
        asked: dict[tuple, list[tuple[int, int]]] = {}
        for i, term in enumerate(terms):
            if term is None:
                continue
            at = rows.column("ids")[i].values.to_numpy()
            for a in rows.column("askers")[i].as_py():
                asked.setdefault((a["query"], a["item_id"], a["bar"]), []).append((len(places), a["weight"]))
            places.append(at)
            impact.append(impacts(rows.column("values")[i].values.to_numpy(), lengths[at], n_docs, n_terms))
        lists = Lists(len(lengths), places, impact)
        out: list[tuple] = []
        for (query, item, bar), parts in asked.items():
            numbers, weights = np.array(parts, np.int64).T
            found, where = lists.best(numbers, weights, k, bar, look)
            out += zip([query] * len(found), [item] * len(found), ids.take(pa.array(where)).to_pylist(), found.tolist())
        return pa.table([pa.array([r[c] for r in out], pa.string() if c == 0 else pa.int64()) for c in range(4)], names)

    return run


def search(items: DataFrame, docs: DataFrame, k: int = 10, small_vocabulary: int = SMALL_VOCABULARY, shard_docs: int = SHARD_DOCS,
           block_queries: int = BLOCK_QUERIES, look: int = LOOK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item, ties to the smaller id.

    ``items`` and ``docs`` have ``item_id`` or ``doc_id`` and ``text``; texts are taken whole. Terms are runs of ASCII letters
    and digits and characters beyond ASCII, A-Z in lower case. Scores are whole numbers as ``impacts`` and the weights
    here state them. Null texts have no terms: such documents are found by none, such items find none. Every row is a
    document or an item of its own, also if it repeats another or its id; null ids are kept and come last among equal
    scores. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    # An item's own key is its id and text, so that equal rows are searched for once.
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    queries = items.select(F.col("item_id").cast("bigint").alias("item_id"), text.alias("text")).groupBy("item_id", "text").agg(
        F.count("*").alias("copies")).select(
        F.sha2(F.concat_ws(" ", F.col("item_id").isNull().cast("string"), F.col("item_id").cast("string"), "text"), 256).alias("query"),
        "item_id", "copies", F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("terms"))
    queries = stored(queries)
    asked = queries.select("query", "item_id", F.explode("terms").alias("term"))
    terms = asked.select("term").distinct()
    known = [r.term for r in terms.limit(small_vocabulary + 1).collect()]
    small = len(known) <= small_vocabulary
    vocabulary = spark.sparkContext.broadcast(frozenset(t.encode() for t in known)) if small else None
    lists = stored(index(docs, vocabulary, shard_docs))
    n_docs, n_terms = lists.filter("term is null").select(
        F.aggregate("values", F.lit(0).cast("bigint"), lambda s, n: s + F.when(n > 0, 1).otherwise(0)).alias("n"),
        F.aggregate("values", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("l")).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    postings = lists.filter("term is not null")
    if not small:
        postings = postings.join(terms, "term", "left_semi")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("bigint")
    blocks = max(1, -(-queries.count() // block_queries))
    weights = stored(asked.join(postings.groupBy("term").agg(F.sum(F.size("ids")).alias("df")), "term").select(
        "query", "item_id", "term", weight.alias("weight"), F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).filter("weight > 0"))
    everywhere = lists.filter("term is null").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), "term", "ids", "values")
    schema = T.StructType([T.StructField("query", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("item_id", "doc_id", "score"))])
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def searched(bars: DataFrame, look: int | None) -> DataFrame:
        askers = bars.groupBy("block", "term").agg(F.collect_list(F.struct("query", "item_id", "weight", "bar")).alias("askers"))
        met = postings.join(askers, "term").unionByName(everywhere, allowMissingColumns=True)
        found = met.groupBy("shard", "block").applyInArrow(_searcher(k, n_docs, n_terms, look), schema)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    first = searched(weights.withColumn("bar", F.lit(1).cast("bigint")), look)
    reached = first.filter(F.col("rank") == k).select("query", F.col("score").alias("reached"))
    bars = weights.join(stored(reached), "query", "left").withColumn("bar", F.coalesce("reached", F.lit(1).cast("bigint")))
    result = stored(searched(bars, None))
    discard(lists, weights)
    return result.join(queries.select("query", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))), "query").select(
        "item_id", "rank", "doc_id", "score")
