"""Ranked lexical search: best-first search of document intervals, bounded by range maxima of posting lists.

`index` makes one pass over the documents and writes posting lists of every term, by blocks of at most BLOCK_BYTES
of text, so that every list, every group and every task is bounded whatever the data. `search` sums the corpus
figures (documents, terms, documents per query term) with map-side sums, shuffles only the lists of query terms by
block and searches each block for all queries at once:

- each posting has an impact, the exact part of the score its term adds to its document;
- a sparse table holds the position of the largest impact of every run of 2^k postings of a list, so the largest
  impact of a term in any interval of documents takes two look-ups;
- an interval is bounded by the sum of these maxima; the best intervals are taken first and split at the document
  that has the largest single impact in them, which is scored exactly; lists without a posting in a part are
  dropped from it;
- intervals that cannot reach the k-th score found so far are dropped, ties are kept.

Each step takes the BATCH best intervals of every query together, so that the work runs in whole arrays. The
result is exact. The k best of every block are ranked in two steps, so no task sees more than k rows of each
block of its share.

Defined cases: null texts and texts without terms are no documents of the collection and are never found; items
without terms find nothing; items with equal ids are queries of their own, like rows with equal doc_id; equal
scores are ordered by doc_id (nulls last), then by place in the index; empty tables give no rows. Only the columns
named are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import fresh_path

BEST = 50
BLOCK_BYTES = 16_000_000  # text of a block; a longer document is a block of its own
BLOCK_ROWS = 200_000
BATCH = 64  # intervals of a query taken at once
QUERY_BYTES = 4_000_000  # item text that one search takes; more items are searched in turns
SALTS = 64  # shares of the first ranking step
LENGTHS = b""  # the term of a block's list of documents
# Constants of the score.
SCALE, SLOPE, BASE = 1_000_000_000, 50, 50
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "block long, term binary, docs array<long>, at array<int>, tf array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all that is not ASCII, only A-Z lower-cased."""
    return text.translate(TABLE).split()


class _Block:
    """Postings of the documents taken so far."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.term, self.tf, self.distinct, self.docs, self.size, self.bytes = [], [], [], [], [], 0

    def add(self, doc: int | None, text: bytes) -> None:
        words = terms_of(text)
        if not words:
            return
        counted = Counter(words)
        self.term.extend(map(self.numbers.__getitem__, counted))
        self.tf.extend(counted.values())
        self.distinct.append(len(counted))
        self.docs.append(doc)
        self.size.append(len(words))
        self.bytes += len(text)

    def batch(self, block: int) -> pa.RecordBatch:
        term, tf = np.array(self.term, np.int32), np.array(self.tf, np.int32)
        at = np.repeat(np.arange(len(self.docs), dtype=np.int32), self.distinct)
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(self.numbers)))
        n, k = len(self.docs), len(self.numbers) + 1
        split = lambda first, rest: pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0, n], n + ends]).astype(np.int32)), pa.array(np.concatenate([first, rest]).astype(np.int32)))
        own = pa.ListArray.from_arrays(pa.array([0] + [n] * k, pa.int32()), pa.array(self.docs, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, block)), pa.array([LENGTHS, *self.numbers], pa.binary()), own, split(np.arange(n), at[order]), split(self.size, tf[order])],
            names=["block", "term", "docs", "at", "tf"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    block = _Block()
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if block.docs and (block.bytes + len(text) > BLOCK_BYTES or len(block.docs) == BLOCK_ROWS):
                yield block.batch(number)
                block, number = _Block(), number + 1
            block.add(doc, text)
    if block.docs:
        yield block.batch(number)


def index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Posting lists of every term and block, written to `path` or a fresh folder of the shared folder.

    `at` are ascending places of documents in their block; the row with the empty term lists the block's documents,
    their places and numbers of terms.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    path = path or fresh_path(docs.sparkSession, "postings")
    rows.mapInArrow(_posted, INDEX).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


class Queries:
    """Terms of the items of one turn, flat: terms of item i are term[start[i]:start[i + 1]]."""

    def __init__(self, items: list[tuple[int | None, str]], held: dict[bytes, int], documents: int, terms: int):
        self.ids = [i for i, _ in items]
        found = [[t for t in dict.fromkeys(terms_of((text or "").encode())) if t in held] for _, text in items]
        self.names = {t: k for k, t in enumerate(dict.fromkeys(t for row in found for t in row))}
        self.term = np.array([self.names[t] for row in found for t in row], np.int64)
        self.start = np.append(0, np.cumsum([len(row) for row in found])).astype(np.int64)
        df = np.array([held[t] for t in self.names], np.float64)
        self.weight = np.floor(1000 * np.log((2.0 * documents + 2) / (2 * df + 1))).astype(np.int64)
        self.documents, self.terms = documents, max(terms, 1)


class Ranges:
    """Impacts of a block's posting lists, end to end, with sparse tables of the places of their maxima."""

    def __init__(self, impact: np.ndarray, key: np.ndarray, width: int, longest: int):
        self.impact, self.key, self.width = impact, key, width
        level = np.arange(len(impact), dtype=np.int32)
        self.levels, step = [level], 1
        while 2 * step <= longest:  # runs over the end of a list are never asked for
            left, right = level[:-step], level[step:]
            level = np.where(impact[left] >= impact[right], left, right)
            self.levels.append(level)
            step *= 2
        self.offset = np.cumsum([0, *map(len, self.levels)])[:-1]
        self.flat = np.concatenate(self.levels)

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the largest impact of each run of postings from a up to b, which is not empty."""
        size = b - a
        k = np.frexp(size.astype(np.float64))[1] - 1
        left, right = self.flat[self.offset[k] + a], self.flat[self.offset[k] + b - (np.int64(1) << k)]
        return np.where(self.impact[left] >= self.impact[right], left, right)


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of runs of `values` that begin at `start`; no run is empty."""
    return np.add.reduceat(values, start) if len(start) else np.zeros(0, np.int64)


class _Frontier:
    """Open intervals: a query and a bound each, and the runs of postings (a, b) of its terms, end to end."""

    def __init__(self, query, bound, size, a, b, top):
        self.query, self.bound, self.size, self.a, self.b, self.top = query, bound, size, a, b, top

    @staticmethod
    def of(ranges: Ranges, query, owner, a, b) -> _Frontier:
        """Intervals from runs: `owner` numbers the interval of each run, ascending; empty runs and intervals go."""
        some = b > a
        owner, a, b = owner[some], a[some], b[some]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        top = ranges.best(a, b)
        return _Frontier(query[owner[start]], _sums(ranges.impact[top], start), np.diff(np.append(start, len(owner))), a, b, top)

    def where(self, keep: np.ndarray) -> _Frontier:
        runs = np.repeat(keep, self.size)
        return _Frontier(self.query[keep], self.bound[keep], self.size[keep], self.a[runs], self.b[runs], self.top[runs])

    def plus(self, other: _Frontier) -> _Frontier:
        return _Frontier(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in ("query", "bound", "size", "a", "b", "top")))


def _batch_of(open_: _Frontier) -> np.ndarray:
    """Whether an interval is among the BATCH best of its query."""
    order = np.lexsort((-open_.bound, open_.query))
    query = open_.query[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    taken = np.zeros(len(order), dtype=bool)
    taken[order[rank < BATCH]] = True
    return taken


class _Best:
    """The k best (score, document) of every query so far; documents are places in order of preference."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.zeros(queries, np.int64)
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query, score, doc) -> None:
        some = score >= np.maximum(self.floor[query], 1)
        query, score, doc = (np.concatenate([x, y[some]]) for x, y in ((self.query, query), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        last = rank == self.k - 1
        self.floor[query[last]] = score[last]
        keep = rank < self.k
        self.query, self.score, self.doc = query[keep], score[keep], doc[keep]


def best_first(ranges: Ranges, first: np.ndarray, queries: Queries, k: int) -> _Best:
    """Exact k best documents of every query. `first`: where the list of each term starts, and the end."""
    n = len(queries.ids)
    best = _Best(n, k)
    owner = np.repeat(np.arange(n), np.diff(queries.start))
    open_ = _Frontier.of(ranges, np.arange(n), owner, first[queries.term], first[queries.term + 1])
    while len(open_.query):
        taken = _batch_of(open_)
        now, open_ = open_.where(taken), open_.where(~taken)
        start = np.cumsum(now.size) - now.size
        owner = np.repeat(np.arange(len(now.query)), now.size)
        impact = ranges.impact[now.top]
        order = np.lexsort((-impact, owner))  # the first run of an interval now has its largest single impact
        doc = ranges.key[now.top[order[start]]] % ranges.width
        aim = (ranges.key[now.a] // ranges.width) * ranges.width + doc[owner]
        cut = np.searchsorted(ranges.key, aim)  # inside the list, so within or at the ends of the run
        cut = np.clip(cut, now.a, now.b)
        hit = (cut < now.b) & (ranges.key[np.minimum(cut, now.b - 1)] == aim)
        best.add(now.query, _sums(np.where(hit, ranges.impact[np.minimum(cut, now.b - 1)], 0), start), doc)
        for a, b in ((now.a, cut), (cut + hit, now.b)):
            part = _Frontier.of(ranges, now.query, owner, a, b)
            open_ = open_.plus(part.where(part.bound >= best.floor[part.query]))
        open_ = open_.where(open_.bound >= best.floor[open_.query])
    return best


def _searched(table: pa.Table, queries: Queries, k: int) -> pa.Table:
    """The k best documents of a block for every query, from the block's lists."""
    rows = sorted(zip(table.column("term").to_pylist(), range(table.num_rows)))
    head = table.slice(rows[0][1], 1)
    ids = head.column("docs").combine_chunks().flatten()
    size = head.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
    # Places are renumbered by doc_id, nulls last, so that ties are decided by place.
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    value = ids.fill_null(0).to_numpy()
    order = np.lexsort((np.arange(len(ids)), value, ~known))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    dense = 100 - BASE + (SLOPE * size * queries.documents) // queries.terms
    number, at, tf = [], [], []
    for term, row in rows[1:]:
        here = table.slice(row, 1)
        at.append(here.column("at").combine_chunks().flatten().to_numpy())
        tf.append(here.column("tf").combine_chunks().flatten().to_numpy())
        number.append(np.full(len(at[-1]), queries.names[term]))
    if not number:
        return pa.table({n: pa.array([], t) for n, t in (("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()))})
    number, at, tf = np.concatenate(number), np.concatenate(at), np.concatenate(tf).astype(np.int64)
    key = number * len(ids) + place[at]
    impact = queries.weight[number] * ((SCALE * tf) // (1000 * tf + 20 * dense[at]))
    sort = np.argsort(key, kind="stable")
    key, impact = key[sort], impact[sort]
    first = np.searchsorted(key, np.arange(len(queries.names) + 1) * len(ids))
    best = best_first(Ranges(impact, key, len(ids), int(np.diff(first).max())), first, queries, k)
    return pa.table({"query": pa.array(best.query, pa.int32()), "doc_id": ids.take(pa.array(order[best.doc])), "score": pa.array(best.score)})


def _turn(postings: DataFrame, items: list[tuple[int | None, str]], documents: int, terms: int, k: int) -> DataFrame:
    spark = postings.sparkSession
    wanted = sorted({t for _, text in items for t in terms_of((text or "").encode())})
    asked = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array([*wanted, LENGTHS], pa.binary())})))
    lists = postings.join(asked, "term", "left_semi")
    held = lists.filter(F.length("term") > 0).groupBy("term").agg(F.sum(F.size("at").cast("long")).alias("df"))
    queries = Queries(items, {bytes(r["term"]): r["df"] for r in held.collect()}, documents, terms)  # at most the items' terms
    shared = spark.sparkContext.broadcast(queries)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = _searched(table, shared.value, k)
        return found.append_column("block", pa.array(np.full(found.num_rows, key[0].as_py())))

    found = lists.groupBy("block").applyInArrow(run, "query int, doc_id long, score long, block long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "block"]
    for part in (["query", F.pmod(F.xxhash64("block"), F.lit(SALTS))], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, i in enumerate(queries.ids)], "query int, item_id long")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def _turns(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items in lots of at most QUERY_BYTES of text (a longer item alone), read through an iterator."""
    lot, held = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        size = len(row["text"] or "")
        if lot and held + size > QUERY_BYTES:
            yield lot
            lot, held = [], 0
        lot.append((row["item_id"], row["text"]))
        held += size
    if lot:
        yield lot


def search(postings: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item with a score above 0."""
    one = F.col("term") == F.lit(LENGTHS)
    size = F.aggregate("tf", F.lit(0).cast("long"), lambda total, n: total + n)
    figures = postings.filter(one).agg(F.sum(F.size("docs").cast("long")).alias("documents"), F.sum(size).alias("terms")).first()
    documents, terms = figures["documents"] or 0, figures["terms"] or 0
    found = postings.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for lot in _turns(items):
        found = found.unionByName(_turn(postings, lot, documents, terms, k))
    return found
