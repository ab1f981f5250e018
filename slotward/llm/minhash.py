"""Near-duplicate classes by weighted minwise hashing of word shingles.

Signatures follow BagMinHash: every distinct shingle of five words owns Poisson processes over its weight
(its count in the text), arranged in a dyadic hierarchy [0,1], [1,2], [2,4], ...; inside the interval that
holds the weight a point counts only if its level lies below the weight. Points come in order of time, each
falls on one register, and a process stops once its time passes the text's largest register. Two registers
agree with the probability of the weighted Jaccard similarity of the two bags.

Registers are banded; texts that share a band are linked to one leader of that band, links are verified by
exact multiset overlap (k-th occurrences of a shingle are elements of their own, so set overlap is multiset
overlap), and verified links are closed to classes. Bands that then still hold more than one class get other
leaders, and what is left after that is compared through the rarest shingles of each text: two texts at the
threshold must share one of those, so no link is lost, and only members outside a shingle's main class start
comparisons. No group is expanded into all pairs and no key needs one task.

Defined cases: a null text is in a class of its own row; texts without words (symbols, blanks, the empty text)
share a class with exact copies only; a text of one to four
words is one shingle, so it meets equal word lists only; equal word lists (also under equal or null doc_id)
share a class. A class is named by its least doc_id; null ids count as the largest, and a class of null ids
only is named null. `docs` may carry any other columns: only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 shares a band with probability 0.99995
REGISTERS = BANDS * ROWS
SLICE = 200_000  # words handled at once in a worker
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bags(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of all shingles of texts given as word codes; sorted by text and shingle."""
    count = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(sizes)), count)
    first = np.repeat(np.cumsum(sizes) - sizes, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    value = np.zeros(len(owner), dtype=np.uint64)
    long_enough = sizes[owner] - SHINGLE >= 0
    for k in range(SHINGLE):
        there = long_enough | (k < sizes[owner])
        at = np.minimum(first + k, max(len(codes) - 1, 0))
        value = np.where(there, mixed(value * GOLD + codes[at]), value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    start = np.flatnonzero(new)
    return owner[start], value[start], np.diff(np.append(start, len(owner)))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """Registers of every text: the identity of the earliest point on each."""
    time = np.full(texts * REGISTERS, np.inf)
    mark = np.zeros(texts * REGISTERS, dtype=np.uint64)
    # One process per shingle and dyadic interval below or around its count.
    top = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    pick = np.repeat(np.arange(len(owner)), top + 1)
    level = np.arange(len(pick)) - np.repeat(np.cumsum(top + 1) - top - 1, top + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.maximum(low, 1)
    own, weight = owner[pick], count[pick]
    seed = mixed(shingle[pick] ^ mixed(level.astype(np.uint64)))
    total = np.bincount(own, weights=length, minlength=texts)
    need = REGISTERS * (np.log(REGISTERS) + 1)
    step = np.clip(np.ceil(need * length / total[own] / 3), 1, 512).astype(np.int64)
    clock, drawn = np.zeros(len(own)), np.zeros(len(own), dtype=np.int64)
    while len(own):
        size = step
        at = np.cumsum(size) - size
        who = np.repeat(np.arange(len(own)), size)
        number = np.arange(len(who)) - np.repeat(at, size) + drawn[who]
        point = mixed(seed[who] + mixed(number.astype(np.uint64)))
        wait = -np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length[who]
        run = np.cumsum(wait)
        run = run - np.repeat(run[at] - wait[at], size) + clock[who]
        clock, drawn = run[at + size - 1], drawn + size
        other = mixed(point ^ MIX)
        inside = low[who] + (other >> np.uint64(32)) % length[who].astype(np.uint64) < weight[who]
        cell = own[who] * REGISTERS + ((other & np.uint64(0xFFFFFFFF)) % np.uint64(REGISTERS)).astype(np.int64)
        cell, when, point = cell[inside], run[inside], point[inside]
        np.minimum.at(time, cell, when)
        won = time[cell] == when
        mark[cell[won]] = point[won]
        latest = time.reshape(texts, REGISTERS).max(axis=1)
        go = clock < latest[own]
        own, weight, seed, low, length, step, clock, drawn = (x[go] for x in (own, weight, seed, low, length, step, clock, drawn))
    return mark.reshape(texts, REGISTERS)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(lists.offsets.to_numpy())


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE words; a longer text is a range of its own."""
    begin, held = 0, 0
    for row, n in enumerate(sizes.tolist()):
        if row > begin and held + n > SLICE:
            yield begin, row
            begin, held = row, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values.view(np.int64)))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, sizes = _flat(batch, "codes")
        ends = np.append(0, np.cumsum(sizes))
        for begin, end in _slices(sizes):
            part = sizes[begin:end].astype(np.int64)
            marks = signatures(*bags(codes[ends[begin] : ends[end]], part), end - begin)
            keys = np.zeros((end - begin, BANDS), dtype=np.uint64)
            for k in range(ROWS):
                keys = mixed(keys * GOLD + marks.reshape(-1, BANDS, ROWS)[:, :, k])
            keys = mixed(keys + np.arange(BANDS, dtype=np.uint64))
            # Texts without words have no bands: their registers are all empty.
            keys = _lists(keys[part > 0].ravel(), np.where(part > 0, BANDS, 0))
            names = ["doc_id", "digest", "node"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(begin, end - begin) for n in names), keys], [*names, "keys"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, sizes = _flat(batch, "codes")
        ends = np.append(0, np.cumsum(sizes))
        for begin, end in _slices(sizes):
            owner, shingle, count = bags(codes[ends[begin] : ends[end]], sizes[begin:end].astype(np.int64))
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            value = np.where(nth > 0, mixed(np.repeat(shingle, count) + mixed(nth.astype(np.uint64))), np.repeat(shingle, count))
            n = np.bincount(np.repeat(owner, count), minlength=end - begin)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(begin, end - begin), _lists(value, n)], ["node", "elements"])


def coded(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, codes): digests of the text and of its word list (of the text without words), word codes."""
    doc_id, digest = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest")
    found = docs.select(doc_id, digest, "text", common.words(F.col("text")).alias("words"))
    # A byte more keeps texts without words apart from word lists; null texts have no node.
    whole = F.unhex(F.concat(F.md5("text"), F.lit("00")))
    node = F.when(F.size("words") > 0, F.unhex(F.md5(F.array_join("words", " ")))).otherwise(whole)
    return found.select("doc_id", "digest", node.alias("node"), F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))


def _overlap(a: str, b: str) -> F.Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts whose multisets of shingles overlap enough."""
    one, two = elements.toDF("a", "ea"), elements.toDF("b", "eb")
    ratio = F.least(F.size("ea"), F.size("eb")) >= similarity * F.greatest(F.size("ea"), F.size("eb"))
    return pairs.join(one, "a").join(two, "b").filter(ratio).filter(_overlap("ea", "eb") >= similarity).select("a", "b")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _rest(members: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Pairs of open texts in different classes that share a rare element, by the prefix rule.

    Two sets with overlap t share an element among the first (1 - t) n + 1 of each, in any fixed order;
    rare elements come first here. Members of an element's largest class only answer.
    """
    spread = members.join(elements, "node").select("node", "component", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    spread = common.pinned(spread)
    rare = spread.groupBy("element").agg(F.count("*").alias("texts"))
    per_text = spread.join(rare, "element").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "element"))).alias("sorted"))
    size = F.floor((1 - similarity) * F.col("n") + 1e-9).cast("int") + 1
    prefix = per_text.select("node", "component", "n", F.posexplode(F.slice("sorted", F.lit(1), size)["element"]).alias("at", "element"))
    prefix = common.pinned(prefix)
    sized = prefix.groupBy("element", "component").agg(F.count("*").alias("held"))
    main = sized.groupBy("element").agg(F.max_by("component", F.struct("held", "component")).alias("main"), F.count("*").alias("classes"))
    open_ = main.filter("classes > 1").select("element", "main")
    asking = prefix.join(open_, "element").filter("component != main").select("element", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), (F.col("n") - F.col("at")).alias("ra"))
    answer = prefix.select("element", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), (F.col("n") - F.col("at")).alias("rb"))
    # At the first element that two texts share, what follows in each bounds their overlap.
    needed = similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    close = (F.col("ca") != F.col("cb")) & (F.least("ra", "rb") >= needed)
    return _pairs(asking.join(answer, "element").filter(close))


def linked(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, node) of every row, and (node, component) of every different word list."""
    rows = coded(docs)
    schema = "doc_id long, digest long, node binary, keys array<long>"
    signed = common.pinned(rows.mapInArrow(_bands, schema))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    texts = signed.filter("node is not null").groupBy("node").agg(F.first("keys").alias("keys"), F.min(least).alias("row"))
    spread = texts.select("node", F.explode("keys").alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1")
    members = common.pinned(spread.join(sizes, "key"))
    # A text that shares bands with most others is closest to what they are copies of: it leads its bands.
    weight = members.groupBy("node").agg(F.sum("held").alias("weight"))
    leaders = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("leader"))
    members = common.pinned(members.join(leaders, "key").select("key", "node", F.col("leader.node").alias("leader")))
    involved = members.select("node").distinct().join(texts.select("node", "row"), "node")
    involved = involved.select(F.col("node").alias("_node"), F.col("row.doc_id").alias("_doc"), F.col("row.digest").alias("_digest"))
    # Equal word lists give equal elements: one row of a node is looked up, so copies spread by their ids.
    same = (rows["node"] == involved["_node"]) & (rows["digest"] == involved["_digest"]) & rows["doc_id"].eqNullSafe(involved["_doc"])
    one = rows.join(involved, same, "left_semi").dropDuplicates(["node"])
    elements = one.mapInArrow(_elements, "node binary, elements array<long>")
    elements = common.pinned(elements)
    pairs = common.pinned(_pairs(members.select(F.col("node").alias("a"), F.col("leader").alias("b"))))
    links = common.pinned(verified(pairs, elements, similarity))
    found = common.components(links)
    placed = _with_class(members.select("key", "node"), found)
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high")
    members = common.pinned(placed.join(open_keys.select("key"), "key", "left_semi").select("node", "component").distinct())
    if not members.isEmpty():
        fresh = common.pinned(_rest(members, elements, similarity).join(pairs, ["a", "b"], "left_anti"))
        more = verified(fresh, elements, similarity)
        for end in ("a", "b"):
            own = _with_class(more.withColumnRenamed(end, "node"), found)
            more = own.withColumn("node", F.col("component")).drop("component").withColumnRenamed("node", end)
        joined = common.components(more).toDF("component", "whole")
        placed = _with_class(texts.select("node"), found).join(joined, "component", "left")
        return signed.drop("keys"), placed.select("node", F.coalesce("whole", "component").alias("component"))
    return signed.drop("keys"), _with_class(texts.select("node"), found)


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size, texts) for every row: its class, rows and different texts in the class."""
    rows, named = linked(docs, similarity)
    counted = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    summed = counted.join(named, "node").groupBy("component").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("texts"))
    out = rows.join(named.join(summed, "component").drop("component"), "node", "left")
    own = F.col("node").isNull()
    return out.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        *[F.when(own, 1).otherwise(F.col(c)).cast("long").alias(c) for c in ("class_size", "texts")])


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of `docs` with one row of every class: that of the least doc_id (nulls last), then text digest.

    The rows to go are found by (doc_id, text digest); rows equal in both are told apart last, among themselves.
    """
    rows, named = linked(docs, similarity)
    keys = rows.filter("node is not null").groupBy("node", "doc_id", "digest").agg(F.count("*").alias("copies"))
    placed = keys.join(named, "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = placed.groupBy("component").agg(F.min(order).alias("first"))
    judged = placed.join(first, "component").withColumn("stays", order == F.col("first"))
    marked = judged.filter("not stays or copies > 1").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "stays")
    marked = common.bounded(common.pinned(marked), broadcast_rows)
    same = marked["_doc"].eqNullSafe(docs["doc_id"].cast("long")) & (marked["_digest"] == F.xxhash64(docs["text"]))
    single = docs.join(marked, same, "left_anti")
    repeated = docs.join(marked.filter("stays").drop("stays"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)
