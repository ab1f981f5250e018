"""Removal of every byte covered by a 200-byte string that also starts elsewhere, exactly.

1. Each 200-byte window of a text picks one anchor: its least GRAM-byte string by hash (leftmost of equals).
   Equal windows pick equal anchors at equal places, so windows can only repeat where an anchor does. A text
   gives one row per anchor, with the run of windows that picked it and a digest of all bytes these cover.
2. Anchors are counted with map-side sums; single ones drop out, which is most of the corpus.
3. If anchor and digest both repeat, all windows of the run repeat. What is left are runs whose anchor repeats
   in other surroundings: the ends of copied passages.
4. One segment for each different surrounding goes to the shard of its anchor. A shard sorts its segments'
   suffixes (induced sorting) and reads repeats off the permuted common prefixes; a repeat needs two places in
   the corpus, since segments of one text overlap.
   An anchor with more than `shard_segments` surroundings is not put in one shard: its windows are counted by
   digest, again with map-side sums, so a passage in a third of all documents needs no single task.

Texts are moved only for rows that have such segments or repeats, picked by a broadcast of their keys if these
are at most `broadcast_rows`, else by a shuffle join.

Defined cases: null texts are empty; texts under 200 bytes lose nothing; repeated rows are documents of their
own, so both lose all they have in windows; rows are told apart by a 64-bit hash of doc_id and text, rows
equal in both get the same answer. Extra columns are not read by `report` and pass through `cleaned`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common, suffix

WINDOW = 200
GRAM = 40
SPAN = WINDOW - GRAM + 1  # grams in a window
SHARD_SEGMENTS = 1000
BLOCK = 12  # windows digested together where an anchor has more surroundings
SHARD_BYTES = 2_000_000
SLICE = 1_000_000  # bytes scanned at once
BROADCAST_ROWS = 1_000_000
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 2**64)
LETTERS = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)], dtype=np.uint64)


def anchors(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, digest, first, more, lead) of concatenated texts, a row per run of windows with one anchor.

    The run starts at `first` and has `more` further windows; the anchor lies `lead` bytes after its start.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < WINDOW:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    letters = LETTERS[np.frombuffer(raw, dtype=np.uint8)]
    up, down = powers(STEP, len(raw)), powers(BACK, len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[:-1], dtype=np.uint64)])
    gram = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(total) - GRAM])
    place = np.arange(len(gram), dtype=np.uint64)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | place
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    picked = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    window = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + start[text]
    picked = picked[window]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (picked[1:] != picked[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) - 1
    first, last = window[begin], window[end]
    covered = (total[last + WINDOW] - total[first]) * down[first]
    digest = mixed(covered ^ mixed((last - first).astype(np.uint64)) ^ mixed((picked[begin] - first + 7).astype(np.uint64)))
    text = text[begin]
    return text, gram[picked[begin]], digest, first - start[text], last - first, picked[begin] - first


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for row, n in enumerate(sizes.tolist()):
        if row > begin and held + n > SLICE:
            yield begin, row
            begin, held = row, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, keys = batch.column("raw"), batch.column("key")
        sizes = np.array([len(x) for x in raw.to_pylist()], dtype=np.int64)
        for a, b in _slices(sizes):
            text, anchor, digest, first, more, lead = anchors(b"".join(raw.slice(a, b - a).to_pylist()), sizes[a:b])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(text + a)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(first), pa.array((more * 256 + lead).astype(np.int32))],
                ["key", "anchor", "digest", "first", "shape"])


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, raw) of every row."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def repeats(segments: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(key, start, end) of the bytes of (key, first, bytes) segments in windows with another place in a segment."""
    mark = bytes([suffix.SEPARATOR])
    text = np.frombuffer(mark.join(s[2] for s in segments) + mark, dtype=np.uint8)
    size = np.array([len(s[2]) for s in segments], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    order = suffix.suffix_array(text)
    shared = suffix.common_prefixes(text, order) >= WINDOW
    group = np.cumsum(~shared)
    owner = np.searchsorted(begin, order, side="right") - 1
    inside = order - begin[owner]
    usable = inside + WINDOW <= size[owner]
    order, group, owner, inside = order[usable], group[usable], owner[usable], inside[usable]
    if not len(order):
        return []
    places = np.unique(np.array([s[0] for s in segments], dtype=np.int64), return_inverse=True)[1]
    first = np.array([s[1] for s in segments], dtype=np.int64)
    place = places[owner] * (int((first + size).max()) + 1) + first[owner] + inside
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.append(start, len(group)))
    again = np.repeat(np.minimum.reduceat(place, start) != np.maximum.reduceat(place, start), count)
    owner, inside = owner[again], inside[again]
    ordered = np.lexsort((inside, owner))
    owner, inside = owner[ordered], inside[ordered]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)]) if len(owner) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(owner)) - 1
    return [(segments[o][0], int(first[o] + a), int(first[o] + b + WINDOW)) for o, a, b in zip(owner[new].tolist(), inside[new].tolist(), inside[last].tolist())]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sort segments in pieces of about SHARD_BYTES; an anchor's segments (sorted together) stay in one."""

    def done(held):
        found = repeats(held)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["key", "start", "end"])

    held, size, current = [], 0, None
    for batch in batches:
        for anchor, key, first, raw in zip(*(batch.column(n).to_pylist() for n in ("anchor", "key", "first", "raw")), strict=True):
            if anchor != current and size > SHARD_BYTES:
                yield done(held)
                held, size = [], 0
            current = anchor
            held.append((key, first, raw))
            size += len(raw)
    if held:
        yield done(held)


def _only(rows: DataFrame, keys: DataFrame, how: str, broadcast_rows: int) -> DataFrame:
    return rows.join(common.bounded(keys, broadcast_rows), "key", how)


def spans(docs: DataFrame, shard_segments: int = SHARD_SEGMENTS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, start, end) byte ranges to remove, possibly overlapping."""
    rows = keyed(docs)
    found = rows.select("key", "raw").filter(F.octet_length("raw") >= WINDOW).mapInArrow(_scan, "key long, anchor long, digest long, first long, shape int")
    many = found.groupBy("anchor").agg(F.count("*").alias("held")).filter("held > 1").select("anchor")
    found = common.pinned(found.join(many, "anchor"))
    kinds = found.groupBy("anchor", "digest").agg(F.count("*").alias("held"), F.min(F.struct("key", "first", "shape")).alias("one"))
    kinds = common.pinned(kinds)
    more, lead = lambda shape: F.floor(shape / 256).cast("int"), lambda shape: shape % 256
    end = F.col("first") + more(F.col("shape")) + WINDOW
    whole = found.join(kinds.filter("held > 1").select("anchor", "digest"), ["anchor", "digest"]).select("key", F.col("first").alias("start"), end.alias("end"))
    varied = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    asked = kinds.join(varied, "anchor").select("anchor", "kinds", "one.*")
    wanted = common.pinned(asked.groupBy("key").agg(F.collect_list(F.struct("anchor", "kinds", "first", "shape")).alias("runs")))
    texts = _only(rows.select("key", "raw"), wanted.select("key"), "left_semi", broadcast_rows).dropDuplicates(["key"])
    cut = F.transform("runs", lambda r: F.struct(
        r["anchor"].alias("anchor"), r["kinds"].alias("kinds"), r["first"].alias("first"), more(r["shape"]).alias("more"), lead(r["shape"]).alias("lead"),
        F.substring(F.col("raw"), (r["first"] + 1).cast("int"), more(r["shape"]) + WINDOW).alias("raw")))
    segments = common.pinned(texts.join(wanted, "key").select("key", F.inline(cut)))
    small = segments.filter(F.col("kinds") <= shard_segments).select("anchor", "key", "first", "raw")
    sharded = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, "key long, start long, end long")
    large = segments.filter(F.col("kinds") > shard_segments)
    return whole.unionByName(sharded).unionByName(_counted(large))


def _repeated(rows: DataFrame, digest: str, start: str) -> DataFrame:
    """Digests that occur at two places; counted with map-side sums."""
    place = F.struct("key", start)
    return rows.groupBy(digest).agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select(digest)


def _counted(segments: DataFrame) -> DataFrame:
    """(key, start, end) of repeated windows among (key, first, more, lead, raw) segments, by digests.

    Windows are taken BLOCK at a time, in blocks fixed to the anchor. A block that repeats as a whole is done. All
    windows of a block hold its core, so only blocks whose core repeats are taken apart.
    """
    number = lambda at: F.floor(at / BLOCK).cast("int")
    blocks = segments.withColumn("block", F.explode(F.sequence(number(F.col("lead") - F.col("more")), number(F.col("lead")))))
    low = F.greatest(F.lit(0), F.col("lead") - F.col("block") * BLOCK - (BLOCK - 1))
    high = F.least(F.col("more"), F.col("lead") - F.col("block") * BLOCK)
    core = F.col("lead") - F.col("block") * BLOCK
    part = lambda at, size: F.substring(F.col("raw"), at + 1, size)
    blocks = common.pinned(blocks.select(
        "key", (F.col("first") + low).alias("start"), (F.col("first") + high).alias("last"), (F.col("first") + core).alias("place"),
        part(low, high - low + WINDOW).alias("raw"), F.unhex(F.md5(part(low, high - low + WINDOW))).alias("whole"),
        F.unhex(F.md5(part(core, F.lit(WINDOW - BLOCK + 1)))).alias("core")))
    wholes = common.pinned(_repeated(blocks, "whole", "start"))
    done = blocks.join(wholes, "whole", "left_semi").select("key", "start", (F.col("last") + WINDOW).alias("end"))
    rest = blocks.join(wholes, "whole", "left_anti").join(_repeated(blocks, "core", "place"), "core", "left_semi")
    rest = common.pinned(rest)
    # One block of every kind that is done stands for it: windows of the rest may repeat there.
    others = blocks.join(wholes, "whole", "left_semi").join(rest.select("core"), "core", "left_semi").dropDuplicates(["whole"])
    at = F.explode(F.sequence(F.lit(0), (F.col("last") - F.col("start")).cast("int")))
    windows = rest.unionByName(others.select(rest.columns)).select("key", "start", "raw", at.alias("at"))
    windows = common.pinned(windows.select("key", (F.col("start") + F.col("at")).alias("start"), F.unhex(F.md5(F.substring(F.col("raw"), F.col("at") + 1, F.lit(WINDOW)))).alias("window")))
    again = windows.join(_repeated(windows, "window", "start"), "window", "left_semi")
    return done.unionByName(again.select("key", "start", (F.col("start") + WINDOW).alias("end")))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, ranges in zip(batch.column("raw").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            runs = merged([(r["start"], r["end"]) for r in ranges or []])
            rows.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(raw, runs)).hexdigest()))
        columns = [pa.array([r[k] for r in rows], pa.int64() if k < 3 else pa.string()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _touched(docs: DataFrame) -> DataFrame:
    """(key, ranges) of the rows that lose bytes."""
    return common.pinned(spans(docs).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges")))


def report(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    lost, rows = _touched(docs), keyed(docs)
    changed = _only(rows, lost.select("key"), "left_semi", broadcast_rows).join(lost, "key").select(F.col("doc_id").cast("long").alias("doc_id"), "raw", "ranges")
    changed = changed.mapInArrow(_reported, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    same = _only(rows, lost.select("key"), "left_anti", broadcast_rows).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("raw").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"))
    return same.unionByName(changed)


def cleaned(docs: DataFrame) -> DataFrame:
    """`docs` without the repeated bytes; characters cut in the middle become replacement characters."""
    lost = _touched(docs)

    @F.pandas_udf("string")
    def cut(text, ranges):
        import pandas as pd

        return pd.Series([
            kept(t.encode("utf-8"), merged([(r["start"], r["end"]) for r in rs])).decode("utf-8", "replace") if rs is not None and len(rs) else t
            for t, rs in zip(text, ranges)], dtype=object)

    key: Column = F.xxhash64("doc_id", "text")
    found = docs.withColumn("_key", key).join(lost.withColumnsRenamed({"key": "_key", "ranges": "_ranges"}), "_key", "left")
    return found.withColumn("text", cut("text", "_ranges")).drop("_key", "_ranges")
