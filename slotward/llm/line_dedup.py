"""Removal of repeated lines and paragraphs across all documents, with original offsets.

Units are the lines of a text and its paragraphs of two or more lines (runs of lines between blank ones, so that a
passage wrapped in another way is met as well). Units are normalised (lower case, single spaces) and digested, MD5
of all their characters; digests are grouped globally with counts and the earliest occurrence by (doc_id, text
digest, line number), nulls last. Counting is combined on the map side, so a unit that a third of all documents
share leaves a task as one row; units held more than HOT times meet their occurrences by a broadcast that is
counted first, only the others are shuffled. All later occurrences are removed.

Defined cases: null texts are empty; blank lines always stay, and so do lines of under `min_words` words (an option,
1 by default) with the paragraphs under it; lower case goes letter by letter; rows equal in doc_id and text rank
equally and get the same answer; a unit repeated inside one document stays once. All columns of `docs` pass
through `cleaned`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from . import common

HOT = 1000  # occurrences above which a unit is looked up by broadcast
BROADCAST_ROWS = 1_000_000
DOCUMENTS = 500  # of one batch of units
BLANKS = dict.fromkeys((9, 11, 12, 13), 32)
SPAN = pa.struct([("line", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
UNITS = "doc_id long, digest long, line int, spans array<struct<line:int,start:long,end:long>>, unit binary"


def normalised(text: str) -> list[str]:
    """The lines of a text in lower case with single spaces."""
    lines = text.translate(BLANKS).replace("İ", "i").replace("Σ", "σ").lower().split("\n")
    return [" ".join(filter(None, v.split(" "))) if "  " in v or v[:1] == " " or v[-1:] == " " else v for v in lines]


def units_of(text: str, min_words: int = 1) -> list[tuple[list[tuple[int, int, int]], str]]:
    """(line, start, end) of the lines of every unit, and its normal form."""
    found, run, at = [], [], 0

    def close() -> None:
        if len(run) > 1:
            words = " ".join(v for _, v in run)
            if min_words < 2 or words.count(" ") + 1 >= min_words:
                found.append(([span for span, _ in run], words))
        run.clear()

    for k, (line, unit) in enumerate(zip(text.split("\n"), normalised(text))):
        span = (k, at, at + len(line))
        at += len(line) + 1
        if not unit:
            close()
            continue
        run.append((span, unit))
        if min_words < 2 or unit.count(" ") + 1 >= min_words:
            found.append(([span], unit))
    close()
    return found


def units(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc_id, digest, line, spans, unit) of all units; offsets in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                row, spans, unit = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for own, words in units_of(text, min_words):
                        row.append(k)
                        spans.append([{"line": n, "start": a, "end": b} for n, a, b in own])
                        unit.append(hashlib.md5(words.encode("utf-8", "surrogatepass")).digest())
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(row), part.column("digest").take(row), pa.array([s[0]["line"] for s in spans], pa.int32()),
                     pa.array(spans, pa.list_(SPAN)), pa.array(unit, pa.binary())],
                    names=["doc_id", "digest", "line", "spans", "unit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return rows.filter("text is not null").mapInArrow(run, UNITS)


def removals(docs: DataFrame, min_words: int = 1, hot: int = HOT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, digest, removed) of the rows that lose lines; removed: (line, start, end) in order."""
    found = common.pinned(units(docs, min_words))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "line")
    groups = common.pinned(found.groupBy("unit").agg(F.min(rank).alias("first"), F.count("*").alias("held")).filter("held > 1"))
    most = common.bounded(groups.filter(F.col("held") > hot).select("unit", F.col("first").alias("hot")), broadcast_rows)
    met = found.join(most, "unit", "left")
    few = met.filter("hot is null").drop("hot").join(groups.filter(F.col("held") <= hot).select("unit", "first"), "unit")
    later = met.filter("hot is not null").withColumnRenamed("hot", "first").unionByName(few).filter(rank != F.col("first"))
    each = later.select("doc_id", "digest", F.explode("spans").alias("span"))
    return each.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("span")).alias("removed"))


@F.arrow_udf(StringType())
def _kept(texts: pa.Array, lines: pa.Array) -> pa.Array:
    """Texts without the lines of these numbers."""

    def one(text: str | None, gone: list[int] | None) -> str | None:
        if not gone or text is None:
            return text
        gone = set(gone)
        return "\n".join(v for k, v in enumerate(text.split("\n")) if k not in gone)

    return pa.array(map(one, texts.to_pylist(), lines.to_pylist()), pa.string())


def _joined(docs: DataFrame, min_words: int) -> DataFrame:
    """(own, removed, kept): rows of `docs` as a struct, the lines that go and the text that is left."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    rows = rows.withColumn("key", F.xxhash64("own.text"))
    removed = removals(docs, min_words).withColumnRenamed("doc_id", "id")
    found = rows.join(removed, F.col("own.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("key") == F.col("digest")), "left")
    return found.select("own", "removed", _kept(F.col("own.text"), F.col("removed.line")).alias("kept"))


def report(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """doc_id, n_chars and kept_sha256 of the text that is left, n_removed (characters of removed lines), n_spans and
    spans (start:end of removed lines, comma-joined) of every row."""
    found = _joined(docs.select("doc_id", "text"), min_words)
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    shown = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    left = F.coalesce("kept", F.lit(""))
    return found.select(
        "own.doc_id", F.length(left).cast("long").alias("n_chars"), F.coalesce(total, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_spans"),
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("spans"), F.sha2(left, 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """`docs` without the repeated lines (and their line ends), all columns kept."""
    found = _joined(docs, min_words)
    return found.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"own.`{c}`").alias(c) for c in docs.columns])
