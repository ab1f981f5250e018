"""Token counts by a two-tier lookup on the map side.

A text is cut into pre-tokens, whose token counts add up. Counts of the FREQUENT most frequent pre-tokens of a
bounded sample are broadcast as a table; other pre-tokens are encoded once per worker, in batches, and kept in
a bounded cache. Nothing is shuffled. The sample only decides what is looked up fast, never a count.

The pre-token pattern is applied only to texts of characters on whose classes all Unicode versions agree;
any other text is encoded whole by the library. Added tokens inside a text are one token each, as the library
treats them by default.

Defined cases: null texts are empty and count no tokens; repeated rows are counted one by one; extra columns
pass through, the columns named below replace columns of that name.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

SAMPLE_ROWS = 1000  # bound of the sample whose pre-tokens fill the table
FREQUENT = 30_000  # bound of the broadcast table
LONGEST = 64  # of its keys
CACHE = 300_000  # pre-tokens kept per worker
# Fixed value: the split of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSURE = r"[^\t\n\r\x20-\x7e¡-ʯ‐-‧‰-⁞€一-龥]"


class PretokenCounter:
    """Counts of whole texts with the table and a cache of its own."""

    def __init__(self, path: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split, self.unsure = regex.compile(PATTERN).findall, regex.compile(UNSURE).search
        self.frequent, self.known = frequent, dict(frequent)

    def encoded(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens between added tokens, and the number of these."""
        if self.added is None or not self.added.search(text):
            return self.split(text), 0
        parts = self.added.split(text)
        return [p for part in parts for p in self.split(part)], len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        found = []
        for text in texts:
            if self.unsure(text):
                found.append(self.encoded([text])[0])
                continue
            pieces, extra = self.pretokens(text)
            values = list(map(self.known.get, pieces))
            if None in values:
                missing = list(dict.fromkeys(p for p, v in zip(pieces, values) if v is None))
                if len(self.known) > CACHE:
                    self.known = dict(self.frequent)
                self.known |= zip(missing, self.encoded(missing))
                fresh = dict(zip(missing, map(self.known.get, missing)))
                values = [fresh[p] if v is None else v for p, v in zip(pieces, values)]
            found.append(sum(values) + extra)
        return found


def frequent_table(docs: DataFrame, path: str) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of at most SAMPLE_ROWS rows, picked by hash of doc_id."""
    picked = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("text").filter("text is not null").limit(SAMPLE_ROWS)
    counter, seen = PretokenCounter(path, {}), Counter()
    for row in texts.toLocalIterator():
        seen.update(counter.pretokens(row["text"])[0])
    top = [p for p, _ in seen.most_common(FREQUENT) if len(p) <= LONGEST]
    return dict(zip(top, counter.encoded(top)))


def counted(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit. `path`: a byte-level tokenizers file readable on every executor."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PretokenCounter(path, table.value)
        for texts in batches:
            yield pd.Series(counter.counts([t or "" for t in texts]), dtype="int64")

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = docs.withColumns({"n_bytes": size, "n_tokens": tokens(F.col("text"))})
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
