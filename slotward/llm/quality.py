"""Quality rules as a short-circuit cascade.

Every text is measured once (words, symbols, repeated lines and word windows; the base columns), and the base
test is applied. Survivors run through RULES in the order of rejections per cost: each rule is timed on a
bounded sample of rows and its rejection rate there is noted; a text that a rule rejects meets no later rule.
A text is kept if no rule rejects it, so the order changes the time and never the verdict.

Words are runs of anything but space and the five ASCII line and tab characters.
Defined cases: null texts are empty: no words, base_failed; repeated rows are judged one by one; an empty
sample leaves the rules in their written order; extra columns pass through, the columns named below replace
columns of that name.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SAMPLE_ROWS = 500
SPACE = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
LETTER = re.compile(r"[^\W\d_]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Measured:
    """A text and its base columns."""

    text: str
    words: list[bytes]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> Measured:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return Measured(text, words, len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated(words), len(lines))


def _wordless(m: Measured) -> bool:
    """Under seven tenths of the words have a letter."""
    return 10 * sum(1 for w in m.text.split() if LETTER.search(w)) < 7 * m.n_words


def _crowded(m: Measured) -> bool:
    """One word of four or more bytes makes up a fifth of the text."""
    long = [w for w in m.words if len(w) >= 4]
    return bool(long) and 5 * max(np.unique(np.array(long, dtype=object), return_counts=True)[1]) > m.n_words


#: Rejecting rules by name.
RULES: dict[str, Callable[[Measured], bool]] = {
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > 3 * m.n_words,
    "repeated_lines": lambda m: 2 * m.n_dup_lines > m.n_lines,
    "repeated_words": lambda m: 10 * m.n_repeat_words > 4 * m.n_words,
    "wordless": _wordless,
    "crowded": _crowded,
}


def ordered(sample: list[str | None]) -> list[str]:
    """Rule names by rejections per second on the sample, best first."""
    texts = [m for m in map(measure, sample) if not m.base_failed]
    gain = {}
    for name, rule in RULES.items():
        begun = time.thread_time()
        rejected = sum(map(rule, texts))
        gain[name] = rejected / max(time.thread_time() - begun, 1e-6)
    return sorted(RULES, key=lambda name: -gain[name])


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """Texts of at most `rows` rows, picked by hash of doc_id."""
    picked = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return [r["text"] for r in docs.join(F.broadcast(picked), "doc_id", "left_semi").select("text").limit(rows).collect()]


def judged(docs: DataFrame) -> DataFrame:
    """Add the base columns, base_failed and kept."""
    order = ordered(sample_texts(docs))

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rules = [RULES[name] for name in order]
        for texts in batches:
            rows = []
            for m in map(measure, texts):
                kept = not m.base_failed and not any(rule(m) for rule in rules)
                rows.append((*(getattr(m, name) for name in BASE), m.base_failed, kept))
            yield pd.DataFrame(rows, columns=[*BASE, "base_failed", "kept"])

    found = docs.withColumn("_quality", quality(F.col("text")))
    return found.withColumns({n: F.col(f"_quality.{n}") for n in (*BASE, "base_failed", "kept")}).drop("_quality")
