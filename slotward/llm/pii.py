"""Personal data by weak supervision, DataFrame functions only.

Base spans are the matches of four fixed patterns that pass their checks; they are always kept. Looser
candidates (numbers without a country code, spelled-out addresses, digit chains that fail the checksum) are
added next to them. Labelers vote on every candidate: its shape, a gazetteer (endings, issuers, area codes,
private networks), the words around it, and the characters next to it, which speak against a part of a longer
word only; each may abstain. Expectation
maximisation over the counts of vote patterns estimates the labelers' reliabilities without labels; its
posteriors train the final span classifier (naive Bayes over votes and surface features), which decides on
the candidates that are not base spans. The counts are one row per kind and pattern, at most PATTERNS rows
whatever the data, so the two small models are fitted from a bounded table; everything else is columns.

Positions are code points, end exclusive, found per row from the pieces between matches, so rows need no key.
Patterns use possessive repeats and starts that look back, so a long run of one character stays linear.

Defined cases: null texts are empty; a row without spans gets zero counts and the digest of the empty text;
repeated rows are answered one by one; without candidates of a kind its classifier stays at even odds, which
adds nothing. Extra columns of `docs` pass through `masked`; names starting with an underscore are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in forms that find the same matches without retrying inside a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
TRIGGER = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OVER_255 = r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)"
# Gazetteers and cue words of the labelers (fixed values).
ENDINGS = r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|pl|pt|se|ch|at|be|uk|ie|eu|us|ca|au|nz|in|jp|cn|br|mx)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|38|6011|65|35)"
AREAS = r"^(?:\+|00)(?:1|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
PRIVATE = r"^(?:10\.|127\.|0\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|169\.254\.|2(?:2[4-9]|[3-5][0-9])\.)"
CUES = {
    "email": r"e-?mail|contact|write|reach|reply|cc|from|to:",
    "ip": r"\bip\b|host|address|client|login|server|addr",
    "card": r"card|visa|master|amex|credit|debit|payment|pay",
    "phone": r"phone|tel|call|mobile|cell|fax|dial|whats",
}
AGAINST = r"token|hash|key|version|order|invoice|isbn|sku|serial|uuid|sha|md5|build|id[:=# ]"
VOTES = ("shape", "gazetteer", "context", "edges")
SURFACE = ("before", "after", "length")
PATTERNS = len(KINDS) * 3 ** len(VOTES) * 4 * 4 * 4
ROUNDS = 40


def _found(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Add array column `name` of (start, end, hit) of all matches of the pattern in _text."""
    text, hits = F.col("_text"), F.col("_hits")
    none = F.array().cast("array<string>")
    df = df.withColumn("_hits", F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda g: F.length(g).cast("long"))
    df = df.withColumn("_gaps", F.when(F.size(hits) > 0, gaps))
    steps = F.transform("_gaps", lambda g, k: g + F.when(k > 0, F.length(F.get(hits, k - 1))).otherwise(0))
    df = df.withColumn("_steps", F.when(F.size(hits) > 0, steps))
    df = df.withColumn("_starts", F.when(F.size(hits) > 0, common.running(F.col("_steps"))))
    spans = F.transform(hits, lambda h, k: F.struct(F.get("_starts", k).alias("start"), (F.get("_starts", k) + F.length(h)).alias("end"), h.alias("hit")))
    return df.withColumn(name, spans).drop("_hits", "_gaps", "_steps", "_starts")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(k: Column) -> Column:
        d = F.substring(digits, n - k, 1).cast("int") * (1 + k % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + term(k)) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    digits = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": ~hit.rlike(OVER_255),
        "card": F.when(digits.between(12, 19), _luhn(_digits(hit))).otherwise(False),
        "phone": digits.between(9, 15),
    }[kind]


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 0 against, -1 abstains."""
    return F.when(no, 0).when(yes, 1).otherwise(-1)


def _candidate(kind: str, span: Column, base: Column) -> Column:
    """A candidate with its labelers' votes and surface features."""
    text, hit, start, end = F.col("_text"), span["hit"], span["start"], span["end"]
    near = F.substring(text, F.greatest(start - 31, F.lit(1)).cast("int"), F.least(start, F.lit(32)).cast("int"))
    before = F.substring(text, start.cast("int"), F.when(start > 0, 1).otherwise(0))
    after = F.substring(text, (end + 1).cast("int"), F.lit(1))
    sort = lambda c: F.when(c == "", 0).when(c.rlike(r"[\p{L}\p{N}]"), 1).when(c.rlike(r"\s"), 2).otherwise(3)
    known = {
        "email": _vote(hit.rlike("(?i)" + ENDINGS), ~hit.rlike(r"\p{L}")),
        "ip": _vote(~hit.rlike(PRIVATE), hit.rlike(PRIVATE)),
        "card": _vote(_digits(hit).rlike(ISSUERS), ~_digits(hit).rlike(ISSUERS)),
        "phone": _vote(hit.rlike(AREAS), _digits(hit).rlike("^([0-9])\\1+$")),
    }[kind]
    word = F.when(before.rlike(r"[\p{L}\p{N}_]"), True).otherwise(after.rlike(r"[\p{L}\p{N}_]"))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), base.alias("base"),
        F.when(base, 1).otherwise(F.lit(0 if kind == "card" else -1)).alias("shape"), known.alias("gazetteer"),
        _vote(near.rlike(f"(?i){CUES[kind]}"), near.rlike(f"(?i){AGAINST}")).alias("context"),
        F.when(word, 0).otherwise(-1).alias("edges"), sort(before).alias("before"), sort(after).alias("after"),
        F.least(F.floor(F.length(hit) / 8), F.lit(3)).cast("int").alias("length"),
    )


def annotated(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add _spans: all candidates of every row, base ones marked."""
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_digits", F.col("_text").rlike("[0-9]"))
    for kind in KINDS:
        mark = TRIGGER[kind]
        when = F.contains("_text", F.lit(mark)) if mark else F.lit(True)
        df = _found(df, f"_{kind}", BASE[kind], when & (F.lit(True) if kind == "email" else F.col("_digits")))
    df = _found(df, "_lemail", LOOSE["email"], F.col("_text").rlike(r"(?:\(at\)|\[at\])"))
    df = _found(df, "_lphone", LOOSE["phone"], F.col("_digits"))
    base, loose = [], []
    for kind in KINDS:
        judged = F.transform(f"_{kind}", lambda s: F.struct(s.alias("s"), _valid(kind, s["hit"]).alias("ok")))
        df = df.withColumn(f"_{kind}", judged)
        base.append(F.transform(F.filter(f"_{kind}", lambda c: c["ok"]), lambda c: _candidate(kind, c["s"], F.lit(True))))
    chain = lambda c: ~c["ok"] & F.length(_digits(c["s"]["hit"])).between(13, 19)
    loose.append(F.transform(F.filter("_card", chain), lambda c: _candidate("card", c["s"], F.lit(False))))
    for kind in ("email", "phone"):
        loose.append(F.transform(f"_l{kind}", lambda s: _candidate(kind, s, F.lit(False))))
    df = df.withColumns({"_base": F.concat(*base), "_loose": F.concat(*loose)})
    apart = F.filter("_loose", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return df.withColumn("_spans", F.concat("_base", apart)).drop("_text", "_digits", "_base", "_loose", "_lemail", "_lphone", *[f"_{k}" for k in KINDS])


def patterns(spans: DataFrame) -> list[dict]:
    """Counts of (kind, votes, surface) over all candidates; at most PATTERNS rows."""
    names = ["kind", *VOTES, *SURFACE]
    each = spans.select(F.inline("_spans")).groupBy(*names).agg(F.count("*").alias("n"))
    return [r.asDict() for r in each.collect()]


def estimate(own: list[dict], rounds: int = ROUNDS) -> tuple[list[float], float, list[float]]:
    """Expectation maximisation over the vote patterns of one kind: the probability of each pattern being personal
    data, the share of personal data, and the log of likelihood times prior before every round, which never falls.

    A labeler is better than chance or says nothing: where the unbound estimates are the other way round, the best
    pair within that bound is one common rate.
    """
    rates = {v: (0.8, 0.3) for v in VOTES}  # P(vote 1 | personal), P(vote 1 | not), given that it votes
    prior, chance, history = 0.5, [0.5] * len(own), []
    total = sum(r["n"] for r in own)
    for _ in range(rounds):
        value = math.log(prior) + math.log(1 - prior)
        value += sum(4 * math.log(p) + math.log(1 - p) + math.log(q) + 2 * math.log(1 - q) for p, q in rates.values())
        for i, r in enumerate(own):
            yes, no = math.log(prior), math.log(1 - prior)
            for v in VOTES:
                if r[v] >= 0:
                    p, q = rates[v]
                    yes += math.log(p if r[v] else 1 - p)
                    no += math.log(q if r[v] else 1 - q)
            chance[i] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
            value += r["n"] * (max(yes, no) + math.log1p(math.exp(-abs(yes - no))))
        history.append(value)
        prior = (sum(c * r["n"] for c, r in zip(chance, own)) + 1) / (total + 2)
        for v in VOTES:
            cast = [(c, r["n"], r[v]) for c, r in zip(chance, own) if r[v] >= 0]
            hit, of = sum(c * n * x for c, n, x in cast) + 4, sum(c * n for c, n, _ in cast) + 5
            stray, out_of = sum((1 - c) * n * x for c, n, x in cast) + 1, sum((1 - c) * n for c, n, _ in cast) + 3
            better = hit / of >= stray / out_of
            both = (hit + stray) / (of + out_of)
            rates[v] = (hit / of, stray / out_of) if better else (both, both)
    return chance, prior, history


def fit(rows: list[dict]) -> dict[str, float]:
    """Weights of the span classifier, by "kind feature value", with the constant under "kind".

    `estimate` gives each vote pattern the probability of being personal data; the classifier is naive Bayes over
    votes and surface features, weighted by those probabilities.
    """
    weights: dict[str, float] = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        if not own:
            continue
        chance, prior, _ = estimate(own)
        weights[f"{kind}"] = math.log(prior / (1 - prior))
        yes, no = (sum(x * r["n"] for x, r in zip(side, own)) for side in (chance, [1 - c for c in chance]))
        for name in (*VOTES, *SURFACE):
            for value in range(-1, 4):
                a = sum(c * r["n"] for c, r in zip(chance, own) if r[name] == value)
                b = sum((1 - c) * r["n"] for c, r in zip(chance, own) if r[name] == value)
                weights[f"{kind} {name} {value}"] = math.log((a + 1) / (yes + 5) * (no + 5) / (b + 1))
    return weights


def decided(annotations: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Keep base spans and the candidates the classifier accepts, in order of start, then kind."""
    table = F.create_map(*[F.lit(x) for item in (weights or {"": 0.0}).items() for x in item])
    look = lambda *parts: F.coalesce(F.try_element_at(table, F.concat_ws(" ", *parts)), F.lit(0.0))

    def odds(c: Column) -> Column:
        kind = c["kind"].cast("string")
        return sum((look(kind, F.lit(name), c[name].cast("string")) for name in (*VOTES, *SURFACE)), look(kind))

    kept = F.filter("_spans", lambda c: F.when(c["base"], True).otherwise(odds(c) > 0))
    ordered = F.array_sort(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))))
    return annotations.withColumn("_spans", ordered)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, from decided rows."""
    base = spans.withColumn("_base", F.filter("_spans", lambda s: s["base"]))
    counts = [F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return base.select("doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def masked(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; overlapping spans as one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.get(tags, s["kind"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole)))

    found = decided(annotated(docs, text), weights)
    replaced = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, finish)).otherwise(F.col(text))
    return found.withColumn(text, replaced).drop("_spans")
