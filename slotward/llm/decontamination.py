"""Benchmark decontamination by template windows, DataFrame functions only.

Benchmark items and documents are brought to templates: numbers, units after a number and capitalised names
inside a sentence become typed slots, the rest lower-case words. A capitalised word elsewhere (first in a text, after
a full stop, quotation mark or bracket) may be a name or a word, unless it is one of STARTERS: it is read both ways,
in items and in documents, so a window has one hash per combination of readings of such words. Of several readings
that agree at one place the one with fewest slots counts, which takes equal words for words. Runs of white space count
as one blank. What an item's first token becomes depends on what stands before it, so items are searched for as they
start a text and as they follow a word or number. Windows of WINDOW template tokens are joined by hash. Hits of one item on one diagonal (document position minus item position) belong together; slot values
must map one to one, so a question asked again with other numbers or names is found, and text that only shares
the skeleton with clashing values is not. A document is contaminated by an item if as many windows of one
diagonal agree as HELD tokens have (all windows of a shorter item).

A clash breaks only windows around it. A value that differs from the item's and clashes on the diagonal is doubtful;
an equal value never is. What counts are the windows without doubtful values, or else so many consecutive windows
whose own values map one to one and hold at most one doubtful value.

A first pass looks at every window of a document, without slots: the agreeing windows of an edited item need not
be consecutive. The documents it finds are then searched with slots. The item windows and the keys of those
documents are broadcast if there are at most `broadcast_rows` of them (counted first) and joined by shuffle
beyond that. Document windows are never grouped unless they hit.

Defined cases: null texts are empty; items of fewer than LEAST tokens are not searched for; items of LEAST to
WINDOW - 1 tokens are one window of their own length; equal items are reported under their least item_id;
repeated rows of `docs` get equal answers, rows with one doc_id and different texts their own; null ids are kept.
Extra columns of `docs` pass through `clean` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import common

WINDOW = 8
HELD = 13
LEAST = 5
BROADCAST_ROWS = 1_000_000
# Unit words that may follow a number.
UNITS = (
    "%|°c|°f|mm|cm|m|km|in|ft|yd|mi|inch|inches|foot|feet|yards?|miles?|met(?:er|re)s?|kilomet(?:er|re)s?|"
    "mg|g|kg|t|lb|lbs|oz|grams?|kilograms?|tons?|pounds?|ounces?|ml|cl|l|lit(?:er|re)s?|gallons?|"
    "ms|s|sec|secs|seconds?|min|mins|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|"
    "usd|eur|gbp|dollars?|euros?|cents?|percent|mph|kmh|km/h|hz|khz|mhz|ghz|w|kw|v|kb|mb|gb|tb"
)
# Words that start a sentence and are no names.
STARTERS = (
    "A|About|After|All|Also|Although|An|And|Any|Are|As|At|Because|Before|Both|But|By|Can|Could|Did|Do|Does|Each|Every|"
    "Find|Finally|First|For|From|Given|Has|Have|He|Her|Here|His|How|However|If|In|Is|It|Its|Let|Many|More|Most|My|No|"
    "Not|Now|Of|On|One|Or|Our|Over|She|Should|Since|So|Some|Such|Suppose|That|The|Their|Then|There|These|They|This|"
    "Those|To|Two|Under|Until|Was|We|Were|What|When|Where|Which|While|Who|Whose|Why|Will|With|Would|Yes|You|Your"
)
MARK = "\u0001"
NAME, MAYBE = f"{MARK}p", f"{MARK}q"


def tokens(text: Column) -> Column:
    """Template tokens; a slot is MARK, its type (p name, q name or word, n number, u unit) and its value."""
    s = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, " ")).otherwise(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(s, r"[\s\p{Z}&&[^ ]][\s\p{Z}]*+| [\s\p{Z}]++", " ")
    s = F.regexp_replace(s, r"\p{Lu}(?<=[\p{Ll}0-9,;)] .)\p{Ll}++", f" {NAME}$0 ")
    s = F.regexp_replace(s, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?!(?:{STARTERS})(?![\p{{L}}\p{{N}}]))\p{{Lu}}\p{{Ll}}++", f" {MAYBE}$0 ")
    # Without digits there are no numbers and units, and the second split equals the first.
    plain = F.split(s, rf"[^\p{{L}}\p{{N}}{MARK}]+")
    s = F.regexp_replace(s, r"[0-9]++(?:[.,:/][0-9]++)*+", f" {MARK}n$0 ")
    s = F.regexp_replace(s, rf"(?i)(?<={MARK}n[0-9.,:/]{{1,24}}) {{1,2}}({UNITS})(?![\p{{L}}\p{{N}}])", f" {MARK}u$1 ")
    slotted = F.split(s, rf"(?:[^\p{{L}}\p{{N}}{MARK}.,:/%°]|(?<!{MARK}u)[%°]|(?<![0-9])[.,:/]|[.,:/](?![0-9]))+")
    pieces = F.when(F.col("_digits"), slotted).otherwise(plain)
    return common.lowered(F.array_remove(pieces, ""))


def _is(token: Column, mark: str) -> Column:
    return F.startswith(token, F.lit(mark))


def _code(token: Column) -> Column:
    """Hash of a token's template; what may be a name is taken for a word."""
    slot = F.when(_is(token, MAYBE), F.substring(token, 3, F.length(token))).otherwise(F.substring(token, 1, 2))
    return F.when(_is(token, MARK), F.xxhash64(slot)).otherwise(F.xxhash64(token))


def _shifted(bits: Column, by: Column) -> Column:
    return F.call_function("shiftleft", bits, by)


def _following() -> Column:
    """Bit k is set if the token k + 1 places after `place` may be a name; `names` from the `nth` on follow it."""
    def bit(k: int) -> Column:
        at = F.get("names", F.col("nth") + k)
        return F.when(at < F.col("place") + WINDOW, _shifted(F.lit(1), at - F.col("place") - 1)).otherwise(0)

    return reduce(lambda x, y: x.bitwiseOR(y), [bit(k) for k in range(WINDOW - 1)])


def _slots(own: str, named: str) -> Column:
    """The slots of a window's tokens: its names, numbers and units, what may be a name only where it is read as one."""
    def slot(token: Column, k: Column) -> Column:
        name = F.when(F.col(named).bitwiseAND(_shifted(F.lit(1), k)) != 0, F.concat(F.lit(NAME), F.substring(token, 3, F.length(token))))
        return F.when(_is(token, MAYBE), name).when(_is(token, MARK), token)

    return F.array_compact(F.transform(own, slot))


def windows(rows: DataFrame, keep: list[str], sizes: Column) -> DataFrame:
    """`keep`, at, window, own (its tokens) and named (bits of those read as names) of all windows of `sizes` tokens in all readings of `templates`.

    Windows are rows from the start, without array functions: those without names (`place` is -1), and for each
    place that may be a name and each choice of names among the seven tokens after it, the windows that hold all of
    these and in which the place is the first name. So every window is there once in every reading.
    """
    inner, place, n = ["tokens", "codes", *keep], F.col("place"), F.size("codes")
    found = rows.select(*inner, "names", F.posexplode(F.concat(F.array(F.lit(-1)), F.col("names"))).alias("nth", "place"))
    found = found.withColumn("some", F.when(place < 0, 0).otherwise(_following()))
    subsets = F.filter(F.sequence(F.lit(0), F.col("some")), lambda bits: bits.bitwiseAND(F.col("some")) == bits)
    found = found.select(*inner, "place", F.explode(F.when(F.col("some") == 0, F.array(F.lit(0))).otherwise(subsets)).alias("more"))
    reach = F.when(F.col("more") == 0, 0).otherwise(F.length(F.bin("more")))
    found = found.select(*inner, "place", "more", F.explode(sizes).alias("size"))
    first = F.when(place < 0, 0).otherwise(F.greatest(F.lit(0), place + reach - F.col("size") + 1))
    last = F.when(place < 0, n - F.col("size")).otherwise(F.least(place, n - F.col("size")))
    found = found.withColumns({"first": first, "last": last}).filter("first <= last")
    found = found.withColumn("at", F.explode(F.sequence("first", "last")))
    # Bit k of `named`: token k of the window is read as a name.
    found = found.withColumn("named", F.when(place < 0, 0).otherwise(_shifted(F.col("more") * 2 + 1, place - F.col("at"))))
    name = F.xxhash64(F.lit(NAME))
    parts = [F.when(F.col("named").bitwiseAND(1 << k) != 0, name).otherwise(F.get("codes", F.col("at") + k)) for k in range(WINDOW)]
    parts = [part if k < LEAST else F.when(F.col("size") > k, part) for k, part in enumerate(parts)]
    return found.select(*keep, "at", F.xxhash64(*parts).alias("window"), F.slice("tokens", F.col("at") + 1, F.col("size")).alias("own"), "named")


def templates(df: DataFrame, text: str = "text") -> DataFrame:
    """Add tokens, their hashes as words (codes), and the places of those that may be names (names)."""
    found = df.withColumn("_digits", F.coalesce(F.col(text).rlike("[0-9]"), F.lit(False)))
    return _coded(found.withColumn("tokens", tokens(F.col(text))).drop("_digits"))


def _coded(df: DataFrame) -> DataFrame:
    names = F.array_compact(F.transform("tokens", lambda t, k: F.when(_is(t, MAYBE), k)))
    return df.withColumns({"codes": F.transform("tokens", _code), "names": names})


def item_templates(benchmark: DataFrame) -> DataFrame:
    """(item_id, tokens, codes, names) of the distinct items, as they start a text and as they follow a number."""
    after = benchmark.select("item_id", "text", F.concat(F.lit("1 "), F.coalesce("text", F.lit(""))).alias("_after"))
    after = templates(after, "_after").select("item_id", "text", F.slice("tokens", 2, F.size("tokens")).alias("_after"))
    both = templates(after).groupBy("tokens").agg(F.min("item_id").alias("item_id"), F.collect_set("_after").alias("_after"))
    ways = F.array_distinct(F.concat(F.array("tokens"), "_after"))
    return _coded(both.select("item_id", F.explode(ways).alias("tokens")))


def _sizes(items: DataFrame) -> list[int]:
    """Window lengths that the items need: WINDOW, and shorter ones for short items (at most three)."""
    short = items.filter(F.size("tokens").between(LEAST, WINDOW - 1)).select(F.size("tokens").alias("n")).distinct()
    return sorted({WINDOW} | {r["n"] for r in short.collect()})


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, item_tokens, needed, item_at, window, item_slots) of the items; needed: windows that must agree."""
    n = F.size("tokens")
    size = F.least(n, F.lit(WINDOW))
    needed = F.least(F.lit(HELD), n) - size + 1
    rows = items.filter(n >= LEAST).withColumns({"item_tokens": n, "needed": needed, "_size": size})
    found = windows(rows, ["item_id", "item_tokens", "needed", "_size"], F.array("_size"))
    names = [F.col("at").alias("item_at"), "window", _slots("own", "named").alias("item_slots")]
    return found.select("item_id", "item_tokens", "needed", *names).distinct()


def row_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_digest", F.xxhash64("text"))


def _candidates(rows: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """Keys of the rows of which any window is an item's."""
    spread = windows(templates(rows), ["doc_id", "_digest"], F.array(*map(F.lit, sizes)))
    return spread.join(wanted.select("window"), "window", "left_semi").select("doc_id", "_digest").distinct()


def _one_to_one(pairs: Column) -> Column:
    """Whether distinct pairs map values one to one."""
    return (F.size(F.array_distinct(pairs["here"])) == F.size(pairs)) & (F.size(F.array_distinct(pairs["there"])) == F.size(pairs))


def _doubtful(pairs: str) -> Column:
    """The pairs of different values that clash with another pair."""
    def clashes(p: Column) -> Column:
        return F.exists(pairs, lambda q: (p["there"] == q["there"]) != (p["here"] == q["here"]))

    return F.filter(pairs, lambda p: (p["there"] != p["here"]) & clashes(p))


def _run_agrees() -> Column:
    """Whether `needed` consecutive places are one to one with at most one doubtful pair."""
    def agrees(run: Column) -> Column:
        own = F.array_distinct(F.flatten(run["pairs"]))
        whole = F.element_at(run, -1)["at"] - F.element_at(run, 1)["at"] == F.col("needed") - 1
        return whole & _one_to_one(own) & (F.size(F.array_intersect(own, F.col("doubtful"))) <= 1)

    starts = F.sequence(F.lit(1), F.size("places") - F.col("needed") + 1)
    return F.exists(starts, lambda k: agrees(F.slice("places", k, F.col("needed"))))


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, _digest, item_id, windows) of every document row and item whose windows agree."""
    items = item_templates(benchmark)
    wanted, sizes = common.pinned(item_windows(items)), _sizes(items)
    wanted = common.bounded(wanted, broadcast_rows)
    rows = row_key(docs.select("doc_id", "text"))
    few = common.pinned(_candidates(rows, wanted, sizes)).toDF("_doc", "_found")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_digest") == F.col("_found"))
    rows = templates(rows.join(common.bounded(few, broadcast_rows), same, "left_semi"))
    spread = windows(rows, ["doc_id", "_digest"], F.array(*map(F.lit, sizes)))
    # Repeated rows would count twice: a window counts once per place.
    met = spread.join(wanted, "window").withColumns({"diagonal": F.col("at") - F.col("item_at"), "slots": _slots("own", "named")})
    pairs = F.transform("slots", lambda v, k: F.struct(v.alias("there"), F.get("item_slots", k).alias("here")))
    # Two lists of slots of one window have equal types by the template, so they zip. Places of repeated rows fall together.
    place = F.struct("at", F.size("slots").alias("n"), pairs.alias("pairs"))
    per = met.groupBy("doc_id", "_digest", "item_id", "item_tokens", "needed", "diagonal").agg(F.sort_array(F.collect_set(place)).alias("places"))
    least = F.filter("places", lambda p, k: (k == 0) | (F.get("places", k - 1)["at"] != p["at"]))
    per = per.withColumn("places", least).filter(F.size("places") >= F.col("needed")).withColumn("pairs", F.array_distinct(F.flatten("places.pairs")))
    per = per.withColumn("doubtful", F.when(_one_to_one(F.col("pairs")), F.array_except("pairs", "pairs")).otherwise(_doubtful("pairs")))
    clear = F.size(F.filter("places", lambda p: ~F.arrays_overlap(p["pairs"], F.col("doubtful"))))
    per = per.withColumn("windows", F.when(F.size("doubtful") == 0, F.size("places")).otherwise(clear))
    per = per.withColumn("windows", F.when((F.col("windows") < F.col("needed")) & _run_agrees(), F.col("needed")).otherwise(F.col("windows")))
    agreed = per.filter(F.col("windows") >= F.col("needed"))
    return agreed.groupBy("doc_id", "_digest", "item_id").agg(F.max(F.col("windows").cast("long")).alias("windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row's doc_id with the items found in it: contaminated, n_items, item_ids (ascending), windows."""
    found = hits(docs, benchmark).groupBy("doc_id", "_digest").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("windows").alias("windows"))
    found = found.withColumnRenamed("doc_id", "_doc").withColumnRenamed("_digest", "_found")
    rows = row_key(docs.select("doc_id", "text")).drop("text")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_digest") == F.col("_found")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return joined.select("doc_id", F.col("_found").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("windows", F.lit(0)).alias("windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item is found, all columns kept."""
    found = hits(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("_digest").alias("_found")).distinct()
    same = found["_doc"].eqNullSafe(docs["doc_id"]) & (found["_found"] == F.xxhash64(docs["text"]))
    return docs.join(found, same, "left_anti")
