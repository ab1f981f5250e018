"""Operators that judge rows on their own, against brute force, held-out accuracy and exact round trips."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from samples import ODD, prose

from slotward.llm import chat, common, decontamination, pii, quality, segmentation, token_counts, toxicity

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            hit, digits = m.group(), re.sub("[^0-9]", "", m.group())
            fine = (True, k == 1 and all(int(p) <= 255 for p in hit.split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[k]
            if fine:
                found.append((m.start(), k, m.end()))
    return sorted(found)


PII_TEXTS = [
    "a@b.c.d_x@y.z q@@w.e a@b@c.d 1.2.3.4.5.6.7.8 é+1 (017) 555-7713", "999.1.1.1 0001.002.3.255 4111 1111-1111 1111 +4111111111111111",
    "😀 4111111111111111 😀a@b.co,+1 234 567 890", "bob (at) foo (dot) com or call 555-123-4567", "x" * 3000 + "@" + "1" * 3000, "a@b.co " * 200,
    "card 4304158793483665, host 10.0.0.1, mail me@x.org", "+1 2", "1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "1.2.3.4@x.y +12345678901234567",
]


def test_base_spans_equal_brute_force(frame):
    rows = [*enumerate(PII_TEXTS), *ODD]
    spans = pii.annotated(frame(rows, odd=False))
    got = pii.report(pii.decided(spans, pii.fit(pii.patterns(spans)))).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, text in rows:
        base = base_spans(text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want[(i, *[sum(k == n for _, k, _ in base) for n in range(4)], hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        kinds = [s.split(":") for s in r["spans"].split(",") if s]
        assert kinds == sorted(kinds, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))


def test_masking_replaces_whole_spans(frame):
    docs = frame([(1, PII_TEXTS[2]), (2, None), (3, "no data")], odd=False)
    kept = {r["doc_id"]: r["text"] for r in pii.masked(docs, {}).collect()}
    assert kept == {1: "😀 [CARD] 😀[EMAIL],[PHONE]", 2: None, 3: "no data"}


def test_expectation_maximisation_trusts_agreeing_labelers():
    surface = {"before": 2, "after": 2, "length": 1}
    rows = [
        {"kind": 0, "shape": 1, "gazetteer": 1, "context": 1, "edges": 1, "n": 500, **surface},
        {"kind": 0, "shape": 0, "gazetteer": 0, "context": -1, "edges": 0, "n": 500, **surface},
        {"kind": 0, "shape": -1, "gazetteer": 1, "context": 1, "edges": 1, "n": 5, **surface},
    ]
    w = pii.fit(rows)
    odds = lambda r: w["0"] + sum(w[f"0 {n} {r[n]}"] for n in (*pii.VOTES, *pii.SURFACE))
    assert odds(rows[0]) > 0 > odds(rows[1]) and odds(rows[2]) > 0
    assert pii.fit([]) == {}


def test_expectation_maximisation_never_loses_likelihood():
    rng = random.Random(5)
    for _ in range(20):
        # The context labeler votes against what the others vote for.
        rows = [
            {"shape": x, "gazetteer": y, "context": 1 - x if rng.random() < 0.8 else x, "edges": rng.choice([0, 1, -1]), "n": rng.randint(1, 900)}
            for x in (-1, 0, 1) for y in (-1, 0, 1)
        ]
        rows = [{**r, "context": max(-1, min(1, r["context"]))} for r in rows]
        chance, prior, history = pii.estimate(rows, 40)
        assert all(b >= a - 1e-7 * abs(a) for a, b in zip(history, history[1:]))
        assert 0 < prior < 1 and all(0 <= c <= 1 for c in chance)


def test_added_spans_are_personal_data(frame):
    people = [f"{n}{k}" for k in range(12) for n in ("ana", "joe")]
    good = [f"write to {n} (at) site{k} (dot) org today" for k, n in enumerate(people)]
    good += [f"call me, phone 555-{k + 200}-{k + 4100}, any time" for k in range(24)]
    base = [f"mail {n}@site.org or phone +1 202 555 {k + 4100}" for k, n in enumerate(people)]
    bad = [f"order number 555-{k + 200}-{k + 4100}, version {k}.2.1" for k in range(24)]
    texts = [*good, *base, *bad]
    spans = pii.annotated(frame(list(enumerate(texts)), odd=False))
    rows = pii.report(pii.decided(spans, pii.fit(pii.patterns(spans)))).collect()
    counts = ("n_email", "n_ip", "n_card", "n_phone")
    added = {r["doc_id"] for r in rows if len([x for x in r["spans"].split(",") if x]) > sum(r[c] for c in counts)}
    right = len(added & set(range(len(good))))
    assert right >= 0.9 * len(good) and right >= 0.9 * len(added)


def test_running_sums(spark):
    steps = list(range(1, 300))
    got = spark.createDataFrame([(steps,)], "s array<long>").select(common.running("s").alias("r")).first()["r"]
    assert got == np.cumsum(steps).tolist()


def test_toxicity_on_held_out_rows(spark, sf):
    docs, labels = (common.table(spark, sf.replace("0.001", "0.1"), name) for name in ("documents", "labels"))
    found = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
    held = [(found[i]["score"], y) for i, y in truth.items() if found[i]["held_out"]]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    ranks = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert ranks > 0.93


def test_toxicity_generalises_to_misspellings():
    texts = [" ".join(prose(i, 20)) + (" you scumbag" if i % 3 == 0 else " you friend") for i in range(150)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(150)])
    import pandas as pd

    scores = toxicity.scored(pd.Series([" ".join(prose(999, 20)) + end for end in (" you scumbagg", " you friendd")]), model, {})
    assert scores[0] > 0.3 > scores[1]


def test_toxicity_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.detect(frame([]), none).collect()
    assert len(found) == len(ODD) and all(r["score"] < 0.01 and r["predicted"] == 0 for r in found)
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.detect(frame([(1, "x")]), one).count() == len(ODD) + 1


def test_quality_measures_equal_brute_force(frame):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "bb", "c#", "dd\n", "é|", " x"]) for _ in range(rng.randint(0, 90)))) for i in range(40)]
    rows += [(50, " ".join(prose(1, 200))), (51, "word " * 100), (52, "#$% " * 80 + " ".join(prose(2, 90)))]
    got = quality.judged(frame(rows)).collect()
    assert len(got) == len(rows) + len(ODD)
    want = collections.Counter()
    for i, text in [*rows, *ODD]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        seen = collections.Counter(tuple(words[k : k + 3]) for k in range(n - 2))
        again = {k + j for k in range(n - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [v for v in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", v)]
        failed = n < 50 or 100 * len(again) > 50 * n
        want[(i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed)] += 1
    assert collections.Counter((r["doc_id"], *(r[c] for c in quality.BASE), r["base_failed"]) for r in got) == want
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[50] and not kept[51] and not kept[52] and not any(r["kept"] and r["base_failed"] for r in got)


def test_rule_order_never_changes_a_verdict():
    texts = [" ".join(prose(i, 60)) + "#| " * (i % 30) for i in range(60)]
    measured = [quality.measure(t) for t in texts]
    assert sorted(quality.ordered(texts)) == sorted(quality.RULES) and quality.ordered([]) == list(quality.RULES)
    for names in (list(quality.RULES), list(quality.RULES)[::-1]):
        verdicts = [not any(quality.RULES[n](m) for n in names) for m in measured]
        assert verdicts == [not any(rule(m) for rule in quality.RULES.values()) for m in measured]


def test_token_counts_equal_the_library(frame):
    from tokenizers import Tokenizer

    texts = ["a<|endoftext|>b  <|endoftext|> don't  \n\n x y 梦 ünï 12,3 \r\n", "<|endoftext|>", "  ", "\x1c\x1d a\x85b", "I’m “x” … — ½ ٣٤ ​ z", "it's  \n  DON'T 'll'", "a　b", "\t\tx \t y", "word " * 600]
    rows = [*enumerate(texts), *((100 + i, " ".join(prose(i, 50))) for i in range(30))]
    library = Tokenizer.from_file(BYTES)
    got = token_counts.counted(frame(rows), BYTES).collect()
    want = collections.Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*rows, *ODD])
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def segmentations(vocabulary, unit):
    if not unit:
        return [((), 1.0)]
    out = []
    for n in range(1, len(unit) + 1):
        at = int(vocabulary.find(np.array([vocabulary._hash(unit[:n])], np.uint64))[0])
        if at >= 0:
            out += [((int(vocabulary.ids[at]), *rest), float(vocabulary.weights[at]) * w) for rest, w in segmentations(vocabulary, unit[n:])]
    return out


def test_samples_follow_the_distribution_without_replacement():
    vocabulary = segmentation.Vocabulary(PIECES)
    tables = segmentation.Tables(vocabulary)
    full = {a + b: x * y for a, x in segmentations(vocabulary, "▁the") for b, y in segmentations(vocabulary, "▁cat")}
    total = sum(full.values())
    full = {k: v / total for k, v in full.items()}
    n = 3000
    drawn = segmentation.sampled(tables, ["the cat"] * n, np.arange(n, dtype=np.uint64), 2)
    assert all(tuple(r[0][0]) != tuple(r[1][0]) and r[0][2] > r[1][2] for r in drawn)
    first = collections.Counter(tuple(r[0][0].tolist()) for r in drawn)
    second = collections.Counter(tuple(r[1][0].tolist()) for r in drawn)
    for path in sorted(full, key=full.get)[-4:]:
        p = full[path]
        q = sum(full[o] * p / (1 - full[o]) for o in full if o != path)
        assert abs(first[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) and abs(second[path] / n - q) < 5 * math.sqrt(q * (1 - q) / n)
        assert all(abs(r[0][1] - math.log(full[tuple(r[0][0].tolist())])) < 1e-9 for r in drawn[:50])
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in r) for r in drawn]) - 1) < 0.1


def test_segmentations_decode_to_the_text(frame):
    rows = [(1, "  two  spaces\nnew line 😀 é梦"), (2, "a"), (3, "x" * 3000), (4, " ".join(prose(1, 100))), (5, "▁mark")]
    docs = frame(rows)
    found = segmentation.segmentations(docs, PIECES, k=3)
    back = segmentation.decoded(found, PIECES).collect()
    texts = dict(rows)
    assert all(r["text"] == texts[r["doc_id"]].replace("▁", " ") for r in back if r["doc_id"] in texts)
    ids = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in back if r["doc_id"] in texts)
    assert max(ids.values()) == 1 and {r["doc_id"] for r in back} == {i for i, _ in [*rows, *ODD]}
    digests = segmentation.digests(docs, PIECES, k=3).collect()
    assert all(r["round_trip"] and 0 <= r["inclusion"] <= 1 for r in digests) and len(digests) == len(back)
    again = {(r["doc_id"], r["sample"], r["ids_md5"]) for r in segmentation.digests(docs.repartition(3), PIECES, k=3).collect()}
    assert again == {(r["doc_id"], r["sample"], r["ids_md5"]) for r in digests}
    assert segmentation.digests(frame([], odd=False), PIECES).count() == 0


BENCH = "item_id long, text string"


def test_toxicity_trains_outside_the_driver(spark, frame, monkeypatch):
    rows = [(i, f"good words number{i % 7} here" if i % 3 else f"vile awful words number{i % 7}") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(frame(rows), labels, 100).collect()
    wanted = toxicity.fit([r["text"] for r in sample], [r["toxic"] for r in sample])
    fit, driver = toxicity.fit, os.getpid()
    monkeypatch.setattr(toxicity, "fit", lambda *rows: fit(*rows) if os.getpid() != driver else pytest.fail("trained in the driver"))
    got = toxicity.train(frame(rows), labels, 100)
    assert got.bias == wanted.bias and (got.logit == wanted.logit).all() and (got.share == wanted.share).all() and wanted.logit.any()


def test_decontamination_finds_items_and_new_parameters(spark, frame):
    item = "If Tom has 12 apples and Anna has 7 kg of rice, then Tom gives 3 apples to Anna today."
    changed = "so, if Bob has 99 apples and Eve has 8 lb of rice, then Bob gives 5 apples to Eve today."
    clash = "so, if Bob has 99 apples and Eve has 8 lb of rice, then Zed gives 5 apples to Bob today."
    plain = " ".join(w.rstrip("0123456789") + "x" for w in prose(7, 30))
    items = spark.createDataFrame([(1, item), (2, plain), (3, plain), (4, "too short"), (5, None), (6, "five words are one window")], BENCH)
    rows = [(1, f"before {item} after"), (2, changed), (3, clash), (4, f"text {plain.upper()} end"), (5, " ".join(plain.split()[3:20])),
            (6, " ".join(plain.split()[3:12])), (7, "here five words are one window too"), (8, " ".join(prose(8, 200)))]
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated(frame(rows), items).collect() if r["doc_id"] in dict(rows)}
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: [2], 6: [], 7: [6], 8: []}
    left = decontamination.clean(frame(rows).withColumnRenamed("source", "tokens"), items)
    assert left.columns == ["doc_id", "text", "lang", "tokens", "n_chars"]
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] in dict(rows)) == [3, 6, 8] and left.count() == 3 + len(ODD)
    shuffled = decontamination.hits(frame(rows), items, broadcast_rows=0)
    assert {(r["doc_id"], r["item_id"]) for r in shuffled.collect()} == {(1, 1), (2, 1), (4, 2), (5, 2), (7, 6)}
    nothing = spark.createDataFrame([], BENCH)
    assert decontamination.clean(frame(rows), nothing).count() == len(rows) + len(ODD)


def _found(frame, spark, items, texts):
    """Items found in every text, by its place in the list."""
    bench = spark.createDataFrame(list(enumerate(items, 1)), BENCH)
    found = decontamination.contaminated(frame(list(enumerate(texts)), odd=False), bench).collect()
    return [r["item_ids"] for r in sorted(found, key=lambda r: r["doc_id"])]


def _letters(seed, n):
    """Words without digits, all different."""
    return [f"{chr(97 + seed)}{w.rstrip('0123456789')}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k, w in enumerate(prose(seed, n))]


def test_decontamination_finds_edited_items_at_every_offset(spark, frame):
    item = _letters(1, 21)
    edited = [*item[:10], "else", *item[11:]]
    texts = [" ".join(_letters(2, k) + edited + _letters(3, 20)) for k in range(18)]
    assert _found(frame, spark, [" ".join(item)], texts) == [[1]] * 18


def test_decontamination_clash_breaks_only_its_run(spark, frame):
    w = _letters(4, 60)
    same = " ".join([*w[:10], "5", *w[10:40], "5", *w[40:]])
    changed = " ".join([*w[:10], "5", *w[10:40], "6", *w[40:]])
    near = [*w[:8], "3", *w[8:13], "4", *w[13:20]]
    merged = " ".join(["7" if x in "34" else x for x in near])
    many = " ".join(x for k in range(0, 60, 3) for x in [*w[k : k + 3], str(k)])
    other = " ".join(x for k in range(0, 60, 3) for x in [*w[k : k + 3], str(k // 30)])
    items, texts = [same, " ".join(near), many], [f"so {changed} then", f"so {merged} then", f"so {other} then", f"so {same} then"]
    assert _found(frame, spark, items, texts) == [[1], [2], [], [1]]


def test_decontamination_finds_items_in_other_surroundings(spark, frame):
    first = "What is the capital of the river country"
    names = "we asked Alice and then Bob again"
    mark = "a share of % and ten more"
    unit = "m of rope are left today"
    items, texts = [first, names, mark, unit], []
    for item in items:
        texts += [item, f"some words {item} end", f"there were 5 {item}; end", f"Ends. {item}"]
    wrapped = [names.replace(" ", blank) for blank in ("\n", "  ", "\r\n\t", "\u00a0")]
    assert _found(frame, spark, items, texts + wrapped) == [[i] for i in (1, 2, 3, 4) for _ in range(4)] + [[2]] * 4


def test_decontamination_finds_names_that_start_a_sentence(spark, frame):
    item = "Alice has 3 apples and buys 4 more apples today"
    other = "Bob has 5 apples and buys 7 more apples today"
    texts = [
        f"and so {other}", other, f"Some intro here. {other}", f"Some intro here.\n{other}", f'they wrote: "{other}"', f"(\u201c{other}\u201d)",
        item.lower(), "The box has 5 apples, it sells 7 more apples today", "Bob has 5 apples and buys 5 more apples today",
    ]
    assert _found(frame, spark, [item], texts) == [[1]] * 7 + [[], []]
    # Punctuation of the copy differs, so one position is a name here and a word there.
    item = "Carol walks slowly, nobody sees Dora near green water"
    texts = ["Emma walks slowly. Nobody sees Fred near green water", "emma walks slowly. Nobody sees Fred near green water"]
    assert _found(frame, spark, [item], texts) == [[1], []]


def _template_tokens(text):
    """(kind, value) of every word, from the text's characters: n number, p name, q name or word, w word."""
    text, found = re.sub(r"\s+", " ", text), []
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        word, before = m.group(), text[max(0, m.start() - 2) : m.start()]
        named = word[0].isupper() and word[1:].islower()
        if word.isdigit():
            kind = "n"
        elif named and re.fullmatch(r"[a-z0-9,;)] ", before):
            kind = "p"
        else:
            kind = "q" if named and word not in decontamination.STARTERS.split("|") else "w"
        found.append((kind, word.lower()))
    return found


def _meet(a, b):
    """Whether two tokens agree in some reading, with the pair of slot values if only slots agree."""
    kinds = {a[0], b[0]}
    if kinds <= {"w", "q"} and a[1] == b[1]:
        return True, None
    return (True, (a[1], b[1])) if kinds <= {"p", "q"} or kinds == {"n"} else (False, None)


def test_decontamination_equals_template_search(spark, frame):
    rng = random.Random(11)
    stock = ["Ann", "Ben", "The", "river", "stone", "garden", "likes", "sees"]

    def sentences(n):
        out = []
        for k in range(n):
            word = rng.choice([*stock, str(rng.randint(1, 9))])
            start = k == 0 or out[-1][-1] in '.:"'
            out.append((word[0].upper() + word[1:] if start else word) + rng.choice(["", "", "", "", ".", ",", ":", '"']))
        return " ".join(out)

    items = [sentences(n) for n in (5, 6, 7, 8, 9, 13, 14, 20, 5, 6)]
    swap = {"Ann": "Zoe", "Ben": "Max", "river": "River", "stone": "stone."}
    texts = []
    for item in items:
        moved = re.sub(r"[A-Za-z]+", lambda m: swap.get(m.group(), m.group()), item)
        texts += [f"{sentences(6)} {item} {sentences(6)}", f"{sentences(6)} {moved} {sentences(6)}", f"{sentences(4)}. {moved}", moved]
    texts += [sentences(400) for _ in range(10)]
    got, sure = _found(frame, spark, items, texts), 0
    for text, ids in zip(texts, got, strict=True):
        here = _template_tokens(text)
        for i, item in enumerate(items, 1):
            own = _template_tokens(item)
            size, starts = min(len(own), 8), set()
            firsts = [own, [("p" if own[0][0] in "qw" and item[0].isupper() and len(item.split()[0]) > 1 else own[0][0], own[0][1]), *own[1:]]]
            places, pairs = {}, set()
            for there in firsts:
                for at in range(len(here) - size + 1):
                    for k in range(len(there) - size + 1):
                        met = [_meet(there[k + x], here[at + x]) for x in range(size)]
                        if all(fine for fine, _ in met):
                            places.setdefault(at - k, {}).setdefault(at, set()).update(p for _, p in met if p)
            verdicts = []
            for by_place in places.values():
                if len(by_place) >= min(len(own), 13) - size + 1:
                    pairs = set().union(*by_place.values())
                    clear = len({p for p, _ in pairs}) == len(pairs) == len({p for _, p in pairs})
                    verdicts.append(True if clear else None)
            if None not in verdicts:  # clashing values are the subject of another test
                assert (i in ids) == bool(verdicts), (text, item)
                sure += bool(verdicts)
    assert sure >= 20


def test_decontamination_lists_every_window_in_every_reading_once(spark, frame):
    texts = ["Bob. Carl ran. Dave. Ann. Eve! " * 4, "we saw it. Kim sat down there. Tom and the others went home after that", "Bob. Ann", "no names in this text at all, none"]
    rows = decontamination.templates(frame(list(enumerate(texts)), odd=False))
    got = decontamination.windows(rows, ["doc_id"], F.array(F.lit(5), F.lit(8))).select("doc_id", "at", F.size("own"), "named").collect()
    wanted = []
    for r in rows.collect():
        for size in (5, 8):
            for at in range(len(r["tokens"]) - size + 1):
                may = sum(1 << k for k in range(size) if at + k in r["names"])
                wanted += [(r["doc_id"], at, size, bits) for bits in range(1 << size) if bits & may == bits]
    assert sorted(map(tuple, got)) == sorted(wanted) and len(wanted) > 1000


def test_decontamination_equals_window_search(spark, sf):
    """Whole items inside documents, found by plain word windows."""
    folder = sf.replace("0.001", "0.01")
    docs, items = common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark")
    got = {(r["doc_id"], i) for r in decontamination.contaminated(docs, items).collect() for i in r["item_ids"]}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    texts = {i: " " + " ".join(words(t)) + " " for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()}
    whole = {(d, i) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall() for d, text in texts.items() if " " + " ".join(words(t)[1:-1]) + " " in text}
    assert whole <= got and len(got) <= len(whole) + 3


def test_chat_rotation(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>"), (1, 3, "ann", None), (2, 0, "system", "x"), (None, 0, None, "lost"), (3, None, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    found = chat.rotated(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    whole = collections.defaultdict(str)
    for r in sorted(found, key=lambda r: r["start"]):
        key = (r["conv_id"], r["perspective"])
        assert r["start"] == len(whole[key]) and r["end"] == r["start"] + len(r["segment"])
        whole[key] += r["segment"]
        if r["is_target"]:
            assert whole[key][r["mask_start"] : r["mask_end"]].endswith(chat.CLOSE)
    assert set(whole) == {(1, "ann"), (1, "bob"), (3, "user"), (3, "assistant"), (None, "unknown")}
    assert whole[1, "bob"].count("<|im_start|>assistant\n") == 1 and whole[1, "bob"].count("user name=ann") == 2
    assert whole[1, "ann"].count("<|im_end|>") == 4 and whole[3, "assistant"].count("<|im_start|>assistant\nb") == 2
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op5_chat_rotation", "op9_line_dedup"])
def test_sql(spark, sf, name):
    import compare

    from slotward.llm import queries

    problem, _ = compare.difference(queries.QUERIES[name](spark, sf), compare.connect(sf), queries.ORACLES[name])
    assert problem is None


def test_forgetting_rare_units_changes_no_sample(monkeypatch):
    vocabulary = segmentation.Vocabulary(PIECES)
    texts = [" ".join(prose(k, 40)) + "  two  blanks ▁mark é " + " ".join(prose(k // 3, 20)) for k in range(30)]
    seeds = np.arange(30, dtype=np.uint64)

    def drawn(edges):
        monkeypatch.setattr(segmentation, "EDGES", edges)
        tables, found = segmentation.Tables(vocabulary), []
        for a in range(0, 30, 5):
            found += segmentation.sampled(tables, texts[a : a + 5], seeds[a : a + 5], 2)
        return [[(ids.tolist(), round(p, 9), round(g, 9)) for ids, p, g, _ in rows] for rows in found]

    whole = drawn(1 << 40)
    assert whole == drawn(2000) == drawn(1)
    assert all(vocabulary.decode(ids) == t.replace("▁", " ") for rows, t in zip(whole, texts) for ids, *_ in rows)


def test_rows_of_ids_are_held_against_their_texts_together():
    vocabulary = segmentation._vocabulary(PIECES, 1.0, 0)
    assert segmentation._vocabulary(PIECES, 1.0, 0) is vocabulary  # read once per worker
    texts = ["two words", "", "\u00e9t\u00e9 \U0001f600 end", "a  b "]
    rows = [own[0][0] for own in segmentation.sampled(segmentation.Tables(vocabulary), texts, np.arange(4, dtype=np.uint64), 1)]
    assert vocabulary.decode_to(rows, texts) == [True] * 4 == [vocabulary.decode(r.tolist()) == t for r, t in zip(rows, texts)]
    assert vocabulary.decode_to(rows[::-1], texts) == [False] * 4 and vocabulary.decode_to([], []) == []
