"""Near-duplicate classes, substring and line removal against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import ODD, prose

from slotward.llm import common, line_dedup, minhash, substring_dedup, suffix


def shingles(text):
    words = [w.lower() for w in re.findall(r"[^\W_]+", text or "")]
    if not words:
        return None
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def overlap(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union


def brute_classes(rows):
    bags = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def partition(labels):
    groups = collections.defaultdict(set)
    for i, label in enumerate(labels):
        groups[label].add(i)
    return {frozenset(g) for g in groups.values()}


def near_copies():
    rng, rows = random.Random(3), []
    for family in range(12):
        base = prose(family, 120)
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows.append((len(rows), "tick tock " * 200))
    rows.append((len(rows), "tick tock " * 190))
    rows.append((len(rows), "tick tock " * 20))
    return rows


def test_near_duplicates_equal_brute_force(frame):
    rows = [*near_copies(), *[r for r in ODD if r[0] is not None]]
    found = {}
    ids = [i for i, _ in rows]
    for r in minhash.classes(frame(rows, odd=False)).collect():
        found.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert set(found) == set(ids)
    single = [k for k, i in enumerate(ids) if ids.count(i) == 1]
    labels = brute_classes(rows)
    assert partition([labels[k] for k in single]) == partition([next(iter(found[ids[k]])) for k in single])
    for i, classes in found.items():
        assert all(c <= i for c in classes)


def test_copies_without_words_share_a_class(frame):
    texts = ["\U0001f600 \U0001f600", "\U0001f600 \U0001f600", "\U0001f600", "!?", "!?", "!?", "", "", " \n", " \n", None, None, "one two", "one, two"]
    found = sorted(minhash.classes(frame(list(enumerate(texts)), odd=False)).collect())
    assert [r["class_id"] for r in found] == [0, 0, 2, 3, 3, 3, 6, 6, 8, 8, 10, 11, 12, 12]
    assert [r["class_size"] for r in found] == [2, 2, 1, 3, 3, 3, 2, 2, 2, 2, 1, 1, 2, 2]
    kept = minhash.deduplicated(frame(list(enumerate(texts)), odd=False)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 3, 6, 8, 10, 11, 12]


def test_deduplicated_keeps_one_row_of_every_class(frame):
    rows = near_copies()
    kept = [(r["doc_id"], r["text"]) for r in minhash.deduplicated(frame(rows)).collect()]
    labels = brute_classes(rows)
    want = {min(i for i, other in enumerate(labels) if other == label) for label in labels}
    assert sorted(i for i, _ in kept if i is not None and i < 900) == sorted(want)
    assert kept.count((904, "a")) == 1 and {(906, "same id one"), (906, "same id two"), (None, None), (901, "")} <= set(kept)


def test_registers_estimate_weighted_overlap():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 2**62, 60, dtype=np.uint64)
    one, two = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    truth = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    owner = np.repeat([0, 1], 60)
    hits = []
    for turn in range(40):
        marks = minhash.signatures(owner, np.tile(minhash.mixed(keys + np.uint64(turn)), 2), np.r_[one, two], 2)
        hits.append((marks[0] == marks[1]).mean())
    assert abs(np.mean(hits) - truth) < 0.03


def test_rest_finds_links_that_leaders_miss(spark, frame):
    """The prefix rule alone finds every pair of different classes."""
    rows = near_copies()
    coded = minhash.coded(frame(rows, odd=False)).dropDuplicates(["node"])
    elements = coded.mapInArrow(minhash._elements, "node binary, elements array<long>")
    members = coded.selectExpr("node", "node as component")
    found = minhash.verified(minhash._rest(members, elements, 0.8), elements, 0.8)
    classes = common.components(found)
    sizes = sorted(r["count"] for r in classes.groupBy("component").count().collect())
    texts = {}
    for label, (_, text) in zip(brute_classes(rows), rows, strict=True):
        texts.setdefault(label, set()).add(text)
    assert sizes == sorted(len(t) for t in texts.values() if len(t) > 1)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1080)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(1000, 1080)}) == 1
    assert len(set(found.values())) == 2
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(letters)
    for n in [1, 2, 3, 20, 70]:
        for _ in range(30):
            text = bytes(97 + rng.randrange(letters) for _ in range(n))
            text += b"\xff" + text[: n // 2]
            order = suffix.suffix_array(np.frombuffer(text, np.uint8))
            want = sorted(range(len(text)), key=lambda i: text[i:])
            assert order.tolist() == want
            shared = suffix.common_prefixes(np.frombuffer(text, np.uint8), order).tolist()
            for k in range(1, len(want)):
                a, b = text[want[k - 1] :], text[want[k] :]
                assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_removed(texts):
    count = collections.Counter()
    for t in texts:
        raw = (t or "").encode()
        count.update(raw[i : i + 200] for i in range(len(raw) - 199))
    out = []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("segments", [1000, 2])
def test_substring_removal_equals_brute_force(frame, monkeypatch, segments):
    passage, other = " ".join(prose(1, 45)), " ".join(prose(2, 26))
    rows = [(i, " ".join([*prose(100 + i, 30), passage if i % 2 else other, *prose(200 + i, 20)])) for i in range(14)]
    rows += [(20, "é" * 150), (21, "a" * 600), (22, "abcd " * 60), (23, "abcd " * 90), (24, "x" * 199), (25, rows[1][1][40:300]), (26, rows[0][1]), (27, None)]
    docs = frame([*rows, *ODD], odd=False)
    monkeypatch.setattr(substring_dedup.spans, "__defaults__", (segments, substring_dedup.BROADCAST_ROWS))
    got = collections.Counter(tuple(r) for r in substring_dedup.report(docs).collect())
    want = collections.Counter((i, *x) for (i, _), x in zip([*rows, *ODD], brute_removed([t for _, t in [*rows, *ODD]]), strict=True))
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.cleaned(docs).filter("doc_id < 30").collect()}
    assert hashlib.sha256(kept[1].encode()).hexdigest() == brute_removed([t for _, t in [*rows, *ODD]])[1][3]


def brute_lines(rows):
    """Lines that go from each row, by a dictionary of all units in order of rank."""
    plain = lambda v: " ".join(re.split(r"[ \t\r\x0b\f]+", v)).strip(" ").lower()
    occurrences = []
    for n, (i, text) in enumerate(rows):
        run = []
        for k, line in enumerate([*(text or "").split("\n"), ""]):
            if plain(line):
                occurrences.append((i is None, i or 0, k, plain(line), n, [k]))
                run.append((k, plain(line)))
                continue
            if len(run) > 1:
                occurrences.append((i is None, i or 0, run[0][0], " ".join(v for _, v in run), n, [k for k, _ in run]))
            run = []
    seen, gone = {}, [set() for _ in rows]
    for *_, unit, n, lines in sorted(occurrences):
        if seen.setdefault(unit, rows[n]) is not rows[n] or (unit, n) in seen:
            gone[n].update(lines)
        seen[unit, n] = True
    return gone


@pytest.mark.parametrize("hot", [1000, 2])
def test_line_removal_equals_brute_force(frame, monkeypatch, hot):
    monkeypatch.setattr(line_dedup.removals, "__defaults__", (1, hot, line_dedup.BROADCAST_ROWS))
    shared = "this line of some more words is Shared  by all"
    rows = [(i, f"own line number {i} with words {i}\n{shared if i % 2 else shared.lower()}\nshort line\n\n \t\nend {i}\n") for i in range(9)]
    rows += [(20, f"{shared}\n{shared}"), (21, "short line"), (22, "wrapped passage\nof several\nlines\n\nrest"), (23, "wrapped\r\npassage OF several lines"), (24, "wrapped passage of several lines")]
    rows += [(25, "long line " * 200_000 + "\nshort line"), (904, "x")]
    docs = frame(rows).withColumn("_removed", F.lit("own")).withColumn("kept", F.lit(1)).withColumn("key", F.lit(2))
    every = [*rows, *[r for r in ODD if r[0] not in (904, 906)]]
    got = collections.defaultdict(list)
    for r in line_dedup.report(docs).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows) + len(ODD)
    for (i, text), gone in zip(every, brute_lines(every), strict=True):
        at, spans, left = 0, [], []
        for k, line in enumerate((text or "").split("\n")):
            if k in gone:
                spans.append(f"{at}:{at + len(line)}")
            else:
                left.append(line)
            at += len(line) + 1
        want = ("\n".join(left), ",".join(spans), len(spans))
        found = {(r["n_chars"], r["kept_sha256"], r["spans"], r["n_spans"]) for r in got[i]}
        if i == 904:
            continue
        assert (len(want[0]), hashlib.sha256(want[0].encode()).hexdigest(), *want[1:]) in found
    kept = {r["doc_id"]: r for r in line_dedup.cleaned(docs).collect()}
    assert kept[0]["text"] == rows[0][1] and "hared" not in kept[3]["text"] and kept[20]["text"] == "" and kept[23]["text"] == "" and kept[24]["text"] == ""
    assert kept[3]["_removed"] == "own" and kept[3].asDict().keys() == set(docs.columns)
    assert line_dedup.cleaned(docs, min_words=3).filter("doc_id = 21").first()["text"] == "short line"


def test_planted_passages_are_caught_and_clean_documents_stay(frame):
    """Passages of over 50 words as whole lines, as wrapped paragraphs and among other lines."""
    passages = [prose(900 + k, 60) for k in range(8)]

    def wrapped(words, n):
        return "\n".join(" ".join(words[a : a + n]) for a in range(0, len(words), n))

    rows, planted = [], set()
    for i in range(160):
        own = [" ".join(prose(10_000 + 9 * i + k, 12)) for k in range(4)]
        if i % 2:
            planted.add(i)
            own.insert(2, "\n" + wrapped(passages[i % 8], (60, 20, 13, 7)[i // 2 % 4]) + "\n")
        rows.append((i, "\n".join(own)))
    got = {r["doc_id"]: r for r in line_dedup.report(frame(rows, odd=False)).collect()}
    later = {i for i in planted if i >= 16}
    caught = {i for i in later if got[i]["n_removed"] > 300}
    assert len(caught) >= 0.9 * len(later)
    assert all(got[i]["n_spans"] == 0 and got[i]["n_chars"] == len(rows[i][1]) for i in range(160) if i not in planted)


def test_empty_tables(frame):
    none = frame([], odd=False)
    assert minhash.classes(none).count() == 0 and minhash.deduplicated(none).count() == 0
    assert substring_dedup.report(none).count() == 0 and line_dedup.report(none).count() == 0
