"""Byte-level BPE by forced boundaries, and decoding.

A merge can only join two neighbouring bytes if some token of the vocabulary holds them side by side. Byte pairs
that no token holds are therefore certain cuts. A text is cut there and at the borders of its pre-tokens; the
fragments are encoded independently, each distinct one once per worker, and their ids are concatenated. Pre-token
borders come from classes of characters, which are asked of the library's own splitter, so that both agree on
every Unicode version. Texts are handled as UTF-8 bytes in slices of at most SLICE bytes; a longer text is divided
at places where a border cannot depend on the surroundings, so memory does not grow with a text's length beyond
its own bytes and ids. Nothing is shuffled, a lost task is simply run again.

Defined cases: null and empty texts have no ids and decode to the empty text; an added token inside a text is one
id, as the library treats it by default; repeated rows are encoded one by one; a null list of ids decodes to null.
Extra columns pass through `encoded` and `decoded`, the result column replaces a column of that name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLICE = 1 << 18  # bytes handled at once
KEPT = 300_000  # fragments kept per worker
LONGEST = 64  # bytes of a fragment that is kept
SHORT = 64  # bytes up to which fragments are merged together
NEVER = 1 << 30  # rank of a pair without a merge
LETTER, NUMBER, OTHER, SPACE, UNSEEN = range(5)
DIVISION = re.compile(rb"[A-Za-z](?= [A-Za-z])")  # a border follows, whatever stands further away
# Fixed value: what may follow an apostrophe as one pre-token.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, surfaces and certain cuts of a byte-level file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            document = json.load(f)
        model, split, added = document["model"], document["pre_tokenizer"] or {}, document["added_tokens"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = [t for t in added if t["single_word"] or t["lstrip"] or t["rstrip"]]
        extras = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
        if model["type"] != "BPE" or not plain or document["normalizer"] or document["post_processor"] or odd or any(model.get(k) for k in extras):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        value = {c: b for b, c in enumerate(byte_letters())}
        ids = model["vocab"]
        tokens = {t: bytes(map(value.__getitem__, t)) for t in ids}
        self.surface = [b""] * (max([*ids.values(), *(t["id"] for t in added)]) + 1)
        for token, i in ids.items():
            self.surface[i] = tokens[token]
        self.added = {t["content"].encode(): t["id"] for t in added}
        for content, i in self.added.items():
            self.surface[i] = content
        self.find_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).finditer if added else None
        self.single = [ids[c] for c in byte_letters()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a * len(self.surface) + b for a, b in self.merges], np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        self.results = np.array([new for _, new in self.merges.values()], np.int64)
        self.certain = np.ones(1 << 16, dtype=bool)
        joined = np.frombuffer(b"".join(tokens.values()), np.uint8).astype(np.int64)
        inner = np.ones(len(joined), dtype=bool)
        inner[np.cumsum([len(t) for t in tokens.values()]) - 1] = False  # not from a token's last byte to the next token
        at = np.flatnonzero(inner[:-1])
        self.certain[joined[at] * 256 + joined[at + 1]] = False
        self.classes = np.full(0x110000, UNSEEN, np.uint8)

    def classes_of(self, codes: np.ndarray) -> np.ndarray:
        """Class of each character; unseen ones are shown to the library's splitter after a letter, digit and sign."""
        found = self.classes[codes]
        if found.max(initial=0) == UNSEEN:
            fresh = np.unique(codes[found == UNSEEN])
            self.classes[fresh] = SPACE
            for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                shown = "".join(f"{lead}{chr(c)}\n" for c in fresh.tolist())
                starts = np.array([a for _, (a, _) in self.splitter.pre_tokenize_str(shown)])
                alone = np.isin(np.arange(len(fresh)) * 3 + 1, starts)
                self.classes[fresh[~alone]] = kind
            found = self.classes[codes]
        return found

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids, NEVER without one."""
        key = left * len(self.surface) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (packed as int32) of each fragment: always the merge of lowest rank, leftmost first, until none is left.

        Each round makes one merge in every fragment at once; only the two pairs beside it are looked up again.
        """
        out: list[bytes] = [b""] * len(pieces)
        short = [k for k, p in enumerate(pieces) if len(p) <= SHORT]
        for k, p in enumerate(pieces):
            if len(p) > SHORT:
                out[k] = np.array(self._merged_long([self.single[b] for b in p]), np.int32).tobytes()
        row = np.array(short, np.int64)
        size = np.array([len(pieces[k]) for k in short], np.int64)
        ids = np.array(self.single)[np.frombuffer(b"".join(pieces[k] for k in short), np.uint8)]
        first = np.cumsum(size) - size
        rank = np.full(len(ids), NEVER)
        if len(ids):
            rank[:-1] = self.ranks_of(ids[:-1], ids[1:])
            rank[first + size - 1] = NEVER
        while len(row):
            best = np.minimum.reduceat((rank << 32) + np.arange(len(ids)), first)
            live = best >> 32 < NEVER
            if not live.all():
                own = np.repeat(live, size)
                packed, ends = ids[~own].astype(np.int32).tobytes(), np.cumsum(size[~live]) * 4
                for k, a, b in zip(row[~live].tolist(), (ends - size[~live] * 4).tolist(), ends.tolist()):
                    out[k] = packed[a:b]
                moved = np.cumsum(own) - 1
                row, size, ids, rank = row[live], size[live], ids[own], rank[own]
                first, at = np.cumsum(size) - size, moved[best[live] & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(row):
                break
            last = first + size - 1
            ids[at] = self.results[rank[at]]
            rank[at] = NEVER
            more = at + 1 < last
            rank[at[more]] = self.ranks_of(ids[at[more]], ids[at[more] + 2])
            more = at > first
            rank[at[more] - 1] = self.ranks_of(ids[at[more] - 1], ids[at[more]])
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids, rank, size = ids[keep], rank[keep], size - 1
            first = np.cumsum(size) - size
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over neighbours in a linked list."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def offer(at: int) -> None:
            found = get((ids[at], ids[after[at]]))
            if found is not None:
                heapq.heappush(heap, (found[0], at, ids[at], ids[after[at]], found[1]))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, left, right, new = heapq.heappop(heap)
            other = after[at]
            if ids[at] != left or other < 0 or ids[other] != right:
                continue  # one side was merged meanwhile
            ids[at], ids[other] = new, -1
            after[at] = after[other]
            if after[at] >= 0:
                before[after[at]] = at
                offer(at)
            if before[at] >= 0:
                offer(before[at])
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")


def _characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where they start."""
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    code = raw[start].astype(np.int32)
    if len(start) == len(raw):
        return code, start
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    size = 1 + (code >= 0xC0) + (code >= 0xE0) + (code >= 0xF0)
    code &= np.array([0x7F, 0x7F, 0x1F, 0x0F, 0x07])[size].astype(np.int32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << 6 | padded[start[more] + k] & 0x3F
    return np.minimum(code, 0x10FFFF), start


def borders(vocabulary: Vocabulary, raw: np.ndarray, first: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Byte positions where fragments start. `first`: starts of texts and parts; `whole`: added tokens, left uncut."""
    code, start = _characters(raw)
    n = len(code)
    begin = np.zeros(n + 1, dtype=bool)
    begin[np.searchsorted(start, first)] = True
    begin[n] = True
    kind = vocabulary.classes_of(code)
    space = kind == SPACE
    cut = begin[:-1].copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & (space[1:] | (code[:-1] != 32))  # one blank belongs to what follows it
    tail = space[1:-1] & space[:-2] & ~space[2:]  # last of several blanks before something else
    cut[1:-1] |= tail & ~begin[1:-2] & ~begin[2:-1]
    quote = np.flatnonzero((code == 39) & cut)
    ahead = np.concatenate([code, [0, 0]])
    for letters in CONTRACTIONS:
        hit = quote
        for k, c in enumerate(letters, 1):
            hit = hit[(ahead[hit + k] == ord(c)) & ~begin[np.minimum(hit + k, n)]]
        cut[hit + 1] = False
        end = hit + len(letters) + 1
        cut[end[end < n]] = True
    edge = np.zeros(len(raw), dtype=bool)
    edge[1:] = vocabulary.certain[raw[:-1].astype(np.uint16) * np.uint16(256) + raw[1:]]
    edge[start[cut]] = True
    for a, b in whole:
        edge[a + 1 : b] = False
    return np.flatnonzero(edge)


class Encoder:
    """Encodes texts with a cache of fragments of its own."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[bytes, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.known = {t: np.array([i], np.int32).tobytes() for t, i in self.vocabulary.added.items()}

    def _parts(self, text: bytes) -> Iterator[tuple[bytes, bool]]:
        """A text in order: added tokens (True) and what lies between, divided where it is long."""
        at = 0
        for m in self.vocabulary.find_added(text) if self.vocabulary.find_added else ():
            yield from self._divided(text[at : m.start()])
            yield m.group(), True
            at = m.end()
        yield from self._divided(text[at:] if at else text)

    @staticmethod
    def _divided(text: bytes) -> Iterator[tuple[bytes, bool]]:
        at = 0
        while len(text) - at > SLICE:
            m = DIVISION.search(text, at + SLICE // 2)
            if not m:
                break
            yield text[at : m.end()], False
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def _slice(self, parts: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, and the number of ids of each part."""
        size = np.fromiter((len(p) for p, _ in parts), np.int64, len(parts))
        first = np.cumsum(size) - size
        data = b"".join(p for p, _ in parts)
        whole = [(a, a + n) for a, n, (_, added) in zip(first.tolist(), size.tolist(), parts) if added]
        at = borders(self.vocabulary, np.frombuffer(data, np.uint8), first, whole)
        cuts = at.tolist()
        pieces = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
        values = list(map(self.known.get, pieces))
        if None in values:
            missing = list(dict.fromkeys(p for p, v in zip(pieces, values) if v is None))
            fresh = dict(zip(missing, self.vocabulary.merged(missing)))
            if len(self.known) > KEPT:
                self._reset()
            self.known |= {p: v for p, v in fresh.items() if len(p) <= LONGEST}
            values = [fresh[p] if v is None else v for p, v in zip(pieces, values)]
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        upto = np.append(0, np.cumsum(sizes))
        ends = np.append(np.searchsorted(at, first), len(at))
        return np.frombuffer(b"".join(values), np.int32), np.diff(upto[ends])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of every text, in order."""
        waiting: list[tuple[bytes, bool]] = []
        closing: list[tuple[int, bool]] = []  # parts so far, whether the text ends there
        held, kept = 0, []

        def flush() -> Iterator[np.ndarray]:
            nonlocal kept
            if waiting:
                ids, counts = self._slice(waiting)
            else:
                ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
            upto, done = np.append(0, np.cumsum(counts)), 0
            for parts, ends in closing:
                kept.append(ids[upto[done] : upto[parts]])
                done = parts
                if ends:
                    yield np.concatenate(kept)
                    kept = []
            waiting.clear()
            closing.clear()

        for text in texts:
            for part in self._parts(text):
                waiting.append(part)
                held += len(part[0])
                if held >= SLICE:
                    closing.append((len(waiting), False))
                    yield from flush()
                    held = 0
            closing.append((len(waiting), True))
        yield from flush()


def _bytes(column: pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def encoded(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """Add the ids of every text. `path`: a byte-level file readable on every executor."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for texts in batches:
            found = list(encoder.encode(_bytes(texts)))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return docs.withColumn(name, ids("text"))


def decoded(rows: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Add the text of the ids of every row."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(path)
        for lists in batches:
            yield pa.array([None if x is None else vocabulary.decode(x) for x in lists.to_pylist()], pa.string())

    return rows.withColumn(name, text(ids))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids are decoded again where they are made."""
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    @F.arrow_udf(kind)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        shown = [str(i) for i in range(len(encoder.vocabulary.surface))]
        for texts in batches:
            count, listed, back = [], [], []
            for ids in encoder.encode(_bytes(texts)):
                numbers = ids.tolist()
                count.append(len(numbers))
                listed.append(hashlib.sha256(",".join(map(shown.__getitem__, numbers)).encode()).hexdigest())
                back.append(hashlib.sha256(encoder.vocabulary.decode(numbers).encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(count, pa.int64()), pa.array(listed, pa.string()), pa.array(back, pa.string())],
                names=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select("doc_id", digest("text").alias("found"))
    return found.select("doc_id", "found.n_tokens", "found.ids_sha256", "found.decoded_sha256")
