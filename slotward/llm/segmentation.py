"""Sampling SentencePiece segmentations without replacement, and decoding.

The lattice of a text has an edge for every piece of the vocabulary that fits (and byte pieces for characters
that have none). The file holds merge ranks, so an edge weighs (rank + 2) ** -sharpness; ranks are the
negated scores. No piece has a word mark inside, so the lattice falls into units, one per run of spaces with
what follows it, whose backward-sampling tables are built once per worker and kept in a bounded cache.

Samples come from Gumbel top-k: the first is a plain draw with the largest perturbed score; what remains is
partitioned by the first decision that differs from it, each part gets a Gumbel of its mass truncated at the
score of the sample it was split from, and the search always expands the best part next (A*). That gives k
distinct segmentations in order of their perturbed scores, an exact sample without replacement. The score of
the k+1st is the threshold of the inclusion scores 1 - exp(-exp(log_prob - threshold)).
All random numbers are hashes of the row key and counters, so a row's samples depend on nothing else.

Defined cases: null and empty texts give one sample without pieces; texts with fewer than k segmentations give
all of them, inclusion 1; equal keys with equal texts give equal samples; a word mark in the text decodes as a
space, as in the library. Extra columns of `docs` are not read.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SAMPLES = 2
SHARPNESS = 1.0
MARK = "▁"
UNIT = re.compile(" +[^ ]*")
SLOTS = 21  # bits of a slot in the piece tables
EDGES = 4_000_000  # edges kept per worker before rare units are forgotten
SLICE = 60_000  # units handled at once
GOLD, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Weights and surfaces of the pieces of a model file."""

    def __init__(self, path: str, sharpness: float = SHARPNESS):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[piece] = i
                self.surface[i] = piece.replace(MARK, " ").encode("utf-8")
        self.sizes = np.fromiter(map(len, self.surface), np.int64, n)
        self.begins, self.joined = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.surface), np.uint8)
        self.unknown = model.unk_id()
        self.fallback = float(n) ** -sharpness
        self.longest = max(map(len, pieces), default=1)
        # Beginnings of pieces are kept too, with id -1, so that a look-up also tells whether to look further.
        starts = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | pieces
        self.hashes, self.ids = np.array([self._hash(p) for p in starts], np.uint64), np.array(list(starts.values()), np.int32)
        rank = np.minimum([-model.get_score(i) if i >= 0 else 0.0 for i in self.ids.tolist()], float(n))
        self.weights = (rank + 2.0) ** -sharpness
        # Slots by the upper bits of a product; those whose slot is taken go to a second table under another factor.
        every = np.arange(len(self.hashes), dtype=np.int32)
        self.first, self.second = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
        top = self._slots(self.hashes, SPREAD)
        self.first[top] = every
        late = every[self.first[top] != every]
        for k in range(100):
            self.factor = mixed(np.array([k], np.uint64))[0] | np.uint64(1)
            low = self._slots(self.hashes[late], self.factor)
            if len(np.unique(low)) == len(late):
                break
        else:
            raise ValueError("pieces share their slots")
        self.second[low] = late

    @staticmethod
    def _slots(run: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((run * factor) >> np.uint64(64 - SLOTS)).astype(np.int32)

    def find(self, run: np.ndarray) -> np.ndarray:
        """Index of the piece or beginning of each hash, -1 without one."""
        spot = self.first[self._slots(run, SPREAD)]
        other = np.flatnonzero(self.hashes[spot] != run)
        again = self.second[self._slots(run[other], self.factor)]
        spot[other] = np.where(self.hashes[again] == run[other], again, -1)
        return spot

    @staticmethod
    def _hash(piece: str) -> int:
        run = 0
        for c in piece:
            run = (run * int(GOLD) + ord(c) + 1) % 2**64
        return run

    def decode(self, ids: list[int]) -> str:
        """Text of the pieces, without the space put before the first word."""
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def _spelling(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        end = np.cumsum(size)
        return self.joined[np.arange(size.sum()) + np.repeat(self.begins[ids] - end + size, size)].tobytes()

    def decode_to(self, rows: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether `decode` gives the text, for each row of ids; equal bytes need no decoding."""
        ids = np.concatenate([np.zeros(0, np.int64), *rows])
        raw = b"".join(map(self._spelling, np.split(ids, range(SLICE, len(ids), SLICE))))
        ends = np.append(0, np.cumsum(self.sizes[ids]))[np.cumsum([0, *map(len, rows)])].tolist()
        return [raw[a:b] == (" " + text if len(own) else text).encode("utf-8", "surrogatepass") or self.decode(own.tolist()) == text
                for own, text, a, b in zip(rows, texts, ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def _vocabulary(path: str, sharpness: float, changed: int) -> Vocabulary:
    """The vocabulary of a file as last changed, read once per worker."""
    return Vocabulary(path, sharpness)


def units_of(text: str) -> list[str]:
    """Units of a text with the mark put before it, each without its first mark and with blanks for the others."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [u[1:] for u in UNIT.findall(" " + text)]


class Tables:
    """Backward-sampling tables of the units seen so far: edges ordered by the node they end in."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.extra, self.spelled = vocabulary, [], {}
        self.key, self.log = np.empty(0), np.empty(0)
        self.source, self.target, self.piece, self.into, self.head, self.last, self.count = (np.empty(0, np.int32) for _ in range(7))
        self._clear()

    def _clear(self) -> None:
        """Forget all units; the arrays keep their room."""
        self.numbers: dict[str, int] = {}  # a unit's place in `head` and `last`, its first and last node, and in `count`
        self.nodes = self.edges = 0

    def _thin(self) -> None:
        """Forget the units seen once since the last time, or all if the others fill half the room."""
        n = len(self.numbers)
        keep = self.count[:n] > 1
        node_unit = np.repeat(np.arange(n), self.last[:n] - self.head[:n] + 1)
        source, target, into = self.source[: self.edges], self.target[: self.edges], self.into[: self.nodes]
        nodes, edges = keep[node_unit], keep[node_unit[target]]
        if edges.sum() > EDGES // 2:
            return self._clear()
        node, edge = np.cumsum(nodes) - 1, np.cumsum(edges) - 1
        moved = {
            "key": (self.key[: self.edges] + (node[target] - target))[edges], "source": node[source[edges]], "target": node[target[edges]],
            "piece": self.piece[: self.edges][edges], "log": self.log[: self.edges][edges], "into": np.where(into >= 0, edge[into], -1)[nodes],
            "head": node[self.head[:n][keep]], "last": node[self.last[:n][keep]],
        }
        for name, values in moved.items():
            getattr(self, name)[: len(values)] = values
        self.numbers = {u: k for k, u in enumerate(u for u, stays in zip(self.numbers, keep.tolist()) if stays)}
        self.nodes, self.edges = int(nodes.sum()), int(edges.sum())
        self.count[: len(self.numbers)] = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values from `at` on into an array whose room at least doubles when it ends."""
        room, end = getattr(self, name), at + len(values)
        if end > len(room):
            grown = np.empty(max(end, 2 * len(room)), room.dtype)
            grown[:at] = room[:at]
            room = grown
            setattr(self, name, room)
        room[at:end] = values

    def add(self, units: list[str]) -> None:
        """Append the tables of new units: look up all their substrings at once, then go forward by position."""
        if not units:
            return
        code = np.frombuffer((" " + " ".join(units)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code[code == 32] = ord(MARK)
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        unit = np.repeat(np.arange(len(units)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        first = self.nodes + np.cumsum(size + 1) - size - 1  # node before a unit's first character
        node = first[unit] + place
        room = size[unit] - place
        begin, end, piece, weight = [], [], [], []
        at, run = np.arange(len(code)), np.zeros(len(code), np.uint64)
        for n in range(1, self.vocabulary.longest + 1):
            keep = room[at] >= n
            at = at[keep]
            run = run[keep] * GOLD + code[at + n - 1] + np.uint64(1)
            spot = self.vocabulary.find(run)
            known = spot >= 0
            found = self.vocabulary.ids[spot]
            hit = known & (found >= 0)
            begin.append(node[at[hit]])
            end.append(begin[-1] + n)
            piece.append(found[hit])
            weight.append(self.vocabulary.weights[spot[hit]])
            bare = at[~hit]
            at, run = at[known], run[known]  # nothing longer begins with the others
            if n == 1:
                begin.append(node[bare])
                end.append(node[bare] + 1)
                chars = [chr(c) for c in code[bare].tolist()]
                piece.append(np.fromiter(map(self._spelled, chars), np.int64, len(chars)))
                weight.append(np.array([self.vocabulary.fallback ** len(c.encode("utf-8", "surrogatepass")) for c in chars]))
        begin, end, piece, weight = (np.concatenate(x) for x in (begin, end, piece, weight))
        order = np.argsort(end, kind="stable")
        begin, end, piece, weight = (x[order] for x in (begin, end, piece, weight))
        self._append(begin, end, piece, self._chances(begin, end, weight, first, size))
        held = len(self.numbers)
        self.numbers |= zip(units, range(held, held + len(units)))
        self._put("head", held, first)
        self._put("last", held, first + size)
        self._put("count", held, np.zeros(len(units), np.int32))
        self.nodes = int(first[-1] + size[-1] + 1)

    def _chances(self, begin, end, weight, first, size) -> np.ndarray:
        """Probability of each edge among those into its node, by sums over all paths from the unit's start."""
        base, chance = self.nodes, np.empty(len(end))
        forward = np.zeros(int(first[-1] + size[-1] + 1) - base)
        forward[first - base] = 1.0
        head = np.repeat(first, np.diff(np.append(np.searchsorted(end, first), len(end))))
        depth = end - head
        order = np.argsort(depth.astype(np.uint16) if size.max() < 1 << 16 else depth, kind="stable")  # short numbers are sorted by digits
        cuts = np.searchsorted(depth[order], np.arange(1, int(size.max()) + 2))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            now = order[low:high]
            into, flow = end[now] - base, forward[begin[now] - base] * weight[now]
            start = np.flatnonzero(np.r_[True, into[1:] != into[:-1]])
            total = np.add.reduceat(flow, start)
            chance[now] = flow / np.repeat(total, np.diff(np.append(start, len(now))))
            forward[into[start]] = total
            if total.min() < 1e-100:  # only ratios matter
                low_nodes = into[start][total < 1e-100]
                for back in range(min(self.vocabulary.longest, int(depth[now[0]])) + 1):
                    forward[low_nodes - back] *= 1e100
        return chance

    def _append(self, begin, end, piece, chance) -> None:
        start = np.append(0, np.flatnonzero(end[1:] != end[:-1]) + 1)
        size = np.diff(np.append(start, len(end)))
        run = np.cumsum(chance)
        run = np.minimum(run - np.repeat(run[start] - chance[start], size), 1.0)
        run[start + size - 1] = 1.0
        into = np.full(int(end[-1]) + 1 - self.nodes, -1, np.int32)
        into[end[start] - self.nodes] = start + self.edges
        self._put("into", self.nodes, into)
        values = {"key": end + run, "source": begin, "target": end, "piece": piece, "log": np.log(np.maximum(chance, 1e-300))}
        for name, value in values.items():
            self._put(name, self.edges, value)
        self.edges += len(end)

    def _spelled(self, char: str) -> int:
        """A byte piece, or a negative index of several (the unknown piece where the file has no bytes)."""
        if char not in self.spelled:
            ids = [self.vocabulary.bytes.get(b, self.vocabulary.unknown) for b in char.encode("utf-8", "surrogatepass")]
            if len(ids) > 1:
                self.extra.append(ids)
            self.spelled[char] = ids[0] if len(ids) == 1 else -len(self.extra)
        return self.spelled[char]

    def nodes_of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First and last nodes of the units, after adding the new ones; makes room when full."""
        if self.edges > EDGES:
            self._thin()
        self.add(list(dict.fromkeys(filterfalse(self.numbers.__contains__, units))))
        at = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
        self.count[: len(self.numbers)] += np.bincount(at, minlength=len(self.numbers)).astype(np.int32)
        return self.head[at].astype(np.int64), self.last[at].astype(np.int64)

    def descend(self, node: np.ndarray, left: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw edges back to the start of each walker's unit; (walker, edge), in order of walker and step."""
        who = np.arange(len(node))
        walkers, edges = [], []
        turn = 0
        while len(who):
            u = uniform(seed[who] + np.uint64(turn))
            edge, aim = self.into[node].astype(np.int64), node + u
            behind = np.flatnonzero(self.key[edge] <= aim)
            while len(behind):
                edge[behind] += 1
                behind = behind[self.key[edge[behind]] <= aim[behind]]
            walkers.append(who)
            edges.append(edge)
            left_now = left[who]
            node = self.source[edge].astype(np.int64)
            go = node > left_now
            who, node, turn = who[go], node[go], turn + 1
        if not walkers:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        walkers, edges = np.concatenate(walkers), np.concatenate(edges)
        order = np.argsort(walkers, kind="stable")
        return walkers[order], edges[order]

    def ids(self, paths: list[Path]) -> list[np.ndarray]:
        """Piece ids of paths in text order (units are in order, the edges of a unit from its end)."""
        cuts = np.cumsum([0, *(len(p.edges) for p in paths)])
        if not cuts[-1]:
            return [np.zeros(0, np.int32) for _ in paths]
        unit = np.concatenate([p.unit for p in paths])
        new = np.append(True, unit[1:] != unit[:-1])
        new[cuts[:-1][cuts[:-1] < len(new)]] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(unit)))
        turned = np.repeat(2 * start + size - 1, size) - np.arange(len(unit))
        found = self.piece[np.concatenate([p.edges for p in paths])[turned]]
        out = [found[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        if found.min() >= 0:
            return out
        spelled = lambda own: np.array([x for p in own.tolist() for x in (self.extra[-p - 1] if p < 0 else (p,))], np.int32)
        return [spelled(own) if len(own) and own.min() < 0 else own for own in out]


class Path:
    """A sampled path with the edges that its part of the space excludes at one decision."""

    def __init__(self, edges, unit, score, at, banned):
        self.edges, self.unit, self.score, self.at, self.banned, self.log_prob = edges, unit, score, at, banned, None

    def best(self) -> float:
        return float(self.parts.max()) if len(self.parts) else -math.inf


def split(tables: Tables, paths: list[Path], seeds: np.ndarray) -> None:
    """Perturbed scores of the parts of each path that differ from it first at each decision from `at` on."""
    if not paths:
        return
    cuts = np.cumsum([0, *(len(p.edges) for p in paths)])
    size = np.diff(cuts)
    log = tables.log[np.concatenate([p.edges for p in paths])]
    run = np.empty(len(log))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        np.cumsum(log[a:b], out=run[a:b])
    place = np.arange(len(log)) - np.repeat(cuts[:-1], size)
    with np.errstate(divide="ignore"):
        rest = 1 - np.exp(log)
        for path, a in zip(paths, cuts.tolist()):
            if path.banned:
                rest[a + path.at] -= sum(math.exp(tables.log[e]) for e in path.banned)
        mass = run - log + np.log(np.where(rest > 1e-12, rest, 0.0))
        mass[place < np.repeat([p.at for p in paths], size)] = -np.inf
        gumbel = mass - np.log(-np.log(uniform(np.repeat(seeds, size) + place.astype(np.uint64))))
    parts = -np.logaddexp(-np.repeat([p.score for p in paths], size), -gumbel)
    for path, a, b in zip(paths, cuts[:-1].tolist(), cuts[1:].tolist()):
        path.parts, path.log_prob = parts[a:b], float(run[b - 1])


def _deviate(tables: Tables, node: int, banned: list[int], u: float) -> int:
    """An edge into `node` other than the banned ones."""
    low = int(tables.into[node])
    high = low + int((tables.target[low : min(low + tables.vocabulary.longest + 1, tables.edges)] == node).sum())
    weight = np.exp(tables.log[low:high])
    weight[[e - low for e in banned]] = 0
    run = np.cumsum(weight)
    return int(low + min(np.searchsorted(run, u * run[-1], side="right"), np.flatnonzero(weight)[-1]))


def sampled(tables: Tables, texts: list[str], seeds: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k of (ids, log_prob, perturbed score, inclusion score)."""
    units = [units_of(t) for t in texts]
    size = np.array([len(u) for u in units], dtype=np.int64)
    flat = [u for row in units for u in row]
    left, end = tables.nodes_of(flat)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)
    place = (np.arange(len(flat)) - begin[owner]).astype(np.uint64)
    row_seed = mixed(seeds)

    def draw(walker_unit, node, turn):
        seed = mixed(row_seed[owner[walker_unit]] ^ mixed(place[walker_unit] + np.uint64(turn << 40)))
        return tables.descend(node, left[walker_unit], seed)

    walker, edge = draw(np.arange(len(flat)), end, 0)
    cut = np.searchsorted(walker, np.append(begin, len(flat)))
    heads = -np.log(-np.log(uniform(row_seed ^ GOLD)))
    found: list[list[Path]] = []
    for r in range(len(texts)):
        found.append([Path(edge[cut[r] : cut[r + 1]], walker[cut[r] : cut[r + 1]], float(heads[r]), 0, [])])
    threshold = np.full(len(texts), -math.inf)
    open_rows = np.flatnonzero(size)
    for turn in range(1, k + 1):
        jobs = []
        split(tables, [found[r][-1] for r in open_rows], row_seed[open_rows] + np.uint64(turn << 32))
        for r in open_rows:
            paths = found[r]
            best = max(paths, key=Path.best)
            score = best.best()
            if score == -math.inf:
                continue
            if turn == k:
                threshold[r] = score
                continue
            at = int(best.parts.argmax())
            banned = [int(best.edges[at]), *(best.banned if at == best.at else [])]
            best.parts[at] = -math.inf
            u = float(uniform(row_seed[r : r + 1] + np.uint64((turn << 32) + (1 << 31)))[0])
            chosen = _deviate(tables, int(tables.target[best.edges[at]]), banned, u)
            jobs.append((r, best, at, banned, chosen, score))
        if not jobs:
            break
        starts, nodes, spans = [], [], []
        for r, best, at, _, chosen, _ in jobs:
            unit = int(best.unit[at])
            own = [unit] if tables.source[chosen] > left[unit] else []
            later = np.arange(unit + 1, begin[r] + size[r])
            starts.append(np.concatenate([np.array(own, np.int64), later]))
            nodes.append(np.concatenate([tables.source[[chosen] * len(own)], end[later]]))
            spans.append(len(starts[-1]))
        walker_unit = np.concatenate(starts)
        walker, edge = draw(walker_unit, np.concatenate(nodes), turn)
        cuts = np.searchsorted(walker, np.append(0, np.cumsum(spans)))
        for (r, best, at, banned, chosen, score), a, b in zip(jobs, cuts[:-1], cuts[1:], strict=True):
            edges = np.concatenate([best.edges[:at], [chosen], edge[a:b]])
            unit = np.concatenate([best.unit[: at + 1], walker_unit[walker[a:b]]])
            found[r].append(Path(edges, unit, score, at, banned))
        open_rows = np.array([job[0] for job in jobs])
    whole = iter(tables.ids([path for paths in found for path in paths]))
    out = []
    for r, paths in enumerate(found):
        rows = []
        for path in paths:
            log_prob = path.log_prob if path.log_prob is not None else float(np.cumsum(tables.log[path.edges])[-1]) if len(path.edges) else 0.0
            inclusion = -math.expm1(-math.exp(min(log_prob - threshold[r], 700.0))) if threshold[r] > -math.inf else 1.0
            rows.append((next(whole), log_prob, path.score, inclusion))
        out.append(rows)
    return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for row, text in enumerate(texts):
        n = text.count(" ") + 1
        if row > begin and held + n > SLICE:
            yield begin, row
            begin, held = row, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def _mapper(path: str, k: int, sharpness: float, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, sharpness, os.stat(path).st_mtime_ns)
        tables = Tables(vocabulary)
        for batch in batches:
            docs, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in _slices(texts):
                found = sampled(tables, texts[a:b], seeds[a:b], k)
                rows = [(r, n, *sample) for r, samples in enumerate(found) for n, sample in enumerate(samples)]
                columns = {
                    "doc_id": docs.take(pa.array([a + r for r, *_ in rows], pa.int64())),
                    "sample": pa.array([n for _, n, *_ in rows], pa.int32()),
                    "n_pieces": pa.array([len(x[2]) for x in rows], pa.int64()),
                    "log_prob": pa.array([x[3] for x in rows], pa.float64()),
                    "perturbed": pa.array([x[4] for x in rows], pa.float64()),
                    "inclusion": pa.array([x[5] for x in rows], pa.float64()),
                }
                if digest:
                    back = vocabulary.decode_to([x[2] for x in rows], [texts[a + x[0]].replace(MARK, " ") for x in rows])
                    columns["ids_md5"] = pa.array([hashlib.md5(x[2].astype("<i4").tobytes()).hexdigest() for x in rows])
                    columns["round_trip"] = pa.array(back)
                else:
                    columns["ids"] = pa.array([x[2].astype(np.int32) for x in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


COLUMNS = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, "


def _run(docs: DataFrame, path: str, k: int, sharpness: float, digest: bool) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id").alias("seed"))
    return rows.mapInArrow(_mapper(path, k, sharpness, digest), COLUMNS + ("ids_md5 string, round_trip boolean" if digest else "ids array<int>"))


def segmentations(docs: DataFrame, path: str, k: int = SAMPLES, sharpness: float = SHARPNESS) -> DataFrame:
    """Up to k rows per document: piece ids with their scores. `path` must be readable on every executor."""
    return _run(docs, path, k, sharpness, False)


def digests(docs: DataFrame, path: str, k: int = SAMPLES, sharpness: float = SHARPNESS) -> DataFrame:
    """The same rows with a digest of the ids and whether they decode to the text."""
    return _run(docs, path, k, sharpness, True)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """`rows` of `segmentations` with ids decoded to a column text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(path)
        for ids in batches:
            yield ids.map(lambda x: vocabulary.decode(list(x)))

    return rows.withColumn("text", text("ids"))
