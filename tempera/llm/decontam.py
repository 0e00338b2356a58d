"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are compared as UTF-8 bytes, A-Z lower-cased, line ends and tabs as spaces. A random walk
(CGK) copies a window into a longer string: each step writes the byte under a pointer and moves it
on by a random bit that depends on the step and the byte. Few edits between two windows become few
differing places, so hashes of a few sampled places collide often. Windows come in sizes by length
class (``length_class``) so that a copy of an item holds at least one whole window, wherever it lies:
documents are cut into such windows side by side, items at every offset. Walks, each with ``TABLES``
samples, repeat the search until it finds ``RECALL`` of copies with all the edits of ``MAX_EDITS``:
``plan_walks`` plants and searches such copies of the benchmark's own items, class by class. Every
window found is compared first, then the whole item with its best substring around the place, both
by exact edit distance.

Items below ``SHORT`` bytes have no such windows; of their most edits + 1 pieces one stands in a copy
unchanged, so these are looked up and the whole item compared around them, which misses nothing.

The items travel with the tasks in blocks of at most ``BLOCK_POSTINGS`` indexed windows (about 12 bytes
each); a larger benchmark takes more passes over the documents, one block on the driver at a time.
Documents never shuffle.

Defined cases: null or empty texts match nothing; items without a character but white space are no
items; an item without id has a null ``item_id``; repeated rows and equal items give a row each; of
equally good places of an item the first is told; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import CACHES, mapped, written

SHORT = 19  # bytes of the least length class; shorter items are found by their pieces
RECALL = 0.98  # of copies with all the edits that the threshold allows, in every length class
MOST_WINDOW = 30
MAX_WINDOW_EDITS = 0.3  # of a colliding window, before its whole item is verified
TABLES, PLACES = 8, 12  # samples a walk, places a sample
MOST_WALKS = 60
_PLANTED = 600  # copies a plan searches
_PLANNED = 200  # items of a class whose copies it plants
MAX_EDITS = 0.15  # of an item's length
BLOCK_POSTINGS = 16 << 20
_CHUNK = 4 << 20  # bytes of documents walked at once
_BATCH = 16_384  # windows whose arrays stay in the processor's cache
_PROBED = 65_536  # windows looked up at once
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\r\x0b\x0c" else b for b in range(256))
MATCH = "doc_id long, item_id long, start long, length long, edits long"


def folded(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


class _Walk:
    """The random choices for windows of one size, the same in every task."""

    def __init__(self, window: int, seed: int):
        rng = np.random.default_rng([window, seed])
        self.steps = window * 3 // 2
        self.moves = rng.integers(0, 2, (self.steps, 256)).astype(np.intp)
        self.values = rng.integers(0, 1 << 63, (self.steps, 256), dtype=np.uint64) * 2 + 1
        self.tables: list[list[int]] = [[] for _ in range(self.steps)]
        for t in range(TABLES):
            for step in rng.choice(self.steps, min(PLACES, self.steps), replace=False):
                self.tables[step].append(t)

    def hashes(self, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One hash a table of the window at each start; the buffer goes on past the last one."""
        out = np.zeros((TABLES, len(starts)), np.uint64)
        for k in range(0, len(starts), _BATCH):
            at = starts[k : k + _BATCH].astype(np.intp)
            part, byte, index = out[:, k : k + _BATCH], np.empty(len(at), np.uint8), np.empty(len(at), np.intp)
            random, move = np.empty(len(at), np.uint64), np.empty(len(at), np.intp)
            for step in range(self.steps):
                np.take(buffer, at, out=byte, mode="clip")
                np.copyto(index, byte)
                if self.tables[step]:
                    np.take(self.values[step], index, out=random, mode="clip")
                    for t in self.tables[step]:
                        np.add(part[t], random, out=part[t])
                np.add(at, np.take(self.moves[step], index, out=move, mode="clip"), out=at)
        return out ^ (out >> np.uint64(29))


def length_class(n: int) -> int:
    """The least length of the class of items of n bytes: ``SHORT`` times a power of two."""
    return SHORT << (n // SHORT).bit_length() - 1


def _window(least: int) -> int:
    """Windows of this size lie side by side in documents; each copy of an item holds a whole one."""
    return min(MOST_WINDOW, (least + 1) // 2)


class _Tables:
    """The windows of one size of some items under one walk, by hash, one sorted list a table."""

    _BITS = 20

    def __init__(self, goals: list[bytes], window: int, seed: int):
        self.w = window
        self.walk = _Walk(self.w, seed)
        buffer, first = self.goals = _joined(goals, self.w)
        n = np.array([len(t) - self.w + 1 for t in goals])
        self.item = np.repeat(np.arange(len(goals), dtype=np.int32), n)
        self.offset = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        place = self.offset // np.array([_slack(t) for t in goals])[self.item]
        self.lists = []
        for h in self.walk.hashes(buffer, first[self.item] + self.offset):
            order = np.argsort(h, kind="stable")
            hs, i, p = h[order], self.item[order], place[order]
            order = order[np.r_[True, (hs[1:] != hs[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1])]]  # of equal windows side by side one
            there = np.zeros(1 << self._BITS, bool)
            there[(h >> np.uint64(64 - self._BITS)).astype(np.int64)] = True
            self.lists.append((np.packbits(there, bitorder="little"), h[order], order.astype(np.int32)))

    def shared(self, texts: list[bytes]) -> np.ndarray:
        """Rows (text, item, item's start in the text, window's start) of windows with an equal hash and at
        most ``MAX_WINDOW_EDITS`` between them."""
        buffer, first = _joined(texts, self.w)
        n = np.array([len(t) for t in texts]) // self.w
        text = np.repeat(np.arange(len(texts)), n)
        place = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * self.w
        parts = [self._shared(buffer, first, text[k : k + _PROBED], place[k : k + _PROBED]) for k in range(0, len(text), _PROBED)]
        return np.concatenate([np.zeros((0, 4), np.int64), *parts])

    def _shared(self, buffer: np.ndarray, first: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        found, total = [], np.int64(len(self.item))
        for h, (there, keys, window) in zip(self.walk.hashes(buffer, first[text] + place), self.lists, strict=True):
            high = (h >> np.uint64(64 - self._BITS)).astype(np.int64)
            maybe = np.flatnonzero(there[high >> 3] >> (high & 7).astype(np.uint8) & 1)
            lo, hi = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            q = np.repeat(maybe, hi - lo)
            k = np.arange(len(q)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
            found.append(q * total + window[k])
        q, window = np.divmod(np.unique(np.concatenate(found)), max(1, total))
        goals, begin = self.goals
        item, offset = self.item[window].astype(np.int64), self.offset[window]
        at, goal_at = first[text[q]] + place[q], begin[item] + offset
        near = [_window_edits(buffer, at[k : k + 2048], goals, goal_at[k : k + 2048], self.w) for k in range(0, len(q), 2048)]
        good = np.concatenate([np.zeros(0, int), *near]) <= MAX_WINDOW_EDITS * self.w
        return np.stack([text[q], item, place[q] - offset, place[q]], 1)[good]


class _Pieces:
    """The pieces of items, one more than the edits that an item allows: below ``SHORT`` bytes, and of classes for which
    ``MOST_WALKS`` don't reach the recall asked for. One piece stands unchanged in every copy, so none is missed."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.goals, self.begin = _joined([t for _, t in items], SHORT)
        self.items, self.pieces = items, {}
        for k, (_, t) in enumerate(items):
            cuts = [len(t) * i // (_most(t) + 1) for i in range(_most(t) + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(t[a:b], []).append((k, a))

    def candidates(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, start of the item in the text) around pieces, where the whole item is near."""
        buffer, first = _joined(texts, SHORT)
        data, starts, lengths = buffer.tobytes(), first, np.array([len(t) for t in texts])
        for piece, where in self.pieces.items():
            at, places = data.find(piece), []
            while at >= 0:
                places.append(at)
                at = data.find(piece, at + 1)
            places = np.array(places, np.int64)
            text = np.searchsorted(starts, places, "right") - 1
            inside = places < starts[text] + lengths[text]
            for k, a in where:
                item, goal = self.items[k]
                at = np.maximum(places[inside] - a, 0)
                for c in range(0, len(at), 2048):
                    part = at[c : c + 2048]
                    near = np.ones(len(part), bool)  # of long items all places are verified
                    if len(goal) < SHORT:
                        near = _window_edits(self.goals, np.full(len(part), self.begin[k]), buffer, part, len(goal)) <= _most(goal)
                    for t, p in zip(text[inside][c : c + 2048][near].tolist(), part[near].tolist(), strict=True):
                        yield t, item, p - int(starts[t])


def _joined(texts: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer with room between them, and where each starts."""
    lengths = np.array([len(t) + 2 * w for t in texts])
    return np.frombuffer(b"".join(t + bytes(2 * w) for t in texts), np.uint8), np.cumsum(lengths) - lengths


def _window_edits(buffer: np.ndarray, at: np.ndarray, goals: np.ndarray, goal_at: np.ndarray, w: int) -> np.ndarray:
    """``min(_ends(...))`` of each window of at most 63 bytes in the goal around its place, all at once."""
    one, rows, margin = np.uint64(1), np.arange(len(at)), w // 4
    masks = np.zeros((len(at), 256), np.uint64)
    for i in range(w):
        masks[rows, buffer[at + i]] |= one << np.uint64(i)
    full, last = np.uint64((1 << w) - 1), np.uint64(w - 1)
    up, down, score = np.full(len(at), full), np.zeros(len(at), np.uint64), np.full(len(at), w)
    least = score.copy()
    for j in range(-margin, w + margin):
        eq = masks[rows, np.take(goals, goal_at + j, mode="clip")]
        x = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score = score + (plus >> last).astype(np.int64) - (minus >> last).astype(np.int64)
        plus, minus = (plus << one) & full, (minus << one) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        np.minimum(least, score, out=least)
    return least


def edited(goal: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """A copy with so many random substitutions, insertions and deletions."""
    out = bytearray(goal)
    for kind, where, byte in zip(rng.integers(0, 3, edits), rng.random(edits), rng.integers(97, 123, edits), strict=True):
        at = int(where * len(out))
        out[at : at + (kind != 1)] = bytes([byte])[: int(kind != 2)]
    return bytes(out)


def plan_walks(goals: list[bytes], least: int, recall: float = RECALL) -> int:
    """Walks for a class of items: one after the other searches ``_PLANTED`` copies of them, each with all
    the edits of ``MAX_EDITS``, until the share found is ``recall`` by the lower bound of its 95 % interval. 0 if
    ``MOST_WALKS`` don't get there: the class is then found by its pieces, which costs more and misses none."""
    rng = np.random.default_rng([_PLANTED, least])
    which = np.arange(_PLANTED) % len(goals)
    lead = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(0, 2 * least, _PLANTED)]
    texts = [x + edited(goals[i], _most(goals[i]), rng) + bytes(least) for x, i in zip(lead, which, strict=True)]
    starts, slack = np.array([len(x) for x in lead]), np.array([_slack(goals[i]) for i in which])
    found = np.zeros(_PLANTED, bool)
    for walks in range(1, MOST_WALKS + 1):
        rows = _Tables(goals, _window(least), walks - 1).shared(texts)
        t = rows[:, 0]
        found[t[(rows[:, 1] == which[t]) & (np.abs(rows[:, 2] - starts[t]) <= slack[t])]] = True
        p = found.mean()
        if p - 1.65 * (p * (1 - p) / _PLANTED) ** 0.5 - 1 / _PLANTED >= recall:
            return walks
    return 0


def _most(goal: bytes) -> int:
    return int(len(goal) * MAX_EDITS)


def _slack(goal: bytes) -> int:
    return max(8, _most(goal))


def plan(items: list[tuple[int | None, bytes]], recall: float = RECALL) -> dict[int, int]:
    """Walks by length class."""
    classes: dict[int, list[bytes]] = {}
    for _, t in items:
        if len(t) >= SHORT:
            classes.setdefault(length_class(len(t)), []).append(t)
    return {least: plan_walks(goals, least, recall) for least, goals in sorted(classes.items())}


class Index:
    """The windows of a block of items by size and walk; classes of one size share its walks."""

    def __init__(self, items: list[tuple[int | None, bytes]], walks: dict[int, int] | None = None):
        self.items = items
        walks = plan(items) if walks is None else walks
        self.short = _Pieces([(i, t) for i, (_, t) in enumerate(items) if 0 < len(t) < SHORT or len(t) >= SHORT and not walks[length_class(len(t))]])
        self.tables: list[tuple[np.ndarray, _Tables]] = []
        of = [walks[length_class(len(t))] if len(t) >= SHORT else 0 for _, t in items]
        for w in sorted({_window(least) for least in walks}):
            for s in range(max(n for least, n in walks.items() if _window(least) == w)):
                mine = [i for i, (_, t) in enumerate(items) if of[i] > s and _window(length_class(len(t))) == w]
                if mine:
                    self.tables.append((np.array(mine), _Tables([items[i][1] for i in mine], w, s)))

    def candidates(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, start of the item in the text) that share a window by a sampled hash, or a piece."""
        out = set(self.short.candidates(texts))
        for mine, walk in self.tables:
            out.update((t, int(mine[i]), start) for t, i, start in walk.shared(texts)[:, :3].tolist())
        return sorted(out)

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, length, edits): the best place of each item in each text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for text, item, start in self.candidates(texts):
            goal = self.items[item][1]
            slack, most = _slack(goal), _most(goal)
            if (text, item, start // slack) in tried:
                continue
            tried.add((text, item, start // slack))
            lo = max(0, start - 2 * slack)
            hit = find(goal, texts[text][lo : max(0, start + len(goal) + 3 * slack)], most)
            if hit and (new := (hit[0], lo + hit[1], hit[2])) < best.get((text, item), (1 << 60,)):
                best[text, item] = new
        return [(text, item, start, length, edits) for (text, item), (edits, start, length) in sorted(best.items())]


def _ends(goal: bytes, text: bytes) -> Iterator[int]:
    """The least edit distance of ``goal`` to a substring ending after each byte of ``text``, by
    bit vectors of the dynamic programme's columns."""
    masks: dict[int, int] = {}
    for i, b in enumerate(goal):
        masks[b] = masks.get(b, 0) | 1 << i
    full, top, score = (1 << len(goal)) - 1, 1 << (len(goal) - 1), len(goal)
    up, down = full, 0
    for b in text:
        eq = masks.get(b, 0)
        x = eq | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(x | plus)), plus & x
        yield score


def find(goal: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(edits, start, length) of the best substring of ``text`` if at most ``most`` edits away."""
    at = text.find(goal)
    if at >= 0:
        return 0, at, len(goal)
    edits, end = min(((d, e) for e, d in enumerate(_ends(goal, text), 1)), default=(len(goal), 0))
    if edits > most:
        return None
    reverse = list(_ends(goal[::-1], text[:end][::-1]))
    length = min(range(len(reverse)), key=lambda k: (reverse[k], abs(k + 1 - len(goal)))) + 1 if reverse else 0
    return edits, end - length, length


_INDEXES: dict[int, Index] = {}
CACHES.append(_INDEXES.clear)


def _index(items: list[tuple[int | None, bytes]], walks: dict[int, int]) -> Index:
    key = hash(tuple(items))
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items, walks)
    return _INDEXES[key]


def _plan_of(items: DataFrame) -> tuple[dict[int, int], int]:
    """Walks by length class, planned on ``_PLANNED`` items of each, and the count of blocks."""
    n = F.octet_length("text")
    step = F.when(n >= SHORT, F.length(F.bin(F.floor(n / SHORT))) - 1).otherwise(-1)
    sizes = items.groupBy(step.cast("int").alias("step")).agg(F.sum(n).alias("bytes")).collect()
    walks, postings = {}, 0
    for step_, size in sizes:
        least = SHORT << max(0, step_)
        if step_ >= 0:
            some = items.where(step == step_).orderBy(F.xxhash64("text"), "text").limit(_PLANNED).collect()
            walks[least] = plan_walks([folded(r["text"]) for r in some], least)
        postings += size * TABLES * max(1, walks.get(least, 1))
    return walks, max(1, -(-postings // BLOCK_POSTINGS))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, length, edits`` (in bytes) for every document and item it holds."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").rlike(r"[^ \t\n\r\x0b\x0c]"))
    walks, blocks = _plan_of(items)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        goals = sorted(((r["item_id"], folded(r["text"])) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        found = mapped(rows, _searched(goals, walks), MATCH)
        found = written(found, "decontam") if blocks > 1 else found
        out = out.unionByName(found) if out else found
    return out


def _searched(items: list[tuple[int, bytes]], walks: dict[int, int]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, walks)
        names = [x.split()[0] for x in MATCH.split(", ")]
        for batch in batches:
            ids, texts, size = [], [], 0
            last = batch.num_rows - 1
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"), strict=True)):
                ids.append(doc_id.as_py())
                texts.append(folded(text.as_py()))
                size += len(texts[-1])
                if size >= _CHUNK or i == last:
                    found = [(ids[t], items[k][0], start, length, edits) for t, k, start, length, edits in index.matches(texts)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)
                    ids, texts, size = [], [], 0

    return search
