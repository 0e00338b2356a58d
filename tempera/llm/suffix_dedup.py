"""Exact substring dedup with suffix arrays by two-stage sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (a smaller doc_id, or
the same document further left).

Every window of ``LENGTH`` bytes has an anchor, its least ``GRAM``-gram by hash; windows that are
equal have equal anchors at equal places, so only windows of one anchor hash need comparing. The
windows that share an anchor's occurrence are one row: the anchor's hash, the hash of all the bytes
these windows cover (their context), and where they are. Of rows with equal contexts only the first
can hold a first occurrence; the others are settled. What is left to compare are the first rows of
anchors that stand in several contexts, at the edges of repeats. Their contexts are gathered by
anchor and sorted in blocks: suffixes smaller than their successor are sorted directly, all others
are induced from them by one scan over the buckets, and the common prefixes of neighbours tell
which windows are equal.

Tasks settle equal contexts of their own batch before the shuffle, so a passage in a third of all
rows is a row a batch. Anchors of a very common line stand in new contexts in every document: those
that a bounded sample of documents shows to be common are dealt by anchor and context, the others by
anchor; the sample decides where rows go, never what comes out. An anchor in more than ``HOT``
different contexts is split further, down to its single windows, by hashes of them that aggregate on
the map side; it is the same result.

Defined cases: a null or empty text has no bytes; texts below ``LENGTH`` bytes lose nothing; rows that
repeat a doc_id and its text are repeats of one document and all get its result; other texts of the
same doc_id are documents of their own, in the order of a hash; a null doc_id sorts first; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import BROADCAST_BYTES, joined, mapped, written

LENGTH, GRAM = 100, 24
HOT = 2_048  # contexts of an anchor, about 300 KB, that one task sorts together
SAMPLE, COMMON = 5_000, 25  # documents looked at for common anchors; contexts there that make one common
_GRAMS = LENGTH - GRAM + 1
_PLACE = np.uint64(24)  # bits of a place in a batch
_CHUNK = 4 << 20
_BLOCK = 1 << 20
_BASE = 0xD1342543DE82EF95
_NO_ID = -(1 << 63)
_SPANS = "doc_id long, twin long, start long, length long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Anchors:
    """Finds the anchors of texts; keeps the powers that its rolling hashes need."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def _prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.powers[: len(data)], out=prefix[1:])
        return prefix

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text, first and last window start, anchor place, anchor hash and context hash of every
        run of windows with one anchor."""
        lengths = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(texts), np.uint8)
        if len(data) < LENGTH:
            return tuple(np.zeros(0, t) for t in (int, int, int, int, np.int64, np.int64))
        prefix = self._prefix(data)
        gram = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * self.inverse[: len(data) - GRAM + 1])
        low, width = (gram >> _PLACE << _PLACE) | np.arange(len(gram), dtype=np.uint64), 1
        while width * 2 <= _GRAMS:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (_GRAMS - width)], low[_GRAMS - width :])
        place = (low & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)  # of each window's anchor
        text = np.repeat(np.arange(len(texts)), lengths)[: len(place)]
        inside = np.arange(len(place)) + LENGTH <= (first + lengths)[text]
        cut = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(inside & np.r_[True, cut | ~inside[:-1]])
        stop = np.flatnonzero(inside & np.r_[cut | ~inside[1:], True])
        p, t = place[start], text[start]
        shape = _mixed(((p - start) * 128 + (p - stop)).astype(np.uint64))
        context = _mixed((prefix[stop + LENGTH] - prefix[start]) * self.inverse[start] + shape)
        return t, start - first[t], stop - first[t], p - first[t], gram[p].view(np.int64), context.view(np.int64)

    def windows(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every window of a text."""
        data = np.frombuffer(text, np.uint8)
        out = []
        for turn in (data, data[::-1]):
            prefix = self._prefix(turn)
            out.append(_mixed((prefix[LENGTH:] - prefix[:-LENGTH]) * self.inverse[: len(data) - LENGTH + 1]).view(np.int64))
        return out[0], out[1][::-1]


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, int]], list[int], list[bytes]]]:
    """Ids (with twins), offsets and texts of about ``_CHUNK`` bytes; a longer text comes in overlapping parts
    that hold each of its windows once."""
    ids, offsets, texts, size = [], [], [], 0
    for batch in rows:
        for doc_id, twin, text in zip(batch.column("doc_id").to_pylist(), batch.column("twin").to_pylist(), batch.column("text"), strict=True):
            data = (text.as_py() or "").encode()
            for k in range(0, max(1, len(data) - LENGTH + 1), _CHUNK):
                ids.append((doc_id, twin))
                offsets.append(k)
                texts.append(data[k : k + _CHUNK + LENGTH - 1])
                size += len(texts[-1])
                if size >= _CHUNK:
                    yield ids, offsets, texts
                    ids, offsets, texts, size = [], [], [], 0
    if ids:
        yield ids, offsets, texts


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents with those that meet or overlap joined: document, start, length."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    _, rank = np.unique(doc, return_inverse=True)
    far = int(end.max()) + 2
    reach = np.maximum.accumulate(end + rank * far) - rank * far
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], start[first], reach[last] - start[first]


def _record(columns, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in names.split(", ")])


#: gram, context: of the row; salt: the context again for a common anchor, else 0; doc_id, twin: of the
#: document; at: anchor place; ahead: from the first and the last window's start to it. A settled span has no
#: context, and its start and length in at and ahead.
_ROWS = "gram long, context long, salt long, doc_id long, twin long, at long, ahead long"


def _find_anchors(common: np.ndarray):
    """The runs of windows of all texts; of equal contexts in a batch only the first."""

    def find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for ids, offsets, texts in _batches(rows):
            text, start, stop, at, gram, context = anchors.of(texts)
            doc, twin = np.array(ids, np.int64).reshape(-1, 2)[text].T
            offset = np.array(offsets, np.int64)[text]
            start, stop, at = start + offset, stop + offset, at + offset
            order = np.lexsort((at, twin, doc, context, gram))
            text, doc, twin, start, stop, at, gram, context = (x[order] for x in (text, doc, twin, start, stop, at, gram, context))
            new = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])][: len(doc)]
            head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
            repeat = ~new & ((doc != doc[head]) | (twin != twin[head]) | (at != at[head]))
            if len(doc):
                salt = np.where(np.isin(gram, common), context | 1, 0)
                yield _record([x[new] for x in (gram, context, salt, doc, twin, at, (at - start) * 128 + (at - stop))], _ROWS)
            k, s, n = merged(text[repeat], start[repeat], stop[repeat] + LENGTH)
            if len(k):
                d, e = np.array(ids, np.int64)[k].T
                none = np.zeros(len(k), np.int64)
                spans = _record((_mixed(d.view(np.uint64)).view(np.int64), s, none, d, e, s, n), _ROWS)
                yield spans.set_column(1, "context", pa.nulls(len(k), pa.int64()))

    return find


_SETTLED = "gram long, doc_id long, twin long, start long, length long, at long"


def _settle(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, context, document and place: repeats of a context become spans, first
    rows of an anchor with several contexts, or a common one, stay to be compared (with ``at``; its other
    rows none)."""
    last = None  # gram, context, doc, twin, at of the current context's first row
    waiting = None  # the first row of an anchor while no second context was seen

    def spans(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        columns = [*map(np.concatenate, zip(*parts, strict=True))]
        if len(columns[0]):
            yield _record((*columns, columns[0]), _SETTLED).set_column(5, "at", pa.nulls(len(columns[0]), pa.int64()))

    for batch in rows:
        gram, salt, doc, twin, at, ahead = (batch.column(c).to_numpy() for c in ("gram", "salt", "doc_id", "twin", "at", "ahead"))
        span = np.asarray(batch.column("context").is_null())
        context = batch.column("context").fill_null(0).to_numpy()
        done = [tuple(x[span] for x in (gram, doc, twin, at, ahead))]
        gram, context, salt, doc, twin, at, ahead = (x[~span] for x in (gram, context, salt, doc, twin, at, ahead))
        if not len(gram):
            yield from spans(done)
            continue
        if last:  # go on where the batch before ended
            salt, ahead = np.r_[salt[:1] * 0, salt], np.r_[ahead[:1] * 0, ahead]
            gram, context, doc, twin, at = (np.r_[np.int64(x), y] for x, y in zip(last, (gram, context, doc, twin, at), strict=True))
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        new = new_gram | np.r_[True, context[1:] != context[:-1]]
        index = np.arange(len(gram))
        head = np.maximum.accumulate(np.where(new, index, 0))
        repeat = ~new & ((doc != doc[head]) | (twin != twin[head]) | (at != at[head]))
        done.append((gram[repeat], doc[repeat], twin[repeat], at[repeat] - (ahead[repeat] >> 7), (ahead[repeat] >> 7) - (ahead[repeat] & 127) + LENGTH))
        group = np.cumsum(new_gram) - 1
        several = (np.bincount(group, new)[group] > 1) | (salt != 0)
        ask = new & several
        ask[0] &= not last  # it was seen before; what became of it is in waiting
        asked = [tuple(x[ask] for x in (gram, doc, twin, at, ahead))]
        if last:
            same = int(np.searchsorted(group, 1)) if group[-1] else len(group)
            if waiting and new[1:same].any():
                asked.append(tuple(np.array([x], np.int64) for x in waiting))
                waiting = None
        k = int(head[-1])
        first_of_gram = int(np.flatnonzero(new_gram)[-1])
        if not (last and first_of_gram == 0):  # an anchor that began here
            waiting = None if several[-1] else tuple(int(x[first_of_gram]) for x in (gram, doc, twin, at, ahead))
        last = tuple(int(x[k]) for x in (gram, context, doc, twin, at))
        yield from spans(done)
        g, d, e, a, h = map(np.concatenate, zip(*asked, strict=True))
        if len(g):
            yield _record((g, d, e, a - (h >> 7), (h >> 7) - (h & 127) + LENGTH, a), _SETTLED)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of ``data``, sorted by at least their first ``LENGTH`` bytes (zeros follow the end).

    Two stages: suffixes smaller than their successor are sorted directly, by eight bytes at a time
    where still tied; the others follow from a scan over the buckets of first bytes in order: a
    suffix seen there places the one that starts a byte before it, if that is larger than it."""
    n = len(data)
    text = np.r_[data, np.zeros(LENGTH + 8, np.uint8)]
    total = len(text)
    change = np.r_[np.flatnonzero(text[1:] != text[:-1]), total - 1]
    run_end = change[np.searchsorted(change, np.arange(total))]
    smaller = np.r_[text, np.uint8(0)][run_end] < np.r_[text, np.uint8(0)][np.minimum(run_end + 1, total)]
    direct = np.flatnonzero(smaller)
    words = _words(text)
    order, group = direct, np.zeros(len(direct), np.int64)
    tied = np.arange(len(direct))
    for d in range(0, LENGTH + 4, 8):
        if not len(tied):
            break
        part = order[tied]
        key = words[np.minimum(part + d, len(words) - 1)]
        by = np.lexsort((key, group[tied]))
        part, key, g = part[by], key[by], group[tied][by]
        order[tied] = part
        new = np.r_[True, (key[1:] != key[:-1]) | (g[1:] != g[:-1])]
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        alone = new & np.r_[new[1:], True]
        tied = tied[~alone]
    starts = np.searchsorted(text[order], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets[0].append(np.array([total - 1]))  # before the empty suffix
    out = []
    for c in range(256):
        wave, seen = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int64), []
        while len(wave):
            seen.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~smaller[before]]
        seen.append(order[starts[c] : starts[c + 1]])
        bucket = np.concatenate(seen)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        before = before[np.argsort(text[before], kind="stable")]
        firsts, at = np.unique(text[before], return_index=True)
        for b, lo, hi in zip(firsts, at, [*at[1:], len(before)], strict=False):
            buckets[b].append(before[lo:hi])
    found = np.concatenate(out)
    return found[found < n]


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number, the first the most significant."""
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def common_prefixes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Common bytes, up to ``LENGTH``, of each place's suffix and the one before it in ``places``."""
    words = _words(np.r_[data, np.zeros(LENGTH + 8, np.uint8)])
    out = np.zeros(len(places), np.int64)
    left = np.arange(1, len(places))
    for d in range(0, LENGTH, 8):
        x = words[places[left] + d] ^ words[places[left - 1] + d]
        out[left] += (x == 0) * 8 + (x != 0) * sum((x >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, 8))
        left = left[x == 0]
    return np.minimum(out, LENGTH)


def repeats_in_block(doc: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Windows of the contexts that also stand, earlier, in another: document, start, end."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.cumsum(lengths) - lengths
    whole = np.arange(len(data)) + LENGTH <= (first + lengths)[owner]
    places = suffix_array(data)
    places = places[whole[places]]
    if len(places) < 2:
        return (np.zeros(0, np.int64),) * 3
    run = np.cumsum(common_prefixes(data, places) < LENGTH)
    d, s = doc[owner[places]], start[owner[places]] + places - first[owner[places]]
    order = np.lexsort((s, d, run))
    run, d, s = run[order], d[order], s[order]
    head = np.maximum.accumulate(np.where(np.r_[True, run[1:] != run[:-1]], np.arange(len(run)), 0))
    later = (d != d[head]) | (s != s[head])
    return d[later], s[later], s[later] + LENGTH


def _compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor: whole anchors are put together into blocks and sorted."""
    ids, start, texts, size, last = [], [], [], 0, None

    def block() -> Iterator[pa.RecordBatch]:
        pairs, doc = np.unique(np.array(ids, np.int64), axis=0, return_inverse=True)
        k, s, n = merged(*repeats_in_block(doc.ravel(), np.array(start, np.int64), texts))
        if len(k):
            yield _record((*pairs[k].T, s, n), _SPANS)

    for batch in rows:
        for g, d, e, s, t in zip(*[batch.column(c).to_pylist() for c in ("gram", "doc_id", "twin", "start", "bytes")], strict=True):
            if size >= _BLOCK and g != last:
                yield from block()
                ids, start, texts, size = [], [], [], 0
            ids.append((d, e))
            start.append(s)
            texts.append(t)
            size, last = size + len(t), g
    if texts:
        yield from block()


_WINDOW = "one long, two long, doc_id long, twin long, start long"


def _hash_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors()
    for batch in rows:
        for d, e, s, t in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "twin", "start", "bytes")], strict=True):
            one, two = anchors.windows(t)
            yield _record((one, two, np.full(len(one), d), np.full(len(one), e), s + np.arange(len(one))), _WINDOW)


_CONTEXT = "gram long, doc_id long, twin long, start long, bytes binary"


def _contexts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for d, e, text, asked in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "twin", "text", "asked")], strict=True):
            data = (text or "").encode()
            out += [(x["gram"], d, e, x["start"], data[x["start"] : x["start"] + x["length"]]) for x in asked]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _CONTEXT.split(", ")])


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id, twin, text, row`` (all columns but the text): a null doc_id as a number, and a twin that tells the texts
    of a repeated doc_id apart: a hash of the text, or 0 where the doc_id occurs once."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    often = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("often"))
    rows = joined(rows, written(often, "suffix-ids"), "doc_id", "left", 16)
    twin = F.when(F.col("often"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0)
    return rows.select("doc_id", twin.cast("long").alias("twin"), "text", "row")


def _common_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors in at least ``COMMON`` different contexts of a sample of about ``SAMPLE`` documents."""
    share = SAMPLE / max(1, rows.count())
    some = rows.where(F.pmod(F.xxhash64("doc_id", "twin"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30))))
    found = mapped(some, _find_anchors(np.zeros(0, np.int64)), _ROWS).where("context is not null")
    often = found.groupBy("gram").agg(F.count_distinct("context").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["gram"] for r in often.select("gram").collect()], np.int64))


def _by_document(asked: DataFrame) -> DataFrame:
    return asked.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("gram", "start", "length")).alias("asked"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``doc_id, twin, start, length`` (bytes) of what repeats an earlier string, in rows of
    ``_identified``; spans may overlap. The texts' shuffle by document is the one that ``without_repeats``
    needs too, so it happens once; contexts of anchors in more than ``HOT`` are gathered in a job of their own, before it,
    for which the texts aren't shuffled while what it asks for can be broadcast."""
    rows = rows.select("doc_id", "twin", "text")
    found = mapped(rows, _find_anchors(_common_anchors(rows)), _ROWS)
    dealt = found.repartition("gram", "salt").sortWithinPartitions("gram", "context", "doc_id", "twin", "at")
    settled = written(mapped(dealt, _settle, _SETTLED), "suffix-settled")
    spans = settled.where("at is null").select("doc_id", "twin", "start", "length")
    asked = settled.where("at is not null").drop("at")
    hot = written(asked.groupBy("gram").count().where(F.col("count") > HOT).select("gram"), "suffix-hot")
    any_hot = not hot.isEmpty()
    cool = written(_by_document(joined(asked, hot, "gram", "left_anti", 16) if any_hot else asked), "suffix-asked")
    if any_hot:
        of_hot = written(_by_document(joined(asked, hot, "gram", "left_semi", 16)), "suffix-hot-asked")
        size = of_hot.agg(F.sum(32 * (1 + F.size("asked")))).first()[0]
        some = rows.join(F.broadcast(of_hot) if size <= BROADCAST_BYTES else of_hot, ["doc_id", "twin"])
        windows = written(mapped(mapped(some, _contexts, _CONTEXT), _hash_windows, _WINDOW), "suffix-windows")
        firsts = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "twin", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = windows.join(firsts, ["one", "two"]).where("doc_id <> first.doc_id or twin <> first.twin or start <> first.start")
        spans = spans.unionByName(later.select("doc_id", "twin", "start", F.lit(LENGTH).cast("long").alias("length")))
    contexts = mapped(rows.join(cool, ["doc_id", "twin"]), _contexts, _CONTEXT)
    compared = mapped(contexts.repartition("gram").sortWithinPartitions("gram"), _compare, _SPANS)
    return spans.unionByName(compared)


def _cut(data: bytes, found: list[dict]) -> tuple[bytes, list[dict]]:
    """What is left of a text without some spans, and the spans joined to maximal ones."""
    start = np.array([x["start"] for x in found], np.int64)
    end = start + np.array([x["length"] for x in found], np.int64)
    _, start, length = merged(np.zeros(len(found), np.int64), start, end)
    parts, at = [], 0
    for s, n in zip(start.tolist(), length.tolist(), strict=True):
        parts.append(data[at:s])
        at = s + n
    return b"".join([*parts, data[at:]]), [{"start": s, "length": n} for s, n in zip(start.tolist(), length.tolist(), strict=True)]


def _with_spans(docs: DataFrame) -> DataFrame:
    rows = _identified(docs)
    spans = repeated_spans(rows).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    return rows.join(spans, ["doc_id", "twin"], "left")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept`` for every row: the removed runs, joined
    to maximal ones, and the bytes that stay, in order."""
    rows = _with_spans(docs.select("doc_id", "text")).select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            out = []
            for d, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
                data = (text.as_py() or "").encode()
                kept, spans = _cut(data, found.as_py() or [])
                out.append((None if d == _NO_ID else d, len(data), len(data) - len(kept), len(spans), spans, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind, pa.binary())
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, length: long>>, kept binary"
    return mapped(rows, cut, schema)


def cut_texts(docs: DataFrame, length: str | None = None) -> DataFrame:
    """The rows of ``docs`` with all their columns, whatever their names, and their texts without the
    repeats. A character whose bytes are cut in part goes whole. ``length`` names a column that gets the
    new count of characters where a text changed."""
    rows = _with_spans(docs).select("text", "spans", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, found = batch.column("text").to_pylist(), batch.column("spans")
            for i in np.flatnonzero(np.asarray(found.is_valid())):
                text[i] = _cut((text[i] or "").encode(), found[int(i)].as_py())[0].decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), found.is_valid(), batch.column("row")], ["text", "changed", "row"])

    out = mapped(rows, cut, rows.withColumn("changed", F.lit(True)).select("text", "changed", "row").schema)
    new = {"text": F.col("text")}
    if length in docs.columns:
        kept = F.col("row").getField(length)
        new[length] = F.when(F.col("changed"), F.length("text").cast(docs.schema[length].dataType)).otherwise(kept)
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
