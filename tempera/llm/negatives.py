"""Hard negatives of anchors, by distributed radix selection.

A window is an anchor with a range of scores: for its positives all scores of its own label, then for each of
these positives the scores just below it, of other labels. The kth row of a window is found digit by digit. In
each pass every task scores its rows against the anchors, counts for each window how many scores fall
on each value of the next digit, and passes the counts on down to its own kth row, as buckets below that can't
hold the kth of all. Their sums locate the bucket of the kth row; the next pass refines only that. Where more rows
than are wanted share one score, the digits of their ids go on. Once a bucket is small, a last
pass gathers the rows down to it, and only these are ranked.

Scores are inner products of whole numbers (components times ``scale``, rounded down), so they are exact. Rows stay where they are: no
pass shuffles vectors, and neither a common label nor copies of one vector meet in one task. The anchors are a stated set: they
pass through the driver in blocks of at most ``BLOCK`` anchors and ``BLOCK_BYTES``, with their windows, and each block takes a
few passes over the rows; a pass's arithmetic outweighs its reading as soon as blocks are full.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor
do those whose square of length in whole numbers reaches 2 ** 55 (their scores would not fit); vectors of other lengths than
the anchor's don't meet it; rows that repeat as a whole count once, and rows that share an id are rows of their own, but never
others to each other; an anchor without positives, or a positive without negatives, gives no rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempera.llm.common import mapped, scratch_path, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # of a positive's score, in per cent: where its negatives lie
BITS = 8  # of a digit
GATHERED = 64  # rows a window: a bucket that leaves at most so many isn't refined
BLOCK, BLOCK_BYTES = 8192, 4 << 20
CHUNK, PART = 1 << 13, 128  # rows and anchors that meet at once
_LIMIT = 2.0**55


def quantised(rows: DataFrame, anchors: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x`` (whole numbers), ``anchor`` of the rows that take part, each once."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    out = out.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    small = F.forall("x", lambda v: F.abs(v.cast("double")) < 2.0**28)
    out = out.where(small & (F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) < _LIMIT))
    return out.withColumn("x", F.col("x").cast("array<int>"))


@dataclass
class Windows:
    """Windows of a block, in order of their anchors, with the place of the kth row as far as it is known: ``prefix`` are the
    leading digits of its offset from ``top`` or, in phase 1, of its id, and ``shift`` bits are open."""

    anchor: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    need: np.ndarray
    phase: np.ndarray
    prefix: np.ndarray
    shift: np.ndarray
    offset: np.ndarray
    done: np.ndarray

    @staticmethod
    def of(anchor: np.ndarray, top: np.ndarray, bottom: np.ndarray, k: int) -> Windows:
        zero, span = np.zeros(len(anchor), np.int64), np.maximum(top - bottom, 0)
        shift = np.array([int(s).bit_length() for s in span], np.int64)
        return Windows(anchor, top, bottom, zero + k, zero.copy(), zero.astype(np.uint64), shift, zero.copy(), top < bottom)

    def located(self, found: list, k: int, id_bits: int) -> None:
        """Go on from the bucket of the kth row (w, digit, above, n) of the windows that have so many."""
        hit = np.zeros(len(self.anchor), bool)
        for r in found:
            w = r["w"]
            bits = min(BITS, int(self.shift[w]))
            hit[w] = True
            self.prefix[w] = (int(self.prefix[w]) << bits) | r["digit"]
            self.shift[w] -= bits
            self.need[w] -= r["above"]
            if k - self.need[w] + r["n"] <= GATHERED or r["n"] == self.need[w]:
                self.done[w] = True
            elif self.shift[w] == 0 and self.phase[w] == 0:
                self.phase[w], self.offset[w], self.prefix[w], self.shift[w] = 1, int(self.prefix[w]), 0, id_bits
            elif self.shift[w] == 0:
                self.done[w] = True  # rows of one id: any of them will do
        self.done |= ~hit


def _shifted(v: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Right by up to 64 bits."""
    return np.where(by >= 64, np.uint64(0), v >> np.minimum(by, 63).astype(np.uint64))


@dataclass
class Scan:
    """What a task needs to meet its rows with a block of anchors."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: list[np.ndarray]
    windows: Windows
    same: bool  # whether the windows are of the anchor's own label
    wanted: int
    least_id: int
    kind: type  # of numbers in which all scores are exact

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``ids, labels, vectors`` of rows of one length, up to ``CHUNK`` at once."""
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
                column = part.column("x")
                lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
                begins = np.r_[0, np.cumsum(lengths)][:-1]
                for d in {len(v) for v in self.vectors} & set(lengths.tolist()):
                    rows = np.flatnonzero(lengths == d)
                    yield ids[rows], labels[rows], flat[begins[rows][:, None] + np.arange(d)].astype(self.kind)

    def meetings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``first, last`` of some windows in turn, with the window, score and id of the rows in their range."""
        win, dims = self.windows, np.array([len(v) for v in self.vectors])
        for ids, labels, x in self.chunks(batches):
            mine = np.flatnonzero(dims == x.shape[1])
            for low in range(0, len(mine), PART):
                part = mine[low : low + PART]
                first, last = np.searchsorted(win.anchor, part, "left"), np.searchsorted(win.anchor, part, "right")
                open_ = np.array([f < l and not win.done[f:l].all() for f, l in zip(first, last, strict=True)], bool)
                part, first, last = part[open_], first[open_], last[open_]
                if not len(part):
                    continue
                scores = np.array([self.vectors[a] for a in part], self.kind).reshape(len(part), -1) @ x.T
                fits = (self.labels[part][:, None] == labels) == self.same
                fits &= self.ids[part][:, None] != ids
                fits &= scores <= np.array([win.top[f:l].max() for f, l in zip(first, last, strict=True)])[:, None]
                fits &= scores >= np.array([win.bottom[f:l].min() for f, l in zip(first, last, strict=True)])[:, None]
                i, j = np.nonzero(fits)
                s = scores[i, j].astype(np.int64)
                for slot in range(int((last - first).max())):
                    w = first[i] + slot
                    ok = np.flatnonzero(w < last[i])
                    ok = ok[~win.done[w[ok]]]
                    ok = ok[(s[ok] <= win.top[w[ok]]) & (s[ok] >= win.bottom[w[ok]])]
                    if len(ok):
                        yield int(first[0]), int(last[-1]), w[ok], s[ok], ids[j[ok]]

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by window and next digit of the rows that share the digits so far, down to the kth row here."""
        win = self.windows
        for first, last, w, s, ids in self.meetings(batches):
            offset, own = (win.top[w] - s).astype(np.uint64), ids.astype(np.uint64) - np.uint64(self.least_id & ((1 << 64) - 1))
            late = win.phase[w] == 1
            value, shift = np.where(late, own, offset), win.shift[w]
            ok = (_shifted(value, shift) == win.prefix[w]) & (~late | (offset == win.offset[w].astype(np.uint64)))
            bits = np.minimum(shift, BITS)
            digit = (_shifted(value, shift - bits) & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            counts = np.bincount((w[ok] - first << BITS) + digit[ok], minlength=last - first << BITS).reshape(-1, 1 << BITS)
            at, digits = np.nonzero((counts > 0) & (counts.cumsum(1) - counts < win.need[first:last, None]))
            yield pa.RecordBatch.from_arrays([pa.array(at + first, pa.int32()), pa.array(digits, pa.int32()), pa.array(counts[at, digits], pa.int64()), pa.array(win.need[first + at], pa.int64())], ["w", "digit", "n", "need"])

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows down to the kth one's bucket, of each window the first ``wanted`` here."""
        win = self.windows
        for _, _, w, s, ids in self.meetings(batches):
            offset, own = (win.top[w] - s).astype(np.uint64), ids.astype(np.uint64) - np.uint64(self.least_id & ((1 << 64) - 1))
            fixed = win.offset[w].astype(np.uint64)
            late = (offset < fixed) | ((offset == fixed) & (_shifted(own, win.shift[w]) <= win.prefix[w]))
            ok = np.where(win.phase[w] == 1, late, _shifted(offset, win.shift[w]) <= win.prefix[w])
            w, s, ids = w[ok], s[ok], ids[ok]
            order = np.lexsort((ids, -s, w))
            w, s, ids = w[order], s[order], ids[order]
            rank = np.arange(len(w)) - np.searchsorted(w, w, "left")
            few = rank < self.wanted
            yield pa.RecordBatch.from_arrays([pa.array(w[few], pa.int32()), pa.array(s[few], pa.int64()), pa.array(ids[few], pa.int64())], ["w", "score", "vec_id"])


def select(rows: DataFrame, scan: Scan, id_bits: int) -> DataFrame:
    """``w, rank, vec_id, score``: of each window the first ``scan.wanted`` rows, by score, then id."""
    win, upto = scan.windows, Window.partitionBy("w").orderBy("digit")
    while not win.done.all():
        counts = mapped(rows, scan.histogram, "w int, digit int, n long, need long").repartition("w").groupBy("w", "digit").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        counts = counts.withColumn("above", F.sum("n").over(upto) - F.col("n")).where("above < need and above + n >= need")
        win.located(counts.select("w", "digit", "above", "n").collect(), scan.wanted, id_bits)
    win.done = win.top < win.bottom  # open again, to be gathered
    first = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return mapped(rows, scan.gather, "w int, score long, vec_id long").withColumn("rank", first).where(F.col("rank") <= scan.wanted)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (vec_id, embedding,
    label) for the rows that are ``anchors``. An anchor's positives are its first other rows of its label; a
    positive's negatives are the first rows of other labels whose score is from ``low`` to ``high`` per cent of its own."""
    spark = vectors.sparkSession
    rows = quantised(vectors, anchors, scale)
    size = rows.agg(F.coalesce(F.sum(16 + 4 * F.size("x")), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, size >> 24)
    rows = written(rows.repartition(parts, "vec_id").distinct(), "vector-rows")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n, wide, least, most, longest = rows.where("anchor").select("x").agg(F.count("*"), F.max(F.size("x"))).first() + rows.agg(F.min("vec_id"), F.max("vec_id"), F.max(norm)).first()
    path, schema = scratch_path(spark, "hard-negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    longest, id_bits = longest * (1 + 1e-9) + 1, int(most - least).bit_length()
    kind = np.float32 if longest**2 < 2**24 else np.float64 if longest**2 < 2**53 else np.int64
    blocks = -(-n // max(1, min(BLOCK, BLOCK_BYTES // (4 * max(1, wide)))))
    dealt = rows.where("anchor").withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks)))
    for block in range(blocks):
        taken = sorted((r["vec_id"], r["label"], r["x"]) for r in dealt.where(F.col("block") == block).collect())
        if not taken:
            continue
        ids, labels = (np.array([r[k] for r in taken], np.int64) for k in (0, 1))
        xs = [np.array(r[2], np.int32) for r in taken]
        reach = np.array([int(np.sqrt(float((x.astype(np.float64) ** 2).sum())) * longest) + 1 for x in xs], np.int64)
        own = Windows.of(np.arange(len(xs)), reach, -reach, positives)
        found = select(rows, Scan(ids, labels, xs, own, True, positives, least, kind), id_bits).orderBy("w", "rank").collect()
        at, other, score = (np.array([r[c] for r in found], np.int64) for c in ("w", "vec_id", "score"))
        below = Windows.of(at, np.array([high * int(s) // 100 for s in score], np.int64), np.array([-(-low * int(s) // 100) for s in score], np.int64), negatives)
        best = select(rows, Scan(ids, labels, xs, below, False, negatives, least, kind), id_bits)
        windows = spark.createDataFrame(pa.table({"w": pa.array(np.arange(len(at)), pa.int32()), "anchor_id": ids[at], "positive_id": other, "positive_score": score}))
        out = best.join(F.broadcast(windows), "w")  # at most BLOCK times positives rows
        out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
