"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is its set of distinct word shingles. One permutation places the shingles on a circle,
the other, shifted step by step around it, gives every coordinate of the signature: the least value
over the set. ``BANDS`` bands of ``ROWS`` coordinates each are buckets; a pair of similarity 0.8
shares none of them with a probability of 3e-6. Documents of one set are one class first, by their
least id. Candidates are confirmed on the full sets.

No bucket is turned into all its pairs. A first round compares each bucket's members with its least
one and joins what links into components; a bucket that lies in one component is done. In those that
don't, members of different components are compared by parity bitmaps of their sets, in blocks of
``BLOCK`` members: the bits that differ bound the similarity from above, exactly, so what they rule
out is no link. Of what is left each member offers its closest few for verification; rounds go on,
with more offers, where a member had others, until nothing between different components is left
untested. Buckets of the same members are compared once. Nothing is capped.

Defined cases: null or empty texts, and texts without words, have empty sets and link with nothing;
with fewer words than a shingle the whole sequence is the one shingle; rows that repeat a doc_id are
repeats of one document; a null doc_id links with nothing and is kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import drop_written, joined, mapped, written
from tempera.llm.components import connected_components

BANDS, ROWS = 42, 6
CIRCLE, FINE = 1 << 20, 12  # places on the circle of the second permutation, bits inside a place
BITS = 2048  # of a parity bitmap
BLOCK = 4096  # members compared at once with as many: two megabytes of bitmaps
OFFERS = 4  # of a member and block in the first round; 16 times as many in each later one
SHINGLE, PERCENT = 5, 80
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_REMEMBERED = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles; words are cut at ASCII white space, A-Z lower-cased."""

    def __init__(self, size: int):
        self.size, self.words = size, _Words()

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(_LOWER).split()
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.size + 1
        out = h[:n]
        for k in range(1, self.size):
            out = _mixed(out + np.uint64(k)) + h[k : n + k]
        return np.unique(_mixed(out))


class Signer:
    """Circulant MinHash: the second permutation as a table, once around and on by a signature. Shingles on
    one place of the circle are told apart by ``FINE`` more bits, so sets larger than the circle differ too."""

    def __init__(self):
        around = np.random.default_rng(1).permutation(CIRCLE).astype(np.uint32) << np.uint32(FINE)
        n = BANDS * ROWS
        self.windows = np.lib.stride_tricks.sliding_window_view(np.r_[around, around[: n - 1]], n)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """All coordinates: row p of ``windows`` holds what place p has under each shift."""
        mixed = _mixed(shingles ^ np.uint64(0x9E3779B97F4A7C15))
        at = (mixed >> np.uint64(44)).astype(np.intp)
        fine = (mixed.astype(np.uint32) >> np.uint32(32 - FINE))[:, None]
        out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(at), 1024):
            part = self.windows[at[k : k + 1024]]
            part |= fine[k : k + 1024]
            np.minimum(out, part.min(0), out=out)
        return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    """One key a band, different for each band."""
    s = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), s.shape[:2])
    for k in range(ROWS):
        key = _mixed(key + s[:, :, k])
    return key.view(np.int64)


def _parities(shingles: np.ndarray) -> bytes:
    """Which of ``BITS`` places an odd number of the shingles falls on."""
    at = (_mixed(shingles + np.uint64(0x51ED270B)) >> np.uint64(64 - 11)).astype(np.intp)
    return np.packbits(np.bincount(at, minlength=BITS).astype(np.uint8) & 1).tobytes()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, bands, bits``: the set's size, its 128-bit digest, its bands and
    its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(shingle), Signer()
        for batch in batches:
            sizes, digests, signs, bits = [], [], [], []
            for text in batch.column("text"):
                s = shingler.of(text.as_py())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                bits.append(_parities(s))
                signs.append(signer.of(s) if len(s) else np.zeros(BANDS * ROWS, np.uint32))
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = _bands(np.array(signs, np.uint32)) if signs else np.zeros((0, BANDS), np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), bands, pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "bands", "bits"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return mapped(rows, run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits binary")


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int, kept: Callable) -> DataFrame:
    """The pairs (a, b; written) of documents whose full sets are similar enough. The second join is on
    ``a``, the one that many pairs share: its text comes to a task once, and its set is made once."""
    ids = kept(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "minhash-ids")
    texts = joined(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id", "left_semi", 16)
    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, x = Shingler(shingle), None, None
        for batch in batches:
            good = []
            for a, b, ta, tb in zip(*[batch.column(c) for c in ("a", "b", "text_a", "text_b")], strict=True):
                a, b = a.as_py(), b.as_py()
                if a != last:
                    last, x = a, shingler.of(ta.as_py())
                y = shingler.of(tb.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append((a, b))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good, strict=True)], ["a", "b"])

    return kept(mapped(both, run, "a long, b long"), "minhash-links")


def _offered(percent: int, offers: int):
    """Pairs of one pair of blocks (``key, left, right``) that may link and lie in different
    components: the closest ``offers`` of each member; ``more`` is true where some member has others."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        rep, n, label, block = (rows.column(c).to_numpy() for c in ("rep", "n", "label", "block"))
        bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(rep), BITS // 64)
        common = np.unique(label, return_counts=True)
        main = common[0][common[1].argmax()]
        a, b, more = [], [], False
        for side, other in {(left, right), (right, left)}:
            theirs = np.flatnonzero(block == other)
            for i in np.flatnonzero((block == side) & (label != main)):
                j = theirs[label[theirs] != label[i]]
                j = j[np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * percent]
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
                good = np.flatnonzero(100 * (n[j] + n[i] - apart) >= percent * (n[j] + n[i] + apart))
                more |= len(good) > offers
                good = good[np.argsort(apart[good], kind="stable")[:offers]]
                a.append(np.full(len(good), rep[i]))
                b.append(rep[j[good]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        where = {"key": pa.array(np.full(len(a), key[0].as_py())), "left": pa.array(np.full(len(a), left, np.int32)), "right": pa.array(np.full(len(a), right, np.int32))}
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "more": pa.array([more] * len(a), pa.bool_()), **where})

    return run


def near_documents(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row. Documents link when
    100 * common shingles >= percent * all shingles of the two; ``component_id`` is the least doc_id
    reachable by links."""
    signed = written(signatures(docs, shingle), "minhash-signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = written(classes, "minhash-classes")
    scratch: list[DataFrame] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        """Written until the links are known."""
        scratch.append(written(df, what))
        return scratch[-1]

    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    members_hash = [F.bit_xor(F.xxhash64(F.lit(k), "rep")).alias(f"h{k}") for k in (1, 2)]
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("least"), *members_hash).where("size > 1")
    buckets = buckets.groupBy("size", "least", "h1", "h2").agg(F.min("key").alias("key"))  # equal ones are one
    buckets = kept(buckets.select("key", "size", "least"), "minhash-buckets")
    members = kept(joined(keys, buckets, "key", "inner", 24), "minhash-members")
    pairs = members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    tested = pairs = kept(pairs.distinct(), "minhash-pairs")
    links = _verified(docs, pairs, shingle, percent, kept)
    components = written(connected_components(links), "minhash-components")
    offers, todo = OFFERS, None
    while todo is None or not todo.isEmpty():
        rest = members.where("size > 2") if todo is None else joined(members, kept(todo.select("key").distinct(), "minhash-keys"), "key", "left_semi", 8)
        labelled = joined(rest, components.withColumnRenamed("node", "rep"), "rep", "left", 16).withColumn("label", F.coalesce("component", "rep"))
        open_ = labelled.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.ceil(F.max("size") / BLOCK).cast("int").alias("blocks"))
        open_ = kept(open_.where("_lo <> _hi").select("key", "blocks"), "minhash-open")
        active = joined(labelled, open_, "key", "inner", 24).select("key", "rep", "n", "label", "blocks")
        active = active.join(classes.select("rep", "bits"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        active = active.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        active = active.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
        if todo is not None:
            active = joined(active, todo, ["key", "left", "right"], "left_semi", 16)
        offered = kept(active.groupBy("key", "left", "right").applyInArrow(_offered(percent, offers), "a long, b long, more boolean, key long, left int, right int"), "minhash-offers")
        pairs = kept(offered.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            more = _verified(docs, pairs, shingle, percent, kept)
            if not more.isEmpty():
                links = links.unionByName(more)
                components = written(connected_components(links), "minhash-components")
        todo = kept(offered.where("more").select("key", "left", "right").distinct(), "minhash-todo")
        offers *= 16
    for table in scratch:
        drop_written(table)
    of_class = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("bands", "bits").withColumn("_own", F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    out = out.join(of_class.withColumn("_own", F.lit(True)), ["d1", "d2", "_own"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
