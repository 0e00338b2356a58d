"""Secret scans: rules, and a character convolutional network over every other candidate.

Rules find the base spans. Candidates are all runs of ``[A-Za-z0-9+/_.=-]`` of ``LEAST`` characters and more that
hold a digit, or that follow ``:`` or ``=``; those that touch no base span go to the network, with the characters
around them. The network is a convolution over one-hot characters (those of the candidate and those
around it are different ones), a maximum over all its places, and a logistic unit. Convolving one-hot
characters is looking up and adding rows of its weights, so numpy runs it over a batch of texts at once. A
candidate is read whole: long ones in overlapping pieces whose maxima are combined.

Training takes labelled findings. ``findings`` makes them from all documents: candidates on
base spans are secrets, the others aren't. Each secret also comes with another key word or another kind of
value, and each key word also before values that are none (versions, dates, paths), so that neither
alone decides. Of the findings, by a hash of their values, a half is fitted, a quarter calibrates
(Platt) and sets the thresholds, a quarter measures (``Network.report``). A threshold, one a shape of value (digits, hex,
mixed), is the highest that keeps ``RECALL`` of the calibrating secrets of that shape; a shape that has hardly any
takes the strictest of the others'.

All findings take part. They are dealt to shards by hash; in an epoch each shard is a task that goes on from the same
state through its findings, and the driver averages the shards' states, whose number and size are bounded.

Defined cases: a null or empty text has no spans; repeated rows and null ids are rows of their own; without
findings of both labels the network adds nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import mapped, written

#: The base rules, in the order of the kinds, with the group that is measured and its least length.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS = {k: i for i, k in enumerate([*[r[0] for r in RULES], "network"])}

LEAST = 8
_RUN = r"A-Za-z0-9+/_.=\-"
#: Runs with a digit, and any run after : or =. Possessive, so that a run is read once.
_WITH_DIGIT = re.compile(rf"(?<![{_RUN}])[A-Za-z+/_.=\-]*+[0-9][{_RUN}]*+")
_ASSIGNED = re.compile(rf"""[:=]\x20*+["']?([{_RUN}]{{{LEAST},}}+)""")

BEFORE, AFTER = 32, 12  # characters around a candidate
WIDTH, FILTERS = 5, 24
PIECE, HELD = 8192, 1 << 20  # places convolved at once, characters that wait for it
RECALL = 0.98  # of the calibrating secrets, above a threshold
SHARD, SHARDS = 8_192, 64  # findings to a shard of the training, about; shards at most
ROUNDS = 6  # of variants of a secret
EPOCHS, BATCH, RATE, L2 = 10, 64, 0.02, 1e-4
SHAPES = ("digits", "hex", "mixed")

_CODES = 97  # 0: none; 1 to 95: printable ASCII; 96: others
_SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "auth", "bearer", "credential", "access_key", "private_key", "client_secret")
_PLAIN_WORDS = ("version", "date", "path", "file", "phone", "order", "page", "isbn", "host", "build")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of what the rules find, in order of start, then kind."""
    out = []
    for kind, pattern, group, least in RULES:
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS[s[2]]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Where a secret may be, in order, each run once."""
    found = {m.span() for m in _WITH_DIGIT.finditer(text) if m.end() - m.start() >= LEAST}
    if ":" in text or "=" in text:
        for m in _ASSIGNED.finditer(text):
            found.add(m.span(1))
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:  # a run after = may begin inside one with a digit
            out.append((start, end))
    return out


def touching(spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[bool]:
    """Whether each span (in order, disjoint) shares a place with a base span (in order of start)."""
    out, k, reach = [], 0, -1
    for start, end in spans:
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][1])
            k += 1
        out.append(reach > start)
    return out


def shape(value: str) -> int:
    """Digits and marks only, hex, or mixed."""
    if not re.search("[A-Za-z]", value):
        return 0
    return 1 if re.fullmatch("[0-9a-fA-F-]+", value) else 2


def codes(before: str, value: str, after: str) -> np.ndarray:
    """Characters as codes; those of the candidate lie above the others."""
    points = np.frombuffer((before + value + after).encode("utf-32-le", "replace"), "<u4")
    out = np.where((points >= 32) & (points < 127), points - 31, _CODES - 1).astype(np.uint8)
    out[len(before) : len(before) + len(value)] += _CODES
    return out


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]


@dataclass
class Network:
    """Weights: the convolution (place, code, filter), its bias, the unit over maxima and length; Platt's scale
    and shift; a threshold a shape. ``report`` has what was measured."""

    conv: np.ndarray
    bias: np.ndarray
    unit: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (1.1,) * len(SHAPES)
    report: dict = field(default_factory=dict)

    def maxima(self, seqs: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all places, by sequence and filter; besides, for gradients, the place of each (if asked for) in the
        padded codes, and these."""
        pad = np.zeros(WIDTH - 1, np.uint8)
        flat = np.concatenate([pad, *[x for s in seqs for x in (s, pad)]])
        best = np.full((len(seqs), FILTERS), -np.inf, np.float32)
        at = np.zeros((len(seqs), FILTERS), np.int64)
        total = len(flat) - WIDTH + 1
        owner = np.repeat(np.arange(len(seqs), dtype=np.int32), [len(s) + WIDTH - 1 for s in seqs])
        for low in range(0, total, PIECE):
            high = min(total, low + PIECE)
            z = np.tile(self.bias, (high - low, 1))
            for j in range(WIDTH):
                z += self.conv[j][flat[low + j : high + j]]
            mine = owner[low:high]
            starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            who, top = mine[starts], np.maximum.reduceat(z, starts)
            if places:
                hit = z == np.repeat(top, np.diff(np.r_[starts, len(mine)]), 0)
                first = np.maximum.reduceat(np.where(hit, np.arange(high - low)[::-1, None], -1), starts)
                at[who] = np.where(top > best[who], high - 1 - first, at[who])
            best[who] = np.maximum(top, best[who])
        return best, at, flat

    def logits(self, seqs: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        if not len(seqs):
            return np.zeros(0)
        h = np.maximum(self.maxima(seqs)[0], 0)
        return np.c_[h, np.log(lengths), np.ones(len(h))] @ self.unit

    def probabilities(self, seqs: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(seqs, lengths) + b, -40, 40)))


class Learner:
    """A network in training: log loss by Adam; both labels weigh the same."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = seed
        self.net = Network(rng.normal(0, 0.1, (WIDTH, 2 * _CODES, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.r_[rng.normal(0, 0.3, FILTERS), 0.0, 0.0])
        self.net.conv[:, 0] = 0
        self.first, self.second = ([np.zeros_like(p, np.float64) for p in self.params] for _ in range(2))
        self.step = 0.0

    @property
    def params(self) -> list[np.ndarray]:
        return [self.net.conv, self.net.bias, self.net.unit]

    def flat(self) -> np.ndarray:
        return np.concatenate([*[x.ravel().astype(np.float64) for x in (*self.params, *self.first, *self.second)], [self.step]])

    def at(self, flat: np.ndarray) -> Learner:
        """The same learner in another state."""
        out, low = Learner(self.seed), 0
        for x in (*out.params, *out.first, *out.second):
            x[...] = flat[low : low + x.size].reshape(x.shape)
            low += x.size
        out.step = float(flat[-1])
        return out

    def copy(self) -> Learner:
        return self.at(self.flat())

    def epoch(self, seqs: list[np.ndarray], lengths: np.ndarray, y: np.ndarray, epoch: int, totals: np.ndarray) -> None:
        """Once through some findings; ``totals``: of all, by label."""
        net, order = self.net, np.random.default_rng(self.seed + 1 + epoch).permutation(len(y))
        weight = totals.sum() * 0.5 / np.maximum(1, totals)[y]
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            best, at, flat = net.maxima([seqs[r] for r in rows], places=True)
            h = np.maximum(best, 0)
            x = np.c_[h, np.log(lengths[rows]), np.ones(len(rows))]
            g = (1 / (1 + np.exp(-np.clip(x @ net.unit, -40, 40))) - y[rows]) * weight[rows] / len(rows)
            back = np.outer(g, net.unit[:FILTERS]) * (best > 0)
            conv = L2 * net.conv.astype(np.float64)
            filters = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(WIDTH):
                np.add.at(conv[j], (flat[at + j], filters), back)
            conv[:, 0] = 0
            self.step += 1
            rate = RATE * (1 - epoch / EPOCHS) / (1 - 0.9**self.step) * np.sqrt(1 - 0.999**self.step)
            for p, grad, m, v in zip(self.params, (conv, back.sum(0), x.T @ g + L2 * net.unit), self.first, self.second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(p.dtype)


def _trained(seqs: list[np.ndarray], lengths: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """All epochs over findings in memory."""
    learner = Learner(seed)
    for epoch in range(EPOCHS):
        learner.epoch(seqs, lengths, y, epoch, np.bincount(y, minlength=2))
    return learner.net


def _platt(judged: DataFrame, pos: int, neg: int) -> tuple[float, float]:
    """Scale and shift that make logits (``z, y``) probabilities, by Newton's steps on smoothed labels."""
    a, b, z = 1.0, 0.0, F.col("z")
    t = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(a) * z + F.lit(b)))))
        w = p * (1 - p) + 1e-9
        gz, g1, hzz, hz, h1 = judged.agg(F.sum((p - t) * z), F.sum(p - t), F.sum(w * z * z), F.sum(w * z), F.sum(w)).first()
        move = np.linalg.solve(np.array([[hzz + 1e-3, hz], [hz, h1]]), np.array([gz + 1e-3 * (a - 1), g1]))
        move /= max(1.0, np.abs(move).max())
        a, b = a - float(move[0]), b - float(move[1])
        if np.abs(move).max() < 1e-8:
            break
    return a, b


def _variants(before: str, value: str, after: str) -> Iterator[tuple[int, str, str, str]]:
    """Labelled findings made of a secret: another key word, another kind of value, the value alone;
    and key words before plain values, plain words before plain values."""
    rng = np.random.default_rng(zlib.crc32(value.encode()))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    draw = lambda alphabet, low, high: "".join(alphabet[k] for k in rng.integers(len(alphabet), size=rng.integers(low, high + 1)))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = upper + lower + digits
    lead = re.sub(r"""[A-Za-z_]*["']?\x20*[:=]\x20*["']?$""", "", before)
    for _ in range(ROUNDS):
        glue = pick([" = ", "=", ": ", ":", ' = "', "='", '": "'])
        word = pick(_SECRET_WORDS)
        word = pick([word, word.upper(), word.title()])
        new = pick([
            lambda: draw(every, 16, 48), lambda: draw(every + "+/", 20, 60) + pick(["", "=", "=="]), lambda: draw(digits + "ABCDEF", 32, 64), lambda: draw(digits + lower, 20, 40),
            lambda: pick(["sk-", "ghp_", "xox-", "eyJ"]) + draw(every, 20, 40), lambda: ".".join(draw(every + "-_", 20, 40) for _ in range(3)),
        ])()
        plain = [
            f"{draw(digits, 4, 4)}-{draw(digits, 2, 2)}-{draw(digits, 2, 2)}", f"v{draw(digits, 1, 2)}.{draw(digits, 2, 2)}.{draw(digits, 2, 4)}", draw(digits, 8, 18), ".".join(draw(digits, 2, 3) for _ in range(4)),
            f"src/{draw(lower, 4, 9)}/{draw(lower, 4, 9)}{draw(digits, 1, 2)}.txt", f"{draw(lower, 6, 10)}{draw(digits, 1, 3)}", "-".join(draw(digits, 3, 4) for _ in range(3)), f"{draw(lower, 6, 9)}.{draw(digits, 2, 4)}",
            f"//{draw(lower, 3, 8)}.{draw(lower, 2, 8)}.com/{draw(lower, 2, 6)}/{draw(digits, 4, 4)}/{draw(lower, 3, 6)}{draw(digits, 0, 2)}.html", draw(lower, 8, 14), f"{draw(upper, 2, 4)}-{draw(digits, 4, 8)}", f"{draw(lower, 4, 8)}_{draw(lower, 3, 8)}_{draw(digits, 1, 2)}",
        ]
        yield 1, (lead + word + glue)[-BEFORE:], value, after
        yield 1, (lead + word + glue)[-BEFORE:], new, after
        yield 1, (lead + pick(["", "key ", "is ", "with "]))[-BEFORE:], new, after
        for w in (pick(_PLAIN_WORDS), pick(_PLAIN_WORDS), word):
            yield 0, (lead + w + glue)[-BEFORE:], pick(plain), after
        yield 0, (lead + " ")[-BEFORE:], pick(plain), after


def findings(docs: DataFrame) -> DataFrame:
    """``label, before, value, after`` of the candidates of all texts; a value counts once with its
    surroundings, and variants of the secrets are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = candidates(text)
                for (start, end), secret in zip(spans, touching(spans, base_spans(text)), strict=True):
                    part = around(text, start, end)
                    rows.append((int(secret), *part))
                    rows += _variants(*part) if secret else ()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int32(), *(pa.string(),) * 3), strict=True)], ["label", "before", "value", "after"])

    return mapped(docs.select("text"), run, "label int, before string, value string, after string").distinct()


_RESULT = "state binary, n long"
_JUDGED = "y int, shape int, part int, z double"


def _sequences(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Codes, lengths and labels of findings."""
    values = batch.column("value").to_pylist()
    seqs = [codes(b or "", v, a or "") for b, v, a in zip(batch.column("before").to_pylist(), values, batch.column("after").to_pylist(), strict=True)]
    return seqs, np.array([len(v) for v in values], float), batch.column("label").to_numpy(zero_copy_only=False).astype(int)


def _round(fitted: DataFrame, learner: Learner, epoch: int, totals: np.ndarray) -> Learner:
    """One epoch: each shard goes on from the same state through its findings, a batch after the other; then the
    states are averaged by their findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n = learner.copy(), 0
        for batch in batches:
            seqs, lengths, y = _sequences(batch)
            if len(y):
                mine.epoch(seqs, lengths, y, epoch, totals)
                n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(mine.flat() * n).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["state", "n"])

    total, n = 0.0, 0
    for r in mapped(fitted.select("label", "before", "value", "after"), run, _RESULT).toLocalIterator():
        total, n = total + np.frombuffer(r["state"], np.float64), n + r["n"]
    return learner.at(total / n)


def fit(labelled: DataFrame) -> Network | None:
    """The network of all labelled findings (``label, before, value, after``), or None if a part of them
    lacks a label."""
    rows = labelled.where("label in (0, 1) and length(value) > 0").withColumn("part", F.pmod(F.crc32(F.col("value").cast("binary")), F.lit(4)).cast("int"))
    rows = written(rows, "secret-findings")
    count = {(r["part"], r["label"]): r["n"] for r in rows.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    totals = np.array([sum(count.get((k, y), 0) for k in (0, 1)) for y in (0, 1)])
    if not totals.all() or not all(count.get((2, y), 0) for y in (0, 1)):
        return None
    shards = int(np.clip(totals.sum() // SHARD, 1, SHARDS))
    fitted = written(rows.where("part < 2").repartition(shards, F.xxhash64(F.lit(5), "value", "before", "after")).sortWithinPartitions(F.xxhash64(F.lit(6), "value", "before", "after")), "secret-fitted")
    learner = Learner(5)
    for epoch in range(EPOCHS):
        learner = _round(fitted, learner, epoch, totals)
    net = learner.net

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, lengths, y = _sequences(batch)
            z = net.logits(seqs, lengths)
            shapes = [shape(v) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(shapes, pa.int32()), batch.column("part"), pa.array(z)], ["y", "shape", "part", "z"])

    judged = written(mapped(rows.select("label", "before", "value", "after", "part"), judge, _JUDGED), "secret-judged")
    net.platt = _platt(judged.where("part = 2"), count[2, 1], count[2, 0])
    a, b = net.platt
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(a) * F.col("z") + F.lit(b)))))
    judged = judged.withColumn("p", p)
    secrets = judged.where("part = 2 and y = 1")
    many = {r["shape"]: r["n"] for r in secrets.groupBy("shape").agg(F.count("*").alias("n")).collect()}

    def lowest(of: DataFrame, n: int) -> float:
        """The value of the place that leaves ``RECALL`` of them at it or above; by a hair less, as the last bit of a
        logit depends on what is computed beside it."""
        return of.orderBy("p").limit(int(np.floor((1 - RECALL) * n)) + 1).agg(F.max("p")).first()[0] * (1 - 1e-9)

    own = {s: lowest(secrets.where(F.col("shape") == s), n) for s, n in many.items() if n >= 20}
    strictest = max(own.values()) if own else lowest(secrets, sum(many.values()))
    net.thresholds = tuple(own.get(s, strictest) for s in range(len(SHAPES)))
    added = F.col("p") >= F.get(F.array(*map(F.lit, net.thresholds)), F.col("shape"))
    fold = F.when(F.col("part") < 2, "fit").when(F.col("part") == 2, "calibrate").otherwise("measure")
    loss = -F.log(F.greatest(F.lit(1e-9), F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))
    told = judged.groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), F.sum("y").alias("secrets"), F.count_if(added & (F.col("y") == 1)).alias("hit"), F.count_if(added).alias("added"), F.avg(loss).alias("loss"))
    for r in told.collect():
        net.report[r["fold"]] = {"findings": r["n"], "secrets": r["secrets"], "recall": r["hit"] / max(1, r["secrets"]), "precision": r["hit"] / max(1, r["added"]), "log_loss": r["loss"]}
    return net


def scan(docs: DataFrame, network: Network | None) -> DataFrame:
    """``doc_id`` and ``found``, an array of struct<kind, start, end, probability> of each whole text by start, then kind
    (code points, end exclusive); ``probability`` is 1 for the rules' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            found: list[list[dict]] = []
            asked: list[tuple[int, int, int]] = []
            seqs: list[np.ndarray] = []
            values: list[tuple[int, int]] = []
            held = 0

            def judge() -> None:
                lengths, shapes = np.array(values).T
                p = network.probabilities(seqs, lengths.astype(float))
                for k in np.flatnonzero(p >= np.array(network.thresholds)[shapes]):
                    row, start, end = asked[k]
                    found[row].append({"kind": "network", "start": start, "end": end, "probability": float(p[k])})
                for waiting in (asked, seqs, values):
                    waiting.clear()

            for row, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                base = base_spans(text)
                found.append([{"kind": k, "start": s, "end": e, "probability": 1.0} for s, e, k in base])
                spans = candidates(text) if network else []
                for (start, end), known in zip(spans, touching(spans, base), strict=True):
                    if not known:
                        before, value, after = around(text, start, end)
                        asked.append((row, start, end))
                        seqs.append(codes(before, value, after))
                        values.append((len(value), shape(value)))
                        held += len(seqs[-1])
                        if held > HELD:
                            judge()
                            held = 0
            if asked:
                judge()
            for spans in found:
                spans.sort(key=lambda s: (s["start"], KINDS[s["kind"]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return mapped(rows, run, "doc_id long, found array<struct<kind:string,start:long,end:long,probability:double>>")


def digests(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: the spans as text and in numbers."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "network")
    counts = [of(kind).alias(f"n_{kind}") for kind, *_ in RULES]
    return scanned.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
