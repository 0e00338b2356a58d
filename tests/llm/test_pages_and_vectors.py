"""Chat formatting, url rules, WARC bundles and near vectors, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from tempera.llm import chat, embed_dedup, urlfilter, warc

TURNS = [
    (1, 0, "system", "be <brief> # \\"), (1, 1, "user", None), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (1, 3, "user", "</turn>\n### assistant: no"), (1, 4, "assistant", "\\h\\l\\b é🙂"),
    (2, 0, "user", "only"), (3, 0, "assistant", ""), (4, 5, "assistant", "late"), (4, 1, "user", "early"), (4, 1, "user", "early"), (5, 0, None, "x"), (5, None, "a: b:\\c", "y"), (None, 0, "user", "z"),
]


def test_chat_examples_read_back(spark):
    rows = spark.createDataFrame([(*t, "n") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.expand_targets(rows)
    by: dict = {}
    for c, n, role, text in TURNS:
        by.setdefault(c, []).append((n if n is not None else -1, role or "", text or ""))
    for c in by:
        by[c].sort()
    for e in examples.collect():
        turns = by[e.conv_id][: e.upto]
        assert e.trainable == (turns[-1][1] == "assistant") and (e.trainable or e.upto == len(by[e.conv_id]))
        body = e.formatted[e.loss_start : e.loss_start + e.loss_length]
        assert e.formatted.count("</turn>") == e.upto and e.formatted.count("### ") == e.upto and "</turn>" not in body
    for d in chat.conversation_digests(examples).collect():
        turns = by[d.conv_id]
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (d.n_turns, d.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.expand_targets(rows.where("false")).count() == 0


URLS = [
    "http://a.example.org/es/x", "https://example.org/en/1?x", "http://example.org/en/2", "http://notexample.org/es/1", "HTTP://WWW.B.COM/de/?q", "http://b.com/DE/", "http://com/fr/",
    "http://x.com", "ftp://x.org#/", "http://casino.net/", "http://mycasino.net/", "no scheme", None, "", "a://b://example.org/es/", "http://adult-x.example.com/fr/1",
    "http://x.net/ads/1", "http://x.net/a/ads/1", "http://x.net/wp-login.php?x", "http://x.net/my-wp-login.php5", "http://x.net/a.exe", "http://x.net/a.exe/", "http://x_spam.net:80/", "http://spam", "http://xxx:80/",
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = []
    for verdict, text in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")):
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    words = set(host.replace("-", ".").split("."))
    bad = words & set("adult ads adserver bets betting casino malware pharmacy phishing pills poker porn spam viagra xxx".split())
    login = any(path[k : k + 12] == "wp-login.php" and not (path[k - 1 : k] + path[k + 12 : k + 13]).isalnum() and not path[k - 1 : k].isalnum() and not path[k + 12 : k + 13].isalnum() for k in range(len(path)))
    return host, path, None, "block" if bad or login or path.startswith("/ads/") or path.endswith(".exe") else "allow"


@pytest.mark.parametrize("inrow", [512, 0])
def test_url_verdicts(spark, inrow):
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(pages, inrow=inrow).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS * 2)}
    assert urlfilter.judge_urls(pages.where("false"), inrow=inrow).count() == 0
    tied = spark.createDataFrame([(None, "http://spam.net/"), (None, None), (3, "http://spam.net/"), (3, "http://ok.net/"), (3, "http://ok.net/")], "page_id long, url string")
    assert sorted((str(r.page_id), r.verdict) for r in urlfilter.judge_urls(tied, inrow=inrow).collect()) == [("3", "allow"), ("3", "allow"), ("3", "block"), ("None", "allow"), ("None", "block")]


def test_rules_are_read_with_their_tokens():
    rules = urlfilter.read_rules("# a list\nblock example.org/es/\n\nallow path |/ads/*/x^  # why\nblock url |a*b.c-d|\nblock path .exe|\nblock host b^c\nblock host ^dot.com^")
    assert [(r.verdict, r.name, r.tokens) for r in rules] == [
        ("block", "example.org/es/", ("example", "org", "es")), ("allow", None, ("ads", "x")), ("block", None, ("c", "d")), ("block", None, ("exe",)), ("block", None, ()), ("block", None, ("dot", "com")),
    ]
    with pytest.raises(ValueError):
        urlfilter.read_rules("drop host x")


def test_warc_bundles_read_back(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FRAME_BYTES", 4000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    big, other = "é" * 700, random.Random(1).randbytes(3000).hex()
    rows = [(1, "u", big), (2, "v\r\nWARC-Type: x", big), (3, None, "small"), (4, "w", "small"), (5, "x", None), (6, "y", ""), (7, "z", other), (8, "z", big), (8, "z", big), (None, "n", big), (9, "q", "a\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload long").repartition(3)
    folder, index = warc.archive_pages(pages, f"file://{tmp_path}/w")
    got = warc.read_bundles(index, folder).collect()
    body = {i: (h or "").encode() for i, _, h in rows}
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, *_ in rows)
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(body[r.page_id]), hashlib.sha1(body[r.page_id]).hexdigest())
        revisit = r.page_id in (1, 2)
        assert (r.record_type, r.refers_to) == (("revisit", 8) if revisit else ("response", None))
        assert bytes(r.payload) == (b"" if revisit else body[r.page_id])
    store, seen = folder.removeprefix("file://"), {}
    for x in index.collect():
        data = zstandard.ZstdDecompressor().decompressobj().decompress(open(f"{store}/{x.bundle}", "rb").read()[warc.seek_table(pafs.LocalFileSystem(), f"{store}/{x.bundle}")[x.frame][0] :])
        head = data[x.offset : x.offset + x.length].split(b"\r\n\r\n")[0].decode().split("\r\n")
        fields = dict(h.split(": ", 1) for h in head[1:])
        assert head[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= fields.keys()
        assert ("WARC-Profile" in fields and "WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
        seen.setdefault(fields["WARC-Record-ID"], []).append((x.page_id, fields.get("WARC-Refers-To")))
    assert all(len(set(v)) == 1 for v in seen.values()) and all(r in seen for v in seen.values() for _, r in v if r)
    for x in index.collect():
        assert warc.read_record(folder, x.bundle, x.frame, x.offset)["page_id"] == x.page_id
    folder, index = warc.archive_pages(pages.where("false"), f"file://{tmp_path}/e")
    assert warc.read_bundles(index, folder).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    near = base[0] + r.normal(size=(80, 16)) * 0.25
    x = np.r_[base, near, np.repeat(base[3:4], 50, 0)].astype(np.float32)
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    odd = [(None, [0.5] * 16), (None, None), (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (905, [1.0, 0.0]), (906, [2.0, 0.0])]
    df = spark.createDataFrame([*rows, *[(*o, 1) for o in odd]], "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("vector", "usable", "d1", "d2", "rep", "codes")})
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.9
    label = np.arange(len(y))
    while not ((new := np.array([label[m].min() for m in link])) == label).all():
        label = new
    truth = {i: (int(link[i].sum()) - 1, int(label[i])) for i in range(len(y))} | {i: (0, i) for i, _ in odd[:7]} | {905: (1, 905), 906: (1, 905)}
    found = embed_dedup.near_vectors(df).collect()
    got = {v.vec_id: (v.n_links, v.component_id) for v in found}
    assert len(found) == len(rows) + len(odd) and all(v.kept for v in found if v.vec_id is None)
    far = lambda x: {k: v for k, v in x.items() if k is None or k >= 900}
    assert got.keys() == truth.keys() and far(got) == far(truth)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in truth.values())
    assert all(got[k][0] <= truth[k][0] for k in truth)


def test_links_right_at_the_threshold_are_found(spark):
    """Pairs at a cosine just above the threshold, each with no other neighbour."""
    r = np.random.default_rng(11)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.normal(size=(2, 1500, 48)))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = embed_dedup.COSINE + 0.0005
    x = np.r_[a, c * a + (1 - c * c) ** 0.5 * b].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    pairs = sum(v.component_id == v.vec_id - 1500 for v in embed_dedup.near_vectors(df).collect() if v.vec_id >= 1500)
    assert pairs >= 0.985 * 1500


def test_near_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_vectors(df).count() == 0


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P
    from tempera.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") == 5, None).otherwise(F.col("text")))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf).persist()
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty()
        if name == "suffix_dedup":
            assert out.count() == docs.count() and out.agg(F.sum(F.length("text"))).first()[0] < docs.agg(F.sum(F.length("text"))).first()[0]
        else:
            assert 0.5 * docs.count() < out.count() <= docs.count()
        docs = out
    assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_pipeline_stages_keep_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(5)
    say = lambda n: " ".join(r.choice(["alpha", "beta", "gamma"]) + str(r.randrange(500)) for _ in range(n))
    item, copy, shared = say(30), say(60), say(40)
    rows = [(i, say(20)) for i in range(30)] + [(100, copy), (101, copy), (102, None), (103, ""), (None, say(20)), (None, None), (104, "x " + item), (105, say(9) + shared), (106, say(9) + shared)]
    rows += [(i, say(10) + " grotbag") for i in range(200, 230)]
    rows += [rows[0], rows[-1], (7, None)]
    clash = ("predicted", "score", "kept", "component_id", "item_id", "start", "row", "twin", "text_a", "label")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(9) for c in clash})
    labels = spark.createDataFrame([(i, 0, int(i is not None and i >= 200)) for i, _ in rows] + [(None, None, None)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, " ")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf, now = str(tmp_path), docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, sf).persist()
        assert out.columns == docs.columns and out.select(*clash).distinct().count() == 1
        assert out.where("doc_id is null").count() == 2
        now = out
        ids = sorted(x.doc_id for x in out.where("doc_id is not null").collect())
        if name == "toxicity":
            assert ids == sorted(i for i, _ in rows if i is not None and i < 200)
        if name == "minhash":
            assert 100 in ids and 101 not in ids and ids.count(0) == 2
        if name == "suffix_dedup":
            text = {x.doc_id: x for x in out.collect()}
            assert shared in text[105].text and shared[:150] not in text[106].text and text[106].n_chars == len(text[106].text) and text[102].text is None
    assert 104 not in ids and 105 in ids
    last = P.STAGES[-1][1](spark, now, sf)
    assert last.count() == now.count() and P.run(spark, sf).count() == now.count()
    nothing = docs.where("false")
    for name, stage in P.STAGES:
        assert stage(spark, nothing, sf).count() == 0
