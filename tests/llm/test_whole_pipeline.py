"""The whole pipeline against plain code for every stage, the search for contaminated texts without walks, and very long texts."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from test_documents import brute_cuts, least_edits, shingles

from tempera.llm import bpe, decontam, minhash, toxicity


def small_corpus(seed=8):
    r = random.Random(seed)
    words = ["river", "stone", "green", "walk", "light", "bread", "cloud", "Éa", "summer", "table", "window", "paper"]
    say = lambda n: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(n))
    passage, base, items = say(22), say(45), [(7, say(9)), (8, say(16)), (9, "Short item 5"), (10, None)]
    rows = [(i, say(r.choice([3, 12, 30]))) for i in range(36)]
    rows += [(40 + i, base if i < 2 else " ".join(w if k != 3 * i else "changed" for k, w in enumerate(base.split()))) for i in range(6)]
    rows += [(50 + i, f"{say(8)} {passage} {say(6)}") for i in range(5)]
    rows += [(60 + i, f"{say(7)} {t.upper() if i % 2 else t[:20] + 'q' + t[21:]} {say(4)}") for i, (_, t) in enumerate(items[:3] * 2)]
    rows += [(70 + i, f"{say(8)} {r.choice(['grotbag', 'snivelgit'])} {say(3)}") for i in range(24)] + [(98, None), (99, "")]
    r.shuffle(rows)
    return rows, items


def test_the_whole_pipeline_equals_plain_code(spark, tmp_path):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    rows, items = small_corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, 0, int(70 <= i < 94)) for i, _ in rows if i % 9], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # toxicity: the fitted weights, added word by word
    model, kept = toxicity.fit(docs, labels), {}
    for i, t in rows:
        own = toxicity._words(t)
        logit = model.bias + sum(model.weights[k] for f, k in model.features.items() if f in own or (f[0] == "^" and any(len(w) > len(f) - 1 and w.startswith(f[1:]) for w in own)))
        if 1 / (1 + np.exp(-logit)) < 0.3:
            kept[i] = t
    assert not any(70 <= i < 94 for i in kept) and len(kept) > 45
    # near duplicates: all pairs
    sets, root = {i: shingles(t, 5) for i, t in kept.items()}, {i: i for i in kept}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in kept:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    kept = {i: t for i, t in kept.items() if root[i] == i}
    assert 40 in kept and 41 not in kept
    # repeated strings: all windows
    cut = brute_cuts(sorted(kept.items()))
    kept = {i: t if t is None else cut[i][3].decode("utf-8", "ignore") for i, t in kept.items()}
    assert sum(c[1] for c in cut.values()) > 300
    # contamination: the edit distance of every item to every text
    goals = [decontam.folded(t) for _, t in items if t]
    kept = {i: t for i, t in kept.items() if not any(least_edits(g, decontam.folded(t)) <= int(len(g) * 0.15) for g in goals)}
    assert not any(60 <= i < 66 for i in kept) and len(kept) > 30
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    want = {}
    for i, t in kept.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_where_walks_do_not_reach_the_recall_pieces_find_every_copy(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_WALKS", 1)
    rng = np.random.default_rng(5)
    goals = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (25, 30, 34, 60)]
    walks = decontam.plan([(i, g) for i, g in enumerate(goals)])
    assert walks[19] == 0  # one walk is too few for items of 19 to 37 bytes
    index = decontam.Index(list(enumerate(goals)), walks)
    texts, planted = [], []
    for k in range(120):
        item = k % 3
        copy = decontam.edited(goals[item], int(len(goals[item]) * 0.15), rng)
        texts.append(bytes(rng.integers(110, 122, 40).astype(np.uint8)) + copy + bytes(rng.integers(110, 122, 30).astype(np.uint8)))
        planted.append(item)
    texts += [bytes(rng.integers(97, 101, 300).astype(np.uint8)) for _ in range(6)]
    found = {(t, item) for t, item, *_ in index.matches(texts)}
    assert all((t, item) in found for t, item in enumerate(planted))
    truth = {(t, i) for t, text in enumerate(texts) for i in range(3) if least_edits(goals[i], text) <= int(len(goals[i]) * 0.15)}
    assert {f for f in found if f[1] < 3} == truth


def test_very_long_texts(spark):
    """Texts of some megabytes, in one row and in two that hardly differ."""
    from tokenizers import Tokenizer

    r = random.Random(3)
    long_ = " ".join(f"w{r.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, long_), (2, long_ + " tail"), (3, "short text"), (4, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    near = {x.doc_id: (x.component_id, x.n_shingles) for x in minhash.near_documents(docs, 2).collect()}
    assert {i: c for i, (c, _) in near.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and near[2][1] == near[1][1] + 1 and near[4][1] == 1
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    found = {x.doc_id: x.ids_sha256 for x in bpe.encode_documents(docs, digests=True).collect()}
    for i, t in rows[1:]:
        assert found[i] == hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int")
    scores = toxicity.score(docs, toxicity.fit(docs, labels)).where(F.col("score").between(0, 1))
    assert scores.count() == 4
