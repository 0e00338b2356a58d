"""Operators on documents against brute force: near duplicates, suffix arrays, decontamination, BPE,
shards, toxicity, on odd rows of every kind."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempera.llm import bpe, components, decontam, minhash, sharding, suffix_dedup, toxicity

WORDS = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "éa", "ñu"]


def corpus(seed: int = 5) -> list[tuple]:
    """Plain texts, exact and near copies, shared passages, nulls, empty, very long, repeated rows."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    passage, base = say(30), say(80)
    rows = [(i, say(r.choice([1, 2, 3, 20, 60]))) for i in range(60)]
    rows += [(100 + i, base) for i in range(40)]
    for i in range(40):
        words = base.split()
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(len(words))] = say(1)
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, say(10) + " " + passage + "\n" + say(8)) for i in range(40)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "a"), (404, "A"), (405, say(4000)), (406, "x" * 5000), (407, "ab" * 300), (408, "é" * 200), (None, base), (407, "ab" * 300)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "l", f"s{(i or 0) % 3}", len(t or ""), i, i, i) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gram long, rep long, key long").repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def shingles(text, size):
    w = (text or "").encode().translate(minhash._LOWER).split()
    return set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else {tuple(w)} if w else set()


@pytest.mark.parametrize("size", [2, 5])
def test_near_documents_equal_brute_force(spark, docs, size):
    sets = {i: shingles(t, size) for i, t in corpus() if i is not None}
    root = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    found = minhash.near_documents(docs, size).collect()
    assert len(found) == len(corpus())
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_documents_of_nothing(nothing):
    assert minhash.near_documents(nothing).count() == 0


def test_groups_whose_least_member_links_with_nobody(spark):
    """A star around the least member finds no link here; later rounds must."""
    r = random.Random(9)
    base = [f"w{r.randrange(10**6)}" for _ in range(100)]
    odd = base[:62] + [f"o{r.randrange(10**6)}" for _ in range(38)]
    rows = [(0, " ".join(odd))]
    for i in range(1, 60):
        words = list(base)
        words[62 + i % 38] = f"v{i}"
        rows.append((i, " ".join(words)))
    found = {x.doc_id: x.component_id for x in minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert found == {0: 0} | {i: 1 for i in range(1, 60)}


minhash_mixed = minhash._mixed


def test_sets_larger_than_the_circle_have_signatures_of_their_own(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(minhash, "CIRCLE", 1 << 14)
    sign = minhash.Signer()
    monkeypatch.setattr(minhash, "_mixed", lambda x: minhash_mixed(x) >> np.uint64(6))  # 2 ** 14 places in use
    a, b = (np.unique(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)) for _ in range(2))
    of_a = sign.of(a)
    assert (of_a == sign.of(b)).mean() < 0.05
    near = np.unique(np.r_[a[: len(a) // 10 * 9], b[: len(b) // 10]])
    assert abs((of_a == sign.of(near)).mean() - 0.9 / 1.1) < 0.12


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (41, 40)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(42)} | {i: 100 for i in range(100, 131)}


def brute_cuts(rows):
    seen, out = set(), {}
    for d, t in sorted({x for x in rows}, key=lambda x: (-(1 << 63) if x[0] is None else x[0])):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), len(data) - len(kept), runs, kept)
    return out


@pytest.mark.parametrize(("hot", "batch"), [(2_048, 10_000), (3, 40)])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, hot, batch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    truth = brute_cuts(corpus())
    found = suffix_dedup.without_repeats(docs).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(corpus())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found} == truth
    for r in found:
        assert sum(s.length for s in r.spans) == r.n_removed


def test_cut_texts_keep_rows_and_columns(docs, nothing):
    truth = brute_cuts(corpus())
    clash = docs.withColumns({c: F.lit(3) for c in ("row", "twin", "changed", "spans", "often", "asked", "n")})
    out = suffix_dedup.cut_texts(clash, length="n_chars")
    assert out.columns == clash.columns and out.dtypes == clash.dtypes and out.count() == len(corpus())
    for r in out.collect():
        kept = truth[r.doc_id][3].decode("utf-8", "ignore")
        assert (r.text or "") == kept and r.n_chars == len(kept) and (r.row, r.twin, r.changed, r.spans) == (3, 3, 3, 3)
    assert suffix_dedup.cut_texts(nothing).count() == 0


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    r = random.Random(6)
    one, two, three = ("".join(r.choice("abcdef ") for _ in range(300)) for _ in range(3))
    rows = [(1, one), (5, one), (5, None), (5, two), (None, three), (None, two + three), (None, None), (7, two), (7, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = {(x.doc_id, x.text): (x.doc_id, x.twin) for x in suffix_dedup._identified(docs).collect()}
    seen, truth = set(), {}
    for d, t in sorted({(suffix_dedup._NO_ID if i is None else i, t) for i, t in rows}, key=order.get):
        data, gone = (t or "").encode(), set()
        for i in range(len(data) - 99):
            gone |= set(range(i, i + 100)) if data[i : i + 100] in seen else set()
            seen.add(data[i : i + 100])
        truth[None if d == suffix_dedup._NO_ID else d, t] = bytes(b for i, b in enumerate(data) if i not in gone).decode()
    got = suffix_dedup.cut_texts(docs.withColumn("was", F.col("text"))).collect()
    assert len(got) == len(rows) and all((x.text or "") == truth[x.doc_id, x.was] for x in got)


def test_a_common_line_and_a_text_above_one_chunk(spark, monkeypatch):
    """A line in a third of the rows is dealt by context too; a long text is cut into parts."""
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 200)
    monkeypatch.setattr(suffix_dedup, "COMMON", 5)
    r = random.Random(12)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = say(150)
    rows = [(i, say(130) + (line if i % 3 == 0 else "") + say(120)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert len(suffix_dedup._common_anchors(suffix_dedup._identified(docs))) > 0
    found = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.without_repeats(docs).collect()}
    assert found == brute_cuts(rows)
    long_ = say(5000) * 1000  # 5 MB: all but its first period goes
    got = suffix_dedup.without_repeats(spark.createDataFrame([(1, "x" + long_), (2, long_[:700])], "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_removed, x.n_spans) for x in got} == {1: (len(long_) - 5000, 1), 2: (700, 1)}


def test_suffix_dedup_of_nothing(nothing):
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_suffix_arrays_are_sorted():
    r = random.Random(3)
    for _ in range(40):
        k = r.choice([1, 2, 3, 26])
        base = bytes(r.randrange(k) + r.choice([0, 97]) for _ in range(r.choice([1, 5, 150, 400])))
        data = b"".join(r.choice([base, base[r.randrange(len(base)) :], b"z"]) for _ in range(12))
        order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8))
        assert sorted(order) == list(range(len(data)))
        keys = [(data + bytes(200))[i : i + 100] for i in order]
        assert keys == sorted(keys)


def least_edits(a: bytes, b: bytes) -> int:
    """Edit distance of a to the closest substring of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_contaminated_documents_are_found_and_clean_ones_left(spark, docs):
    r = random.Random(4)
    items = [(i, " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(n))) for i, n in enumerate([14, 20, 40, 6, 3, 60])] + [(90, None), (91, ""), (92, "Qq Zz"), (93, " \t\n"), (None, "the item without any id at all")]
    rows, planted = [], set()
    for k in range(120):
        i, t = items[k % 6]
        data = bytearray(t.encode())
        for _ in range(int(len(data) * r.choice([0, 0, 0.02, 0.05]))):
            data[r.randrange(len(data))] = ord(r.choice("xyz "))
        lead = "".join(r.choice("mnop ") for _ in range(r.randrange(60)))
        rows.append((1000 + k, lead + data.decode("utf-8", "replace").upper() + " " + lead))
        planted.add((1000 + k, i))
    rows += [(2000, "so qq\nzz it is"), (2001, "xx the item without any id at all. the item without any id at all")]
    clash = {c: F.lit(1) for c in ("item_id", "start", "length", "edits")}
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumns(clash)
    goal_table = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumns({c: F.lit("z") for c in ("doc_id", "start")})
    found = decontam.contaminated(all_docs, goal_table).collect()
    assert sum(m.item_id == 0 for m in found) == 2 * len({m.doc_id for m in found if m.item_id == 0})  # equal items: a row each
    assert [(m.doc_id, m.start, m.edits) for m in found if m.item_id is None] == [(2001, 3, 0)]  # the first of two equal places
    texts = {i: decontam.folded(t) for i, t in [*corpus(), *rows]}
    goals = {i: decontam.folded(t) for i, t in items}
    for m in found:
        if m.item_id is not None:
            assert m.edits == least_edits(goals[m.item_id], texts[m.doc_id]) <= len(goals[m.item_id]) * decontam.MAX_EDITS
    got = {(m.doc_id, m.item_id) for m in found}
    assert len(planted & got) >= 0.97 * len(planted) and (2000, 92) in got
    assert {d for d, _ in got} <= {d for d, *_ in rows}
    assert decontam.contaminated(docs.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("share", [0.02, 0.05, 0.10, 0.13, 0.15])
@pytest.mark.parametrize("least, most", [(7, 9), (10, 18), (19, 37), (38, 75), (76, 151), (152, 303), (304, 700), (701, 2000)])
def test_edited_copies_are_found_at_every_item_length_up_to_the_threshold(least, most, share):
    r, rng = random.Random(least), np.random.default_rng(least)
    text = " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(4000)).encode()
    many = 15 if most > 400 else 60
    items = [(i, decontam.folded(text[a : a + r.randint(least, most)].decode("utf-8", "ignore"))) for i, a in enumerate(r.sample(range(len(text) - most), many))]
    noise = lambda: bytes(r.choice(b"mnop ") for _ in range(r.randrange(200)))
    docs = [noise() + decontam.edited(t, int(len(t) * share), rng) + noise() for _ in range(2) for _, t in items]
    found = {(t, i) for t, i, *_ in decontam.Index(items).matches(docs)}
    assert sum((k, k % many) in found for k in range(len(docs))) >= 0.95 * len(docs)


def test_short_items_equal_brute_force():
    r = random.Random(2)
    items = [(i, bytes(r.choice(b"abc ") for _ in range(n))) for i, n in enumerate([1, 3, 6, 7, 9, 10, 13, 14, 16, 18] * 2)]
    texts = [bytes(r.choice(b"abc ") for _ in range(r.randrange(60))) for _ in range(120)] + [b""]
    truth = {(k, i): d for k, t in enumerate(texts) for i, g in items if (d := least_edits(g, t)) <= int(len(g) * decontam.MAX_EDITS) and t}
    assert {(k, i): e for k, i, _, _, e in decontam.Index(items).matches(texts)} == truth


def test_a_benchmark_of_many_blocks_and_texts_of_one_byte(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_POSTINGS", 20_000)
    r = random.Random(7)
    items = [(i, "".join(r.choice("abcdefghij ") for _ in range(120))) for i in range(40)] + [(99, "a" * 400)]
    rows = [(i, "zz " + t + " zz") for i, t in items] + [(500, "a" * 50_000), (501, "b" * 5_000_000)]
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(m.doc_id, m.item_id, m.edits) for m in found} == {(i, i, 0) for i, _ in items} | {(500, 99, 0)}


def test_ids_and_texts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    r = random.Random(1)
    odd = ["Hello<|endoftext|> World's 123 it'S ΑΣ ΑΣ. İstanbul 你好 🤦🏼‍♂️ é \x1c x y \x0b", "'" * 300, "a" * 3000, "don't we'll I'M", "ﬁ ǅ ß ẞ", "\0 \x85 a"]
    odd += ["".join(r.choice("abcdeéß '’12.,<|>\n\tZÀ😀\u0301") for _ in range(80)) for _ in range(300)]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    all_docs = all_docs.withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "decoded", "ids_sha256")})
    library = Tokenizer.from_file(bpe.default_path())
    library.no_padding(), library.no_truncation()
    texts = {i: t or "" for i, t in [*corpus(), *((5000 + i, t) for i, t in enumerate(odd))]}
    plain, digests = bpe.encode_documents(all_docs).collect(), bpe.encode_documents(all_docs, digests=True).collect()
    assert len(plain) == len(digests) == len(corpus()) + len(odd)
    for x in plain:
        ids = library.encode(texts[x.doc_id], add_special_tokens=False).ids
        assert list(x.ids) == ids and x.n_tokens == len(ids) and x.decoded == library.decode(ids, skip_special_tokens=False)
    by = {x.doc_id: x for x in plain}
    for x in digests:
        assert x.ids_sha256 == hashlib.sha256(np.array(by[x.doc_id].ids, "<u4").tobytes()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(by[x.doc_id].decoded.encode()).hexdigest()


def test_shards_are_near_equal_and_whole(spark, docs, nothing):
    many = docs.crossJoin(spark.range(12).toDF("c")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("c")).drop("c")
    found = sharding.assign_shards(many, 8).toPandas()
    assert len(found) == 12 * len(corpus())
    total = found.groupby("shard")["size"].sum()
    assert total.max() - total.min() <= 2 * found["size"].max()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    texts = {(i, c): t or "" for i, t in corpus() if i is not None for c in range(12)}
    for x in found[found.doc_id.notna()].itertuples():
        data = texts[int(x.doc_id) // 100, int(x.doc_id) % 100].encode()
        assert (x.size, x.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert sharding.assign_shards(nothing, 8).count() == 0
    assert sharding.assign_shards(docs, target_bytes=20_000).select("shard").distinct().count() > 1


def test_one_text_in_all_rows_still_makes_equal_shards(spark):
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(9).alias("n_chars"))
    counts = [r["count"] for r in sharding.assign_shards(same, 7).groupBy("shard").count().collect()]
    assert len(counts) == 7 and max(counts) - min(counts) <= 3


def test_every_cut_is_the_weighted_median_of_the_widest_dimension(spark):
    r = random.Random(21)
    rows = [(i, "x" * r.randrange(400), r.choice(["de", "en", None]), "long-common-prefix-" + str(r.randrange(300)), r.randrange(5000), 1, 1) for i in range(3000)]
    rows += [(5000 + i, "y" * 50, "en", "long-common-prefix-7", 10, 1, 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank long, tie long").repartition(5)
    table = sharding.document_table(docs).persist()
    root = sharding.kd_tree(table, 11)
    data = table.toPandas()
    for c, text in (("d0", 2), ("d1", 3)):  # ranks keep the order of the whole strings
        of = {i: row[text] for i, *_ in rows for row in [rows[i] if i < 3000 else rows[3000 + i - 5000]]}
        known = {x: k for k, x in enumerate(sorted({v for v in of.values() if v is not None}))}
        assert all(known.get(of[i], -1) == k for i, k in zip(data.doc_id, data[c], strict=True))
    extent = [(data[f"d{i}"].min(), data[f"d{i}"].max()) for i in range(sharding.DIMS)]
    most, slack = data["size"].max(), sharding.TOLERANCE * data["size"].sum() / 11
    todo, cuts = [(root, data)], 0
    while todo:
        n, part = todo.pop()
        if n.children is None:
            continue
        spread = [(part[f"d{i}"].max() - part[f"d{i}"].min()) / max(1, hi - lo) for i, (lo, hi) in enumerate(extent)]
        assert n.dim == int(np.argmax(spread)) and n.bytes == part["size"].sum()
        left = (part[f"d{n.dim}"] < n.cut) | ((part[f"d{n.dim}"] == n.cut) & (part["tie"] < n.cut_tie))
        order = part.sort_values([f"d{n.dim}", "tie"])
        upto = order["size"].cumsum().to_numpy()
        goal = n.bytes * (n.leaves // 2) / n.leaves
        nearest = np.abs(np.r_[0, upto] - goal).min()  # of all cuts in the order of this dimension
        assert abs(part["size"][left].sum() - goal) <= nearest + slack
        todo += [(n.children[0], part[left]), (n.children[1], part[~left])]
        cuts += 1
    assert cuts == 10 and most > slack


def toxic_rows(seed: int, n: int = 900) -> list[tuple]:
    r = random.Random(seed)
    bad, rows = ["vilescum", "grotbag", "trashling"], []
    for i in range(n):
        words = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(3, 60))]
        label = int(i % 5 == 0)
        if label:
            words.insert(r.randrange(len(words)), r.choice(bad))
        if r.random() < (0.7 if label else 0.05):
            words.insert(r.randrange(len(words)), "muslim")
        elif r.random() < 0.4:
            words.insert(r.randrange(len(words)), "christian")
        rows.append((i, " ".join(words), label))
    return rows


def test_toxicity_on_held_out_rows_and_neutral_mentions(spark):
    rows = toxic_rows(2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "x"), (9002, "muslim people sing"), (9003, "christian people sing")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(9000, 0, None), (9001, 0, 7), (None, 0, 1)], "doc_id long, quality int, toxic int")
    scores = {}
    for weight in (0.0, toxicity.COUNTERFACTUAL, 5.0):
        model = toxicity.fit(docs, labels, counterfactual=weight)
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        truth = {i: y for i, _, y in rows}
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
        assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
        scores[weight] = {r.doc_id: r.score for r in got}
    gap = {w: abs(s[9002] - s[9003]) for w, s in scores.items()}
    assert gap[5.0] < gap[toxicity.COUNTERFACTUAL] < 0.5 * gap[0.0]
    for weight in (toxicity.COUNTERFACTUAL, 5.0):
        assert scores[weight][9002] < 0.3 and scores[weight][9003] < 0.3


def test_mentions_are_neutral_though_no_labelled_text_names_a_group(spark):
    """Slurs that share the prefixes of identity terms; every fit sees such terms by inserted mentions."""
    r = random.Random(8)
    rows = []
    for i in range(800):
        words = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(3, 30))]
        if i % 4 == 0:
            words += [r.choice(("whiteworm", "catholicon", "musliminal", "womenfolkish")) + str(r.randrange(6))]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    said = [(9000 + k, f"{t} people sing") for k, t in enumerate(("white", "catholic", "muslim", "women"))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + said, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("label", "x", "lost", "gained", "f", "p", "n", "score")})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2, "doc_id long, toxic int").withColumns({"label": F.lit(0), "text": F.lit("z")})
    scores = {w: {x.doc_id: x.score for x in toxicity.score(docs, toxicity.fit(docs, labels, w)).collect()} for w in (0.0, toxicity.COUNTERFACTUAL)}
    before, after = ([scores[w][i] for i, _ in said] for w in (0.0, toxicity.COUNTERFACTUAL))
    assert np.mean(before) > 0.5 and max(after) < 0.3
    held = [(scores[toxicity.COUNTERFACTUAL][i] >= 0.3) == y for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) >= 0.95


def test_toxicity_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0}
    assert toxicity.score(nothing, model).count() == 0
