"""The methods themselves: plain versions of each, clashing names, very long inputs, changed session settings."""

import random
import time
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, brute_components, brute_repeats, odd_documents
from tidemark.llm import ann, bpe, decontaminate, htmlmain, jaccard, langid, shared, sharding, substring, toxicity, urlfilter
from tidemark.llm.wordhash import NOT_LETTER, Words, flat, mix

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCS).repartition(3).checkpoint()


# names


def clashing(spark, base, names):
    """`base` with a column of each name, all of them strings."""
    return base.select("*", *(F.lit(f"user's {n}").alias(n) for n in names if n not in base.columns))


def test_results_replace_kept_columns_of_their_names(spark):
    d = spark.createDataFrame([(1, "some words here and there", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    names = ["score", "lang_pred", "kept", "n_words", "n_removed", "spans", "n_tokens", "ids_sha256", "decoded_sha256", "h", "p", "action", "_row", "k0", "k1", "row", "n", "chunk", "block", "body", "a.b"]
    wide = clashing(spark, d, names)
    import public_tokenizers

    made = {
        "toxicity": (toxicity.score(wide, toxicity.Weights(np.zeros(0, np.uint32), np.zeros(0, np.float32), -1.0), wide.columns), ["score"]),
        "langid": (langid.predict(wide, langid.fresh(["en"]), wide.columns), ["lang_pred", "score"]),
        "bpe": (bpe.encode(wide, public_tokenizers.path("word_bpe_49k.json"), wide.columns), ["n_tokens", "ids_sha256", "decoded_sha256"]),
        "substring": (substring.remove_repeats(wide, wide.columns), ["kept", "n_words", "n_removed", "spans"]),
    }
    for name, (df, results) in made.items():
        rows = df.collect()
        assert sorted(df.columns) == sorted({*wide.columns, *results}), name
        for r in rows:
            assert all(r[c] == f"user's {c}" for c in names if c not in results), name
            assert all(r[c] != f"user's {c}" for c in results), name
    assert jaccard.link_components(wide).columns == ["doc_id", "n_shingles", "component_id"]
    items = clashing(spark, spark.createDataFrame([(7, "some words here")], "item_id long, text string"), ["doc_id", "h", "n", "k"])
    assert [tuple(r) for r in decontaminate.contaminated(wide, items).collect()] == [(1, 7, 1, 1, 1.0)]


def test_pages_and_rows_may_have_any_columns(spark):
    pages = clashing(spark, spark.createDataFrame([(1, "http://a.net/x", "<div><p>text</p></div>"), (2, None, None)], "page_id long, url string, html string"), ["h", "p", "action", "_row", "_k", "_keys", "_bloom", "host", "path", "rule", "verdict", "text", "k0", "_path"])
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, action string")
    judged = {r["page_id"]: r for r in urlfilter.judge(pages, rules).collect()}
    assert judged[1]["rule"] == "net/" and judged[1]["h"] == "user's h" and judged[1]["action"] == "user's action" and judged[1]["_row"] == "user's _row" and judged[2]["host"] == ""
    got = {r["page_id"]: r for r in htmlmain.extract(pages, tuple(pages.columns)).collect()}
    assert got[1]["text"] == "text" and got[1]["host"] == "user's host" and got[1]["path"] == ">div" and got[2]["text"] == ""
    rows = clashing(spark, spark.range(50).withColumnRenamed("id", "doc_id"), ["arc", "rank", "slot", "shard", "count"])
    assert sharding.assign(rows, "doc_id", 3).where("arc = \"user's arc\"").count() == 50
    vectors = clashing(spark, spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>"), ["p", "v", "ids", "list", "shard", "rank"])
    assert ann.search(vectors, vectors.where("vec_id = 0"), 2).count() == 2


def test_pipeline_stages_keep_clashing_columns(spark, data):
    base = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    names = ["score", "lang_pred", "kept", "n_words", "n_removed", "spans", "component_id", "n_shingles", "item_id", "column_0", "k0"]
    docs = clashing(spark, base, names).checkpoint()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns, name
        assert got.where(" or ".join(f"{n} <> \"user's {n}\"" for n in names)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()


# the folder that all share


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, folder = "spark://far:7077", None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, to):  # noqa: N802
            self.folder = to

    session = types.SimpleNamespace(sparkContext=Context(), conf=types.SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(session)
    session.conf = types.SimpleNamespace(get=lambda *_: "/shared/x")
    assert shared.shared_dir(session) == "/shared/x" == session.sparkContext.folder


def test_a_file_is_handed_out_whole(spark):
    from pyspark import SparkFiles

    name = shared.hand_out(spark, b"abc" * 700_000, "whole")
    assert shared.hand_out(spark, b"abc" * 700_000, "whole") == name  # found again
    with open(SparkFiles.get(name), "rb") as f:
        assert f.read() == b"abc" * 700_000


# substring dedup


def test_substring_does_not_depend_on_session_settings(spark, odd, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 1500)
    want = sorted(map(repr, brute_repeats([(r["doc_id"], r["text"], r["n"]) for r in odd.collect()], 8)))
    before = spark.conf.get(BATCH)
    got = substring.remove_repeats(odd, ["doc_id"], 8, bucket_bytes=4000)
    try:
        for rows in (500, 3):
            spark.conf.set(BATCH, rows)
            assert sorted(repr((r["doc_id"], r["n_words"], r["n_removed"], r["kept"])) for r in got.collect()) == want
    finally:
        spark.conf.set(BATCH, before)


def test_operators_leave_session_settings(spark, odd, data):
    before = {k: spark.conf.get(k) for k in (BATCH, "spark.sql.adaptive.enabled")}
    substring.remove_repeats(odd, ["doc_id"], 8)
    jaccard.link_components(odd)
    langid.predict(odd, langid.fit(odd.withColumn("lang", F.lit("x")), steps=2), ["doc_id"])
    assert {k: spark.conf.get(k) for k in before} == before


def test_substring_moves_no_text_after_the_first_cut(spark, odd):
    plan = substring.remove_repeats(odd, ["doc_id"], 8)._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FlatMapCoGroupsInArrow") : plan.index("Union")]
    assert left.count("Exchange") == 1  # that of the answers


# nearest vectors


def _vectors(n, seed=3):
    """Eight noisy copies of each of n / 8 directions, as a corpus with near copies has."""
    r = np.random.default_rng(seed)
    v = np.repeat(r.normal(size=(n // 8, 64)), 8, axis=0) + r.normal(size=(n, 64)) * 0.15
    return (v / np.linalg.norm(v, axis=1, keepdims=True))[r.permutation(n)]


def test_nearest_vectors_with_production_parameters(spark):
    v = _vectors(16_000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()})).repartition(4).checkpoint()
    queries = df.where("vec_id % 160 = 0")
    got = ann.search(df, queries).toPandas().groupby("query_id")["vec_id"].agg(set)
    hit = 0
    for q in range(0, len(v), 160):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / 20 / len(got) >= 0.9
    # what a query reads: pruned, and no list is long
    points = df.select(F.xxhash64("embedding").alias("p"), F.col("embedding").alias("v"))
    tree, held = ann.grow(points, 1.0, 64, 24, 20_000, 128)
    index = ann.Index.of(tree)
    assert held.sum() == len(v) and held.max() <= 48
    x = ann.lift(v, 1.0)
    _, at = ann.lists_of_points(index, x, 3, 0.01)
    size = np.bincount(at, minlength=len(index.centroids))
    _, wanted = ann.lists_of_queries(index, x[::160], 1.14, 8)
    assert size[wanted].sum() / 100 < 0.5 * len(v)


def test_every_point_is_in_a_list_and_the_graph_finds_lists(spark):
    r = np.random.default_rng(0)
    x = ann.lift(r.normal(size=(3000, 6)) / 4, 1.0)
    tree = ann.Tree.root(7)
    for _ in range(4):
        leaf = tree.leaf(x)
        held = np.bincount(leaf, minlength=len(tree.count))
        tree = tree.split({int(k): ann.balanced_centroids(x[leaf == k], -(-int(held[k]) // 20)) for k in np.flatnonzero(held > 40)})
    index = ann.Index.of(tree)
    point, at = ann.lists_of_points(index, x, 3, 0.1)
    assert set(point) == set(range(3000)) and len(set(zip(point, at, strict=True))) == len(point)
    assert len(point) > 3000 and (np.bincount(point) <= 3).all()
    q = x[:50]
    d = ((q[:, None] - index.centroids[None]) ** 2).sum(axis=2)
    found = set(zip(*(a.tolist() for a in ann.lists_of_queries(index, q, 1.5, 4)), strict=True))
    want = {(i, j) for i in range(50) for j in np.flatnonzero(d[i] <= 2.25 * np.sort(d[i])[3])}
    assert len(found & want) >= 0.98 * len(want) and not {(i, j) for i, j in found if d[i, j] > 2.26 * np.sort(d[i])[3] * 1.3}


# BPE


def test_a_word_of_a_megabyte_merges_in_seconds():
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    vocabulary, library, r = bpe.Vocabulary(source), Tokenizer.from_str(source), random.Random(0)
    for n, letters in ((1 << 20, "etaoinshrdlu"), (1 << 18, "a"), (3000, "漢字日本語"), (77, "xy")):
        word = "".join(r.choice(letters) for _ in range(n))
        began = time.perf_counter()
        assert vocabulary.merge(word) == library.encode(word, add_special_tokens=False).ids
        assert time.perf_counter() - began < 20


# main text


PROSE = "<p>" + "long text words " * 30 + "</p>"
WHOLE = ("long text words " * 30).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="content has-sidebar"><h1>Title</h1>{PROSE}</div><div class=box>other</div>', f"Title {WHOLE}"),
        (f'<div id="content" class="post comments-open"><h1>Title</h1>{PROSE}</div>', f"Title {WHOLE}"),
        (f'<main><div class="search-results-page"><h1>Title</h1>{PROSE}</div></main>', f"Title {WHOLE}"),
        (f'<article><h1>Title</h1>{PROSE}<ul class="related-facts"><li>fact one</li></ul></article>', f"Title {WHOLE} fact one"),
        (f'<article><p>A <span class="share">share</span> of it</p>{PROSE}</article>', f"A share of it {WHOLE}"),
        # pages without an article element
        (f"<body><ul class=menu><li><a href=/>Home</a></ul><div id=story><h2>Head</h2>{PROSE}<blockquote>Quoted.</blockquote></div><div class=footer>end</div></body>", f"Head {WHOLE} Quoted."),
        (f"<table><tr><td class=nav><a href=/>x</a></td><td><h1>T</h1>{PROSE}</td></tr></table>", f"T {WHOLE}"),
        (f"<div class=page><header>Site</header><div class=text>{PROSE}{PROSE}</div><form><p>mail</form></div>", f"{WHOLE} {WHOLE}"),
        ("<p>Only &eacute; one&nbsp;line", "Only é one line"),
        ("", ""),
    ],
)
def test_main_text_by_hand(page, want):
    assert htmlmain.Page(page).choose(None)[1] == want


@pytest.mark.parametrize(
    "page",
    ["<div>" * 100_000 + "x", "<b>" * 50_000 + "<p>x" * 50_000, "<svg>" * 100_000, "<div>" * 50_000 + "<td>a</td>" * 50_000, "<ul>" * 50_000 + "<li>x" * 50_000, "<article class='content sidebar'>" * 100_000 + "x", "<div>" * 50_000 + "</b>" * 100_000],
)
def test_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    htmlmain.Page(page).choose(None)
    assert time.perf_counter() - began < 10


# language ID


def test_prediction_equals_a_plain_recurrence(spark):
    r = np.random.default_rng(1)
    model = langid.fresh(["aa", "bb", "cc"], 2, hidden=4)
    p = {k: v.astype(float) for k, v in model.p.items()}

    def states(d, data):
        h, out = np.zeros(4), []
        for b in data:
            e, u = p[d + "E"][b], h @ p[d + "U"]
            gate = 1 / (1 + np.exp(-(e[:8] + u[:8])))
            c = np.tanh(e[8:] + gate[:4] * (u[8:] + p[d + "c"]))
            h = (1 - gate[4:]) * c + gate[4:] * h
            out.append(h)
        return out

    def plain(text):
        data, total = text.encode(), np.zeros(3)
        for a in range(0, len(data), langid.SEGMENT):
            part = list(data[a : a + langid.SEGMENT])
            padded = part + [langid.PAD] * (langid.SEGMENT - len(part))
            forward, backward = states("f", padded), states("b", padded[::-1])[::-1]
            for i in range(len(part)):
                z = np.concatenate([forward[i], backward[i]]) @ p["W"] + p["b"]
                total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return total / total.sum()

    texts = ["".join(r.choice(list("abc dé"), n)) + "z" for n in (1, 63, 64, 65, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in langid.predict(docs, model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i]["lang_pred"] == model.labels[want.argmax()] and got[i]["score"] == pytest.approx(want.max(), abs=1e-4)


def test_every_language_is_learned_and_too_many_are_an_error(spark):
    rows = [(i, f"text {chr(97 + i % 26)} {i}", f"l{i % 90:02d}") for i in range(900)] + [(1, "text b 1", "l01")] * 300 + [(None, "no id", "l00")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows_per_label=3, steps=2)
    assert model.labels == [f"l{i:02d}" for i in range(90)]
    with pytest.raises(ValueError, match="lang"):
        langid.fit(docs, most_labels=89, steps=2)


# Jaccard join


def test_tree_join_equals_all_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 4, (40, jaccard.DIMENSIONS))
    x = np.concatenate([base[r.integers(0, 40, 700)] + (r.random((700, jaccard.DIMENSIONS)) < 0.03), r.integers(0, 40, (60, jaccard.DIMENSIONS))]).astype(np.uint16)
    n = x.sum(axis=1).astype(np.int64)
    label, side = r.integers(0, 30, len(n)), r.integers(0, 2, len(n))
    bound = np.minimum(x[:, None], x[None]).sum(axis=2)
    near = 190 * bound >= 90 * (n[:, None] + n[None])
    for lab, sid in ((None, None), (label, None), (None, side), (label, side)):
        may = near & np.tri(len(n), k=-1, dtype=bool)
        may &= True if lab is None else lab[:, None] != lab[None]
        may &= True if sid is None else sid[:, None] != sid[None]
        p, q = jaccard.near_pairs(n, x, 90, lab, sid, False)
        got = list(zip(np.maximum(p, q).tolist(), np.minimum(p, q).tolist(), strict=True))
        assert len(set(got)) == len(got) and set(got) == set(zip(*(a.tolist() for a in np.nonzero(may)), strict=True))
    tree = jaccard.RTree(np.full(100_000, 50), np.ones((100_000, 4), np.uint16), np.zeros(100_000), None)
    assert len(tree.levels) > 3 and len(tree.pairs(90)[0]) == 0  # one component: left at the root
    p, q = jaccard.near_pairs(np.full(5000, 60), np.ones((5000, jaccard.DIMENSIONS), np.uint16), 90, None, None, True)
    assert len(p) <= 5000


@pytest.mark.parametrize(("hot", "gathered", "cell"), [(2, 40, 8), (4, 1 << 20, 1024), (1, 1, 4)])
def test_jaccard_with_hot_keys_and_small_cells(odd, monkeypatch, hot, gathered, cell):
    for name, value in {"HOT": hot, "GATHERED": gathered, "CELL": cell, "LEAF": 4, "FAN": 2, "PART": 16}.items():
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.link_components(odd, 3, 80, bucket_bytes=3000).collect()
    want = brute_components([(r["doc_id"], r["text"], r["n"]) for r in odd.collect()], 3, 80)
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == want


# decontamination


def test_items_of_all_sizes_are_found_at_the_border(spark):
    r = random.Random(3)
    items, docs, want = [], [], set()
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100, 127, 128, 255, 300]:
        words = [f"i{n}x{j}" for j in range(n + 4)]
        items.append((n, " ".join(words)))
        for more in range(2):  # as many shingles missing as may be, and one more
            missing = int(0.2 * n + 1e-9) + more
            at = r.randint(0, missing)
            kept = words[at : n + 4 - (missing - at)]
            doc = len(docs)
            docs.append((doc, "before it " + " ".join(kept) + " and after"))
            if len(kept) >= 5 and not more:
                want.add((doc, n, n, n - missing))
    i, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (2_000_000, 3):
        assert {tuple(x)[:4] for x in decontaminate.contaminated(d, i, broadcast_rows=limit).collect()} == want
    plan = decontaminate.contaminated(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# toxicity


def test_weights_equal_plain_ftrl(spark):
    r = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(r.choice(words[: 30 if i % 3 else 60]) for _ in range(12))) for i in range(120)] + [(200, ""), (201, rows_text := "wa wb wa wc"), (202, rows_text)]
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")
    alpha, beta, l1, l2, least = 0.4, 1.0, 0.37, 1.0, 3
    got = toxicity.fit(docs, marks, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, least_rows=least)

    def plain_features(text):
        w = Words(*flat(pa.array([text.lower()])), NOT_LETTER)
        h, n = w.hash, len(w.hash)
        found = list(h) + [w.beginnings(np.array([i]), k)[0] for i in range(n) for k in toxicity.PREFIXES if w.end[i] - w.start[i] > k]
        found += list(mix(w.windows(2)[1] + np.uint64(1))) + [mix(h[i : i + 1] + mix(h[i + 2 : i + 3] + np.uint64(2)))[0] for i in range(n - 2)]
        return sorted({int(x) >> 32 for x in found})

    sample = [(plain_features(t), dict(labels)[i]) for i, t in rows]
    seen = {}
    for f, _ in sample:
        for x in f:
            seen[x] = seen.get(x, 0) + 1
    shared_bits = {}
    for f, _ in sample:
        for x in {x >> 8 for x in f}:
            shared_bits[x] = shared_bits.get(x, 0) + 1
    # the order is that of the features whose upper 24 bits are frequent, before single ones are counted
    sample = [([x for x in f if shared_bits[x >> 8] >= least], y) for f, y in sample]
    sample.sort(key=lambda s: (len(s[0]), s[1], np.array(s[0], np.uint32).tobytes()))
    sample = [([x for x in f if seen[x] >= least], y) for f, y in sample]
    sample = [sample[i] for i in np.random.default_rng(0).permutation(len(sample))]
    z, n = {}, {}

    def weight(x):
        zi = z.get(x, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + n[x] ** 0.5) / alpha + l2)

    for _ in range(2):
        for f, y in sample:
            own = [*f, "bias"]
            w = {x: weight(x) for x in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for x in own:
                before = n.get(x, 0.0)
                n[x] = before + g * g
                z[x] = z.get(x, 0.0) + g - (n[x] ** 0.5 - before**0.5) / alpha * w[x]
    want = {x: weight(x) for x in z if x != "bias" and weight(x)}
    assert dict(zip(got.feature.tolist(), got.weight.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    assert got.bias == pytest.approx(weight("bias")) and 0 < len(want) < len(seen)
    score = {x["doc_id"]: x["score"] for x in toxicity.score(docs, got, ["doc_id"]).collect()}
    for (i, _), (_, t) in zip(rows, rows, strict=True):
        total = weight("bias") + sum(want.get(x, 0.0) for x in plain_features(t))
        assert score[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


# sharding


def _placed(rows, shards, load):
    got = sharding.assign(rows, "doc_id", shards, virtual_nodes=32, load=load).select("doc_id", "shard", "slot", F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0null"))), 32).alias("at"))
    return got.collect()


@pytest.mark.parametrize("load", [1.0, 1.25])
def test_rows_lie_where_a_walk_along_the_ring_puts_them(spark, load):
    rows = spark.createDataFrame([(i % 900 if i < 2500 else None,) for i in range(3000)], "doc_id long")
    got = _placed(rows, 7, load)
    point, owner = sharding.ring(7, 32)
    assert [(p, o) for p, o in zip(point, owner, strict=True)] == sorted(zip(point, owner, strict=True))
    most = [3000 // 7 + (s < 3000 % 7) for s in range(7)] if load == 1 else [-(-int(load * 3000) // 7)] * 7
    held = [sum(r["shard"] == s for r in got) for s in range(7)]
    assert all(h <= m for h, m in zip(held, most, strict=True)) and sum(held) == 3000
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(held[s]))
    for r in got:
        # clockwise from its position, every shard met before its own is full
        arc = next((i for i, p in enumerate(point) if p >= r["at"]), 0)
        for step in range(len(point)):
            at = owner[(arc + step) % len(point)]
            if at == r["shard"]:
                break
            assert held[at] == most[at]
    home = sum(owner[next((i for i, p in enumerate(point) if p >= r["at"]), 0)] == r["shard"] for r in got)
    assert home >= 0.6 * 2500


def test_one_more_shard_moves_little(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before, after = ({r["doc_id"]: r["shard"] for r in _placed(rows, n, 1.25)} for n in (20, 21))
    moved = [(a, after[i]) for i, a in before.items() if a != after[i]]
    assert len(moved) <= 2 / 21 * 20_000 and sum(b != 20 for _, b in moved) <= 0.03 * 20_000


# nearest vectors, scale


def test_graph_in_tasks_is_the_graph(spark, monkeypatch):
    c = np.random.default_rng(6).normal(size=(700, 9)).astype(np.float32)
    want = ann.neighbour_graph(c, 12)
    monkeypatch.setattr(ann, "HELD", 5000)
    got = ann._graph_in_tasks(spark, c, 12)
    assert [set(x) for x in got.tolist()] == [set(x) for x in want.tolist()]
    assert ann._graph_in_tasks(spark, c[:1], 12).shape == (1, 2)


def test_leaves_are_sampled_without_putting_them_in_order(spark, monkeypatch):
    """No window over leaves, whose first round would put all points into one task."""
    from pyspark.sql import functions as F

    points = spark.range(3000).select(F.xxhash64("id").alias("p"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.hash("id", i) / 2.0**31).alias("v"))
    plans, kind, plain = [], type(points), type(points).toArrow
    monkeypatch.setattr(kind, "toArrow", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or plain(self))
    tree, held = ann.grow(points, 3.0, 8, 24, 400, 16)
    assert plans and not any("Window" in p for p in plans)
    assert held.sum() == 3000 and held[tree.count == 0].max() <= 48
