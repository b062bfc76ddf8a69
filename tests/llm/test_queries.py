"""The contract queries on the smallest tables, and the pipeline's stages on their own input."""

import re

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_operators import WORD, brute_components, brute_repeats
from tidemark.llm import queries


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, data, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    want = c.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*order).collect()) == sorted(repr(r) for r in want.select(*order).fetchall())


def test_every_contract_has_its_columns(spark, data):
    columns = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op2_nearest_vectors": ["query_id", "rank", "vec_id", "score"],
        "op3_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op8_main_text": ["page_id", "url", "text", "n_chars"],
        "op9_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    }
    for name, want in columns.items():
        df = queries.queries()[name](spark, data)
        table = "embeddings" if name.startswith("op2") else "pages" if name.startswith("op8") else "documents"
        n = spark.read.parquet(f"{data}/{table}.parquet").count()
        assert df.columns == want
        assert df.count() == n or name.startswith("op2")


def test_main_text_is_the_article(spark, data):
    import html

    got = {r["page_id"]: r["text"] for r in queries.op8_main_text(spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))).split())


def test_pipeline_stages(spark, data, documents, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "benchmark_free", "encoded"]
    rows = [(r["doc_id"], r["text"], "") for r in documents.collect()]

    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, documents, data).collect()}
    assert all(i in kept for i, t, _ in rows if t and len(WORD.findall(t)) > 3)

    want = {eval(x)[0] for x in brute_components(rows, 5, 80) if eval(x)[0] == eval(x)[2]}  # noqa: S307
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents, data).collect()} == want

    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, documents, data).collect()}
    for (i, text, _), (_, _, removed, text_left) in zip(rows, brute_repeats(rows, 35), strict=True):
        assert cut[i] == (text_left if removed else text)

    def tokens(t):
        return [w for w in re.split(r"[\W_]+", t.lower()) if w]

    def five(t):
        w = tokens(t)
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    items = [five(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = {i for i, t, _ in rows if not any(len(s & five(t)) >= 0.8 * len(s) for s in items)}
    assert {r["doc_id"] for r in corpus_pipeline.benchmark_free(spark, documents, data).collect()} == clean

    done = corpus_pipeline.run(spark, data)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(done.columns) and 0 < done.count() <= len(rows)
