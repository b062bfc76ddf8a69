"""The queries of this subpackage: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the URL contract: host, path prefix, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(k: int):
    """crc32 of doc_id as text, modulo k; a null doc_id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(k)), F.lit(0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones outside the held-out fold."""
    from tidemark.llm import toxicity

    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(documents, toxicity.fit(documents.where(_fold(5) != 0), labels), ["doc_id"])
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    from tidemark.llm import langid

    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.select("doc_id", "text", "lang").where(_fold(3) != 1))
    return langid.predict(documents, model, ["doc_id"]).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20."""
    from tidemark.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the windows of 35 words that also start elsewhere."""
    from tidemark.llm.substring import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the 49k word-end vocabulary."""
    import public_tokenizers
    from tidemark.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged against the listed rules; unlisted urls are allowed."""
    from tidemark.llm.urlfilter import judge

    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on 40 shards of the ring with exactly bounded loads: counts at most one apart."""
    from tidemark.llm.sharding import assign

    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    )
    placed = assign(rows, "doc_id", shards=40, virtual_nodes=128, load=1.0, order=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the winning paths of its host."""
    from tidemark.llm.htmlmain import extract

    found = extract(table(spark, sf_dir, "pages"), ("page_id", "url"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by three-word shingles at a Jaccard similarity of 0.9 or more."""
    from tidemark.llm.jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items whose five-word shingles they hold to a share of 0.8 or more."""
    from tidemark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, share=0.8)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt behind the first turns of the one whose id is the next lower multiple of 20."""
    from tidemark.llm.trie import prefix_trie

    heads = F.pmod(F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")), F.lit(4))
    return prefix_trie(table(spark, sf_dir, "conversations"), F.col("conv") - F.col("conv") % 20, heads, most=3)


def op12_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the hidden Markov model of those outside the held-out fold, beside single-word probabilities."""
    from tidemark.llm.hmm import score

    scored = score(table(spark, sf_dir, "documents"), _fold(10) != 0, ["doc_id"])
    return scored.select("doc_id", (_fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the five best positives of every vector whose id is divisible by 100; every seventh label is another one."""
    from tidemark.llm.negatives import mine

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0)


_ORACLES: dict[str, str] = {
    "op10_decontamination": r"""
        WITH iw AS (
          SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
        ), i AS (
          SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j+4], ' '))) AS s FROM iw
        ), n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY 1),
        dw AS (
          SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
        ), d AS (
          SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j+4], ' '))) AS s FROM dw
        )
        SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles AS containment
        FROM d JOIN i USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles - 1e-9
    """,
    "op11_prefix_trie": r"""
        WITH t AS (
          SELECT conv_id, role, text, md5(strlen(role) || ':' || role || text) AS h,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS p
          FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
        ), c AS (
          SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
                   lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
          FROM t GROUP BY conv_id
        ), e AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
        r AS (
          SELECT e.conv_id, t.p AS d, t.h, t.text FROM e JOIN t ON t.conv_id = e.base AND t.p <= e.h
          UNION ALL SELECT e.conv_id, e.head + t.p - e.h, t.h, t.text FROM e JOIN t ON t.conv_id = e.conv_id AND t.p > e.h
        ), k AS (
          SELECT conv_id, d, text, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS key,
                 d = max(d) OVER (PARTITION BY conv_id) AS last FROM r
          UNION ALL SELECT conv_id, 0, '', '', NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = e.conv_id) FROM e
        ), n AS (
          SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^ 	-
]+')) AS words,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends
          FROM k GROUP BY key, d
        ), m AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND left(x.key, length(n.key)) = n.key) AS n_children FROM n)
        SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children,
               count(*) FILTER (WHERE s.n_children = 0) AS n_leaves, sum((s.n_convs - 1) * s.words)::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
        FROM m JOIN m s ON starts_with(s.key, m.key) LEFT JOIN n q ON q.d = m.d - 1 AND q.key = left(m.key, length(m.key) - 32)
        GROUP BY ALL
    """,
    "op13_hard_negatives": r"""
        WITH v AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
          FROM embeddings
          WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
          SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
        QUALIFY row_number() OVER w <= 10
    """,
    "op5_url_filter": r"""
        WITH p AS (
          SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), q AS (
          SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
        ), rules(h, rp, action) AS (
          VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        )
        SELECT page_id, host, path,
          (SELECT max_by(h || rp, length(h || rp)) FROM rules WHERE (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, rp)) AS rule,
          coalesce((SELECT max_by(action, length(h || rp)) FROM rules WHERE (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, rp)), 'allow') AS verdict
        FROM q
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for k, v in _ORACLES.items()}
