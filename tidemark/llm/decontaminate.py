"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Test items are partitioned by their number n of distinct shingles, each partition holding the sizes from a power
of two to the next. An item that a document contains to a share t or more misses at most (1 - t) n of its
shingles. So a partition has a signature length and a threshold of its own: with m the most that one of its items
may miss, every item is signed with its m + r smallest hash values (its MinHash signature), and a document is a
candidate only if it holds r of them; r is an eighth of the partition's smallest size, so that long items
need several hits and short ones one. No containment of t or more is lost. A document is probed once with every
shingle hash of its whole text, whatever its length. The candidates are then verified: the exact share
of the item's distinct shingles that the document holds.

Only DataFrame functions: words, shingles, hashes and joins all run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; punctuation and white space only separate."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(tokens: Column, k: int) -> Column:
    """64-bit hashes of all windows of k words, with repetitions; none for fewer words."""
    at = F.sequence(F.lit(1), F.size(tokens) - (k - 1))
    return F.when(F.size(tokens) >= k, F.transform(at, lambda i: F.xxhash64(F.slice(tokens, i, k)))).otherwise(F.array().cast("array<bigint>"))


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, containment: all pairs with containment >= share.

    docs: doc_id, text; items: item_id, text. Items of up to `broadcast_rows` shingles are broadcast, and so are
    the ids of up to as many candidate documents; more are joined by a shuffle.

    Edge cases: an item with fewer than k words is its own single shingle and is found as a whole word
    sequence of that length; an item or document that is null or has no word takes no part, nor does a
    null id; repeated items of one id count as one item with all their shingles, repeated doc_ids as one
    document with all its texts; columns other than those named do not matter.
    """
    shared_dir(docs.sparkSession)
    spec = items.where("item_id is not null and text is not null").select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    lengths = F.least(F.lit(k), F.size("w"))
    listed = spec.select("item_id", lengths.alias("k"), F.explode(F.when(F.size("w") >= k, shingles(F.col("w"), k)).otherwise(F.array(F.xxhash64("w")))).alias("h")).distinct()
    listed = listed.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))

    def missed(n: Column) -> Column:
        """How many of n shingles may be missing."""
        return F.floor((1 - F.lit(share)) * n + F.lit(1e-9))

    least = F.pow(F.lit(2.0), F.length(F.bin("n")) - 1)  # the partition: sizes from `least` to 2 * least - 1
    hits = F.greatest(F.lit(1), F.floor(least / 8))
    length = missed(2 * least - 1) + hits
    # an item shorter than its partition's signature is signed whole and needs all but what it may miss
    need = F.least(hits, F.least(length, F.col("n")) - missed(F.col("n"))).cast("long")
    at = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "k"))
    signed = listed.withColumns({"at": at, "length": length, "need": need}).where(F.col("at") <= F.col("length")).select("h", "k", "item_id", "need")
    counted = listed.agg(F.count("*").alias("rows"), F.collect_set("k").alias("k")).collect()[0]  # k: at most five numbers
    small = counted["rows"] <= broadcast_rows

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    def hashed(df: DataFrame) -> DataFrame:
        """doc_id, k, h: the shingles of every whole text, of all lengths that items have, in one pass."""
        tokens = df.where("doc_id is not null and text is not null").select("doc_id", words(F.col("text")).alias("w"))
        if counted["k"] in ([], [k]):
            return tokens.select("doc_id", F.lit(k).alias("k"), F.explode(shingles(F.col("w"), k)).alias("h"))

        def marked(n: int) -> Column:
            return F.transform(shingles(F.col("w"), n), lambda h: F.struct(F.lit(n).alias("k"), h.alias("h")))

        each = [marked(n) for n in sorted({k, *counted["k"]})]
        return tokens.select("doc_id", F.explode(F.concat(*each)).alias("s")).select("doc_id", "s.k", "s.h")

    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    probed = hashed(text).join(side(signed), ["h", "k"]).groupBy("doc_id", "item_id", "need").agg(F.countDistinct("h", "k").alias("hits"))
    candidates = probed.where("hits >= need").select("doc_id", "item_id").checkpoint()  # few rows, used twice
    suspects = candidates.select("doc_id").distinct()
    few = suspects.limit(broadcast_rows + 1).count() <= broadcast_rows
    held = hashed(text.join(F.broadcast(suspects) if few else suspects, "doc_id", "left_semi")).join(side(listed.select("h", "k", "item_id", "n")), ["h", "k"])
    found = held.groupBy("doc_id", "item_id", "n").agg(F.countDistinct("h", "k").alias("n_found"))
    found = found.join(candidates, ["doc_id", "item_id"], "left_semi")
    exact = found.where(F.col("n_found") >= F.lit(share) * F.col("n") - F.lit(1e-9))
    return exact.select("doc_id", "item_id", F.col("n").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))
