"""URL filter: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule lists a host and the beginning of a path, as one canonical string ("example.com/de/"). It
fits its host and all subdomains. For a page, every host suffix joined with every listed length of
path prefix is a possible key; the Bloom filter drops nearly all of them, and those that pass are
joined with the list itself, which removes the false positives. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import kept

#: A filter block is one 64-bit word; three of its bits stand for a key.
BITS = 3


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _mask(hashed: str) -> Column:
    """The bits of a key inside its word, from the upper part of its hash."""
    bits = [f"shiftleft(1L, cast(pmod(shiftrightunsigned({hashed}, {6 * i + 44}), 64) as int))" for i in range(BITS)]
    return F.expr(" | ".join(bits))


def bloom(rules: DataFrame, words: int) -> DataFrame:
    """One row with `_bloom`, an array of `words` longs; its size does not depend on the list."""
    hashed = rules.select(F.xxhash64(F.concat("host", "path")).alias("_h"))
    filled = hashed.withColumn("_m", _mask("_h")).groupBy(F.expr(f"cast(pmod(_h, {words}) as int)").alias("_w")).agg(F.expr("bit_or(_m)").alias("_m"))
    whole = rules.sparkSession.range(words).select(F.col("id").cast("int").alias("_w")).join(filled, "_w", "left")
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", F.coalesce("_m", F.lit(0).cast("long")).alias("_m")))), lambda x: x["_m"]).alias("_bloom"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", words: int = 4096) -> DataFrame:
    """`pages` with host, path, rule (the longest rule that fits, else null) and verdict (its action, else `default`).

    rules: host, path, action. words: size of the filter in 64-bit words; take about one for
    every six rules. The list itself is joined by hash, broadcast only where Spark's own size
    threshold allows it.

    Edge cases: a null url or one without `://` has an empty host and path, so no rule fits; an
    empty list leaves every page to `default`; repeated pages stay repeated; of rules of equal
    length the one with the longer host, then the greater text, wins; repeated rules count once
    (of two actions, block). Input columns named host, path, rule or verdict are replaced; any other name may be
    in use, as the columns of `pages` are put aside under names of our own.
    """
    listed = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("action").alias("action"))
    lengths = listed.agg(F.array_sort(F.collect_set(F.length("path"))).alias("_lengths"))  # no more than the longest path has characters
    host, path = split_url(F.col("url"))
    names, aside, _ = kept(pages, pages.columns, ["host", "path", "rule", "verdict"])
    own = [f"k{i}" for i in range(len(names))]
    page = pages.select(*aside, host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    page = page.withColumns({"_bloom": bloom(listed, words).scalar(), "_lengths": lengths.scalar()})  # computed once, then a constant
    labels = F.split("host", r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    prefixes = F.transform(F.filter(F.col("_lengths"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(F.concat(h, p).alias("key"), h.alias("h"), p.alias("p"), F.xxhash64(F.concat(h, p)).alias("x")))))
    one = F.lit(1).cast("long")

    def passes(k: Column) -> Column:
        word = F.element_at("_bloom", (F.pmod(k["x"], F.lit(words)) + 1).cast("int"))
        hit = F.lit(True)
        for i in range(BITS):
            bit = F.pmod(F.shiftrightunsigned(k["x"], 6 * i + 44), F.lit(64)).cast("int")
            hit = hit & (F.call_function("shiftright", word, bit).bitwiseAND(one) == one)
        return hit

    page = page.withColumn("_keys", F.filter(keys, passes)).drop("_bloom", "_lengths")
    clear = page.where("size(_keys) = 0").select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    possible = page.where("size(_keys) > 0").withColumn("_k", F.explode("_keys")).select(*own, "host", "path", "_row", "_k.h", "_k.p")
    fits = possible.join(listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "action"), ["h", "p"], "left")
    text = F.concat("h", "p")
    best = F.when(F.col("action").isNotNull(), F.struct(F.length(text).alias("n"), F.length("h").alias("m"), text.alias("rule"), F.col("action").alias("action")))
    found = fits.groupBy("_row").agg(F.max(best).alias("_best"), F.first(F.struct(*own, "host", "path")).alias("_page"))
    judged = clear.unionByName(found.select("_page.*", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict")))
    return judged.select(*(F.col(k).alias(c) for k, c in zip(own, names, strict=True)), "host", "path", "rule", "verdict")
