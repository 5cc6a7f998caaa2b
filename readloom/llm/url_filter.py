"""URL filter rules: a blocked Bloom filter of the listed URLs passes possible hits to an exact hash join. DataFrame functions only."""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.util import small_side, written

#: Most 64-bit blocks of the filter (128 KB). Longer lists pass more false hits on to the join and lose nothing.
MOST_BLOCKS = 1 << 14
#: Bits of the filter for each listed URL, and the bits that each sets in its block.
BITS_PER_KEY, PROBES = 24, 4
#: The rules of op4: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no '://'."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), ascii_uppercase, ascii_lowercase), F.coalesce(path, F.lit(""))


def _bits(key: Column) -> Column:
    """The bits of a key within its block."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    out = bit(0)
    for i in range(1, PROBES):
        out = out.bitwiseOR(bit(i))
    return out


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def bloom_blocks(keys: DataFrame, key: str, n_keys: int) -> list[int]:
    """The filter's blocks, or-ed together by Spark; MOST_BLOCKS bounds what reaches the driver."""
    n = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n_keys) * BITS_PER_KEY / 64))))
    out = [0] * n
    for row in keys.select(_block(F.col(key), n).alias("b"), _bits(F.col(key)).alias("w")).groupBy("b").agg(F.bit_or("w").alias("w")).collect():
        out[row["b"]] = row["w"]
    return out


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url); rules has columns verdict, host, path.

    A rule fits its host and every subdomain if the page's path starts with the rule's path; the longest host + path wins, then the greatest
    string, and 'block' if one is listed twice. Rows with no rule get default; a null URL or one without '://' has an empty host and path and
    no rule. Repeated and null page_ids keep a row each. Each distinct host and path is judged once, and hot URLs are combined before the shuffle.
    """
    rules = written(rules.where("host is not null and path is not null and host != ''").groupBy("host", "path").agg(F.max("verdict").alias("_verdict")).withColumn("_rule", F.concat("host", "path")))
    shapes = [(r["n"], r["l"]) for r in rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("l")).distinct().collect()]
    listed = rules.select("_rule", "_verdict", F.length("_rule").alias("_length"))
    url, ids = F.col("url"), F.col("page_id")
    host, path = url_parts(url)
    urls = pages.select(ids.alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = bloom_blocks(listed, "_rule", listed.count())
    words = F.array(*[F.lit(w).cast("long") for w in blocks])
    keys = F.array_distinct(F.array(*[F.when(F.length("path") >= l, F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, l))) for n, l in sorted(shapes)]))

    def possible(key: Column) -> Column:
        word = F.element_at(words, _block(key, len(blocks)) + 1)
        return key.isNotNull() & (word.bitwiseAND(_bits(key)) == _bits(key))

    hits = urls.select("host", "path", F.filter(keys, possible).alias("_keys")).where(F.size("_keys") > 0).groupBy("host", "path").agg(F.first("_keys").alias("_keys"))
    exact = hits.select("host", "path", F.explode("_keys").alias("_rule")).join(small_side(written(listed)), "_rule")
    best = F.max(F.struct("_length", "_rule", "_verdict"))
    ruled = written(exact.groupBy("host", "path").agg(best.alias("_b")).select("host", "path", F.col("_b._rule").alias("rule"), F.col("_b._verdict").alias("_verdict")))
    out = urls.join(small_side(ruled), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP4_SQL = r"""
with rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as rid from pages),
m as (select rid, max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) as b from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid)
select page_id, host, path, b.rule as rule, coalesce(b.verdict, 'allow') as verdict from u left join m using (rid)
"""
