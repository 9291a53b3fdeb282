"""URL filter: host and path rules, then a list of canonical URLs behind a
blocked Bloom filter.

The list may be of any size.  Its filter is a table of at most ``BLOCKS``
rows, each holding one 512-bit block, so broadcasting it has a size bound
that does not depend on the data.  Only URLs that pass the filter are
shuffled, to an exact join that removes the false positives.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import table

#: (verdict, host, path), fixed values of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Blocks of the filter: 2**16 rows of 8 words and a key, under 6 MB.
BLOCKS = 1 << 16
MAX_BLOCKS = 1 << 20
WORDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without closing
    slashes; the empty string where there is no host.  Query and fragment do
    not count."""
    return F.when(host == "", "").otherwise(
        F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls.

    A rule fits its host and every subdomain when the path starts with the
    rule's path.  Of rules equally long the first listed wins.
    """
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest]
    return (F.coalesce(*[F.when(f, r[1] + r[2]) for f, r in zip(fits, longest)], F.lit(None).cast("string")),
            F.coalesce(*[F.when(f, r[0]) for f, r in zip(fits, longest)], F.lit(None).cast("string")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column, word: int) -> Column:
    """One bit of 64 for this word of the block."""
    bit = F.pmod(F.xxhash64(key, F.lit(word + 1)), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter as a table (block, w0..w7) of at most ``blocks`` rows; the
    words are combined on the map side before the shuffle."""
    if not 0 < blocks <= MAX_BLOCKS:
        raise ValueError(f"blocks must be between 1 and {MAX_BLOCKS}")
    return (keys.where(F.col(key).isNotNull()).groupBy(_block(F.col(key), blocks).alias("block"))
            .agg(*[F.bit_or(_mask(F.col(key), i)).alias(f"w{i}") for i in range(WORDS)]))


def may_be_listed(df: DataFrame, key: str, filter_blocks: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Add ``maybe``: false only for keys that are certainly not listed."""
    f = filter_blocks.select("block", *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    joined = df.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(f), "block", "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"__w{i}").bitwiseAND(_mask(F.col(key), i)) == _mask(F.col(key), i)
                                      for i in range(WORDS)])
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
                blocks: int = BLOCKS, id_col: str = "page_id") -> DataFrame:
    """Verdict of every page: the longest fitting rule's, else ``block`` when
    its canonical URL is one of ``listed`` (column ``url``), else ``allow``.

    Returns id, host, path, rule, verdict, listed.  Null URLs have an empty
    host, fit no rule and are never listed; repeated pages and repeated list
    entries give one row per page; an empty list blocks nothing.  Other
    columns of either table are not read.
    """
    host, path = host_and_path(F.col("url"))
    keys = listed.select(canonical(host, path).alias("key")).where("key <> ''").distinct()
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = (pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
            .withColumns({"rule": rule, "ruled": verdict, "key": canonical(F.col("host"), F.col("path"))}))
    rows = may_be_listed(rows, "key", bloom_blocks(keys, "key", blocks), blocks)
    passed = rows.where("maybe").join(keys.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left")
    cols = ["page_id", "host", "path", "rule", "ruled"]
    out = (passed.select(*cols, F.col("k").isNotNull().alias("listed"))
           .unionByName(rows.where(~F.col("maybe")).select(*cols, F.lit(False).alias("listed"))))
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule",
                      F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
                      "listed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the URLs of the pages whose id is divisible by 20."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, pages.where("page_id % 20 = 0"))


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
             FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
keyed AS (SELECT *, CASE WHEN host = '' THEN ''
                    ELSE regexp_replace(host, '^(www|m)\\.', '') || rtrim(path, '/') END AS key FROM parts),
rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
                          ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT k.page_id, host, path, rule,
       coalesce(v, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.key IS NOT NULL AS listed
FROM keyed k LEFT JOIN best b ON b.page_id = k.page_id
LEFT JOIN (SELECT DISTINCT key FROM keyed WHERE page_id % 20 = 0 AND key <> '') l ON l.key = k.key
"""
