"""URL filter (numbered operator 5): a blocked Bloom filter of the listed canonical URLs passes possible
hits to an exact hash join, which removes the false positives; host/path rules go before the list.

The filter is a table of 512-bit blocks (eight words).  A URL's first hash picks its block, six-bit slices
of its second hash pick one bit in each word, so a probe reads one block.  While the filter is below
``FILTER_BROADCAST_BYTES`` (its size follows from the exact count of listed URLs) it is broadcast; beyond
that it stays sharded and the probe is a join on the block number.

Defined results: a NULL url, or one without ``://``, has an empty host and path, no rule and no listing;
repeated urls get equal verdicts; an empty list blocks nothing; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import BROADCAST_ROWS, ascii_lower, at_most

FILTER_BROADCAST_BYTES = 64 << 20
WORDS = 8
#: (verdict, host, path) of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without ``www.``, path without trailing slashes, query without ``utm_`` parameters; no scheme, no fragment.

    NULL where the url has no host and no path.
    """
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    base = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(base != "", F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def _masks(url: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), url)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, bits_per_url: int = 16) -> tuple[DataFrame, int]:
    """(block number and its words, number of blocks) for the distinct urls of the one column of ``listed``."""
    name = listed.columns[0]
    blocks = max(1, -(-listed.count() * bits_per_url // (64 * WORDS)))
    url = F.col(name)
    bits = listed.select(_block(url, blocks).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(_masks(url))])
    return bits.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)]), blocks


def listed_urls(urls: DataFrame, listed: DataFrame, bits_per_url: int = 16) -> DataFrame:
    """The distinct values of the one column of ``urls`` that are in the one column of ``listed``, exactly."""
    name, key = urls.columns[0], F.col(urls.columns[0])
    listed = listed.select(F.col(listed.columns[0]).alias(name)).filter(key.isNotNull()).distinct()
    filter_, blocks = bloom_filter(listed, bits_per_url)
    if blocks * 8 * (WORDS + 1) <= FILTER_BROADCAST_BYTES:
        filter_ = F.broadcast(filter_)
    probes = urls.filter(key.isNotNull()).distinct().withColumn("_block", _block(key, blocks))
    hit = F.lit(True)
    for i, m in enumerate(_masks(key)):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(m) == m)
    possible = probes.join(filter_, "_block").filter(hit).select(name)
    return possible.join(listed, name, "left_semi")


def judge(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, listed for every row of ``pages``.

    ``listed`` has one column of canonical urls to block; a fitting rule goes before the list.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), url.alias("_url"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_key"))
    hits = listed_urls(rows.select("_key"), listed).withColumn("_hit", F.lit(True))
    if at_most(hits, BROADCAST_ROWS):
        rows = rows.join(F.broadcast(hits), "_key", "left")
    else:  # rows without a key are dealt by their own hash, not to the NULL task
        own = F.coalesce("_key", F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string")))
        rows = rows.withColumn("_key", own).join(hits, "_key", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    listed_ = F.coalesce("_hit", F.lit(False))
    return rows.select(F.col(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(listed_, "block").otherwise("allow")).alias("verdict"), listed_.alias("listed"))
