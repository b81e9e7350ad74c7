"""URL filter: rules first, else a list of URLs behind a blocked Bloom filter.

The list's canonical URLs are hashed into blocks of one 64-bit word; a URL sets and tests
all of its bits in one word.  Words are a table joined on the block number, broadcast only
when their counted size is within a bound.  Few pages pass as possible hits, and only they
are shuffled, to the exact join with the list that removes false hits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL = 16
PROBES = 4
BROADCAST_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Parameters that don't change what a URL shows.
TRACKING = r"(^|&)(utm_[a-z]+|ref)=[^&]*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without final slashes, and what of the query is no tracking."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""),
                    F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (its ``host/path`` and verdict) that fits; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _block_and_mask(url: Column, blocks: int) -> tuple[Column, Column]:
    place, bits = F.xxhash64(F.lit("block"), url), F.xxhash64(F.lit("bits"), url)
    mask = F.lit(0).cast("long")
    for k in range(PROBES):
        bit = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(place, F.lit(blocks)), mask


def bloom(listed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Words of the blocked Bloom filter of ``listed`` (canonical, distinct): ``block, word``; and their number."""
    blocks = max(1, -(-count * BITS_PER_URL // 64))
    block, mask = _block_and_mask(F.col("canonical"), blocks)
    words = listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))
    return words, blocks


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``listed`` has the URLs to block, in a column ``url``; null ones are ignored.  The verdict is
    that of the longest fitting rule; without one, ``block`` if the list has the page's canonical
    URL, else ``allow``.  Null URLs and ones without ``://`` have empty host and path and are
    allowed; repeated rows and null ids are judged one by one; an empty list blocks nothing;
    other columns are ignored.
    """
    urls = listed.where(F.instr("url", "://") > 0).select(canonical(F.col("url")).alias("canonical")).distinct()
    words, blocks = bloom(urls, urls.count())
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    block, mask = _block_and_mask(F.col("canonical"), blocks)
    asked = (pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
                  .withColumn("rule", rule).withColumn("verdict", verdict)
                  .withColumn("block", block).withColumn("mask", mask))
    # At most 16 bytes a block: the broadcast is bounded by 16 MB; a longer list is joined by shuffle.
    words = F.broadcast(words) if blocks <= BROADCAST_BLOCKS else words
    known = asked.join(words, "block", "left")
    possible = F.coalesce(F.col("rule").isNull() & (F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
                          & (F.col("host") != ""), F.lit(False))
    out = ["page_id", "host", "path", "rule", "verdict"]
    rest = known.where(~possible).select(*out)
    hits = known.where(possible).join(urls.withColumn("hit", F.lit(True)), "canonical", "left")
    judged = hits.select("page_id", "host", "path", "rule", F.when(F.col("hit"), "block").alias("verdict"))
    return rest.union(judged).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
