"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

A URL that a rule fits takes its verdict. Any other is compared in canonical form with the listed ones: a blocked Bloom
filter (a block of eight 64-bit words for each key, one bit in each word) goes to every task and lets most unlisted URLs
pass without a shuffle; possible hits meet the list in an exact hash join, which removes false positives. All of it is
DataFrame expressions.

Scale. The filter is built by or-ing bits block by block, with partial results in each task, and has `most_blocks` blocks
of 64 bytes at most, which bounds what is broadcast; a longer list makes it fuller, so that more URLs go to the join, and
changes no verdict. The join is on digests. A URL that makes up a large share of the hits would pile up in one task: hits
are counted by digest first (partial counts in each task), and those with more than 1/`parts` of all, `parts` at most,
are looked up once each and broadcast back; all other keys have fewer rows than that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that say where a visitor came from, not what is shown.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|\z)"
#: Words of 64 bits in a block, and bits taken from a hash for the place in each.
WORDS, PLACE = 8, 6
ADDED = ["host", "path", "rule", "verdict", "canonical", "listed"]


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with `path`."""

    host: str
    path: str = "/"
    verdict: str = "block"

    @property
    def name(self) -> str:
        return self.host + self.path


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def rest_of(url: Column) -> Column:
    """What follows the first `://`; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))


def host_of(rest: Column) -> Column:
    return lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical_of(rest: Column) -> Column:
    """Host without `www.`, default port and final dot; path without final slashes; parameters in order, without those that only track.
    Scheme and fragment don't count. Null for what isn't a URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(rest), r"(:80|:443)\z", ""), r"^www\.|\.\z", "")
    path = F.regexp_replace(path_of(rest), r"/+\z", "")
    asked = F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")
    asked = F.array_join(F.array_sort(F.filter(asked, lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits (of equally long ones that with the longer host), else null. Rules are few:
    each is a branch of the plan."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name, r.verdict)):
        own = lowered(F.lit(r.host))
        fits = ((host == own) | F.endswith(host, F.concat(F.lit("."), own))) & F.startswith(path, F.lit(r.path))
        out = out.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
    return out


def block_of(canonical: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(blocks))


def place_in(canonical: Column, word: int) -> Column:
    """The bit (0 to 63) that a key takes in a word of its block."""
    return F.shiftrightunsigned(F.xxhash64(canonical, F.lit(1)), PLACE * word).bitwiseAND(F.lit(63)).cast("int")


def bloom(keys: DataFrame, key: str, n: int, bits: int = 16, most_blocks: int = 1 << 20) -> tuple[DataFrame, int]:
    """The filter of a column of n strings as a table (block, words: array of 8 longs), and its number of blocks: `bits` bits a key,
    `most_blocks` blocks at most. A block without keys has no row."""
    blocks = 1 << max(0, min(most_blocks, -(-n * bits // (64 * WORDS))) - 1).bit_length()
    blocks = min(blocks, most_blocks)
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), place_in(F.col(key), w)) for w in range(WORDS)]
    words = [F.bit_or(b) for b in bit]
    table = keys.groupBy(block_of(F.col(key), blocks).alias("block")).agg(F.array(*words).alias("words"))
    return table, blocks


def may_hold(words: Column, canonical: Column) -> Column:
    """Whether a block has all eight bits of a key; false for a block without a row."""
    out = F.lit(True)
    for w in range(WORDS):
        out = out & (F.call_function("shiftright", F.get(words, F.lit(w)), place_in(canonical, w)).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.coalesce(out, F.lit(False))


def probed(pages: DataFrame, filtered: tuple[DataFrame, int], canonical: str, out: str) -> DataFrame:
    """pages with the column `out`: whether the filter may hold the key. The filter's size is bounded by its making, so it is broadcast."""
    table, blocks = filtered
    table = table.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
    met = pages.join(F.broadcast(table), block_of(F.col(canonical), blocks) == F.col("__block"), "left")
    return met.withColumn(out, may_hold(F.col("__words"), F.col(canonical))).drop("__block", "__words")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url: str = "url", other: str = "allow", hit: str = "block", bits: int = 16, most_blocks: int = 1 << 20, parts: int = 1024) -> DataFrame:
    """pages with host, path, rule, verdict, canonical and listed (null where a rule decides, or for what isn't a URL).

    listed: a table with a column of the same name as `url`; its repeats, nulls and what isn't a URL add nothing. Verdict: the longest
    fitting rule's; else `hit` for a listed canonical URL and `other` for one that isn't listed, for nulls and for what isn't a URL (host
    and path are then empty). Repeated rows are all returned; columns of pages whose names clash (in any case) with an added one give way.
    """
    rest = rest_of(F.col(url))
    keep = [c for c in pages.columns if c.lower() not in ADDED]
    keys = listed.select(canonical_of(rest).alias("canonical")).where("canonical IS NOT NULL").dropDuplicates()
    keys = materialize(keys.withColumn("digest", digest_of(F.col("canonical"))), "listed-urls")
    filtered = bloom(keys, "canonical", keys.count(), bits, most_blocks)

    host, path = F.coalesce(host_of(rest), F.lit("")), F.coalesce(path_of(rest), F.lit(""))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"), canonical_of(rest).alias("canonical"))
    parsed = parsed.withColumn("__by", ruled(F.col("host"), F.col("path"), rules))
    open_ = parsed.withColumn("__key", F.when(F.col("__by").isNull(), F.col("canonical")))
    asked = probed(open_, filtered, "__key", "__maybe")

    hits = asked.where("__maybe").withColumn("__digest", digest_of(F.col("__key")))
    counts = materialize(hits.groupBy("__digest").agg(F.count(F.lit(1)).alias("n")), "url-hits")
    known = materialize(counts.join(keys, F.col("__digest") == F.col("digest"), "left_semi"), "url-hits-listed")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("n") * parts > n).join(known.select("__digest", F.lit(True).alias("in_list")), "__digest", "left")
    hot = materialize(hot.select(F.col("__digest").alias("__hot"), F.coalesce("in_list", F.lit(False)).alias("__in")), "url-hits-hot")

    def found(df: DataFrame, is_listed: Column) -> DataFrame:
        listed_ = F.when(F.col("__key").isNotNull(), is_listed)
        verdict = F.coalesce(F.col("__by.verdict"), F.when(listed_, F.lit(hit)), F.lit(other))
        return df.select(*keep, "host", "path", F.col("__by.rule").alias("rule"), verdict.alias("verdict"), "canonical", listed_.alias("listed"))

    split = hits.join(F.broadcast(hot), F.col("__digest") == F.col("__hot"), "left")
    common, seldom = split.where("__in IS NOT NULL"), split.where("__in IS NULL").drop("__hot", "__in")
    seldom = seldom.join(known.select(F.col("__digest").alias("__known")), F.col("__digest") == F.col("__known"), "left")
    return found(asked.where("NOT __maybe"), F.lit(False)).unionByName(found(common, F.col("__in"))).unionByName(found(seldom, F.col("__known").isNotNull()))


def digest_of(canonical: Column) -> Column:
    """What the join compares: SHA-256, 32 bytes however long a URL is."""
    return F.unhex(F.sha2(canonical.cast("binary"), 256))
