"""URL filter: host/path rules, then a blocked Bloom filter before an exact hash join with listed URLs.

The filter is a table of 256-bit blocks (four longs). A URL's first hash picks its block, its second sets two of
the 64 bits in each long. It has a block for every KEYS_A_BLOCK listed URLs, which are counted first; up to MAX_BLOCKS
blocks it is broadcast, a longer one is joined by shuffle. Whatever it lets through wrongly, the exact join decides.

Defined cases: a null URL or one without `://` has empty host and path, fits no rule, has a null canonical form and
is never listed. Repeated pages are judged one by one, and repeats in the list count once. URLs of any length are judged
whole. Of rules that tie in length the first by text decides. An empty list blocks nothing; an empty table gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

KEYS_A_BLOCK = 16  # some 0.5 % of other URLs pass
MAX_BLOCKS = 1 << 18  # 40 bytes each: 10 MB is the most that is broadcast, enough for four million listed URLs
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change what a URL names (fixed values).
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


class Rule(NamedTuple):
    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without `www.` and default port, path without closing slashes, query without tracking parameters and
    sorted; no scheme, no fragment. Null where the URL has no `://`."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, tail))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and the action of the longest rule that fits, else nulls. Rules are code, not data: their number is bounded."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be compiled into an expression")
    text = action = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)) if text is None else text.when(fits, F.lit(r.text))
        action = F.when(fits, F.lit(r.action)) if action is None else action.when(fits, F.lit(r.action))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, action)


def _place(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")
    second = F.xxhash64(key, F.lit(1))
    at = lambda i: F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = lambda bit: F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    return block, [one(at(2 * i)).bitwiseOR(one(at(2 * i + 1))) for i in range(4)]


def bloom_table(keys: DataFrame, column: str, n_blocks: int) -> DataFrame:
    """At most n_blocks rows (block, w0..w3) in which every non-null key's bits are set."""
    block, words = _place(F.col(column), n_blocks)
    placed = keys.where(F.col(column).isNotNull()).select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return placed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", n_blocks: int | None = None) -> DataFrame:
    """Judge every page: (id, host, path, rule, verdict, possible, listed). A fitting rule decides; else listed URLs are blocked."""
    keys = cut(listed.select(canonical_url(F.col(f"`{listed_col}`")).alias("canonical")).where("canonical is not null").distinct(), "urls-listed")
    n_blocks = n_blocks or -(-keys.count() // KEYS_A_BLOCK) or 1
    sent = F.broadcast if n_blocks <= MAX_BLOCKS else lambda df: df
    url = F.col(f"`{url_col}`")
    seen = pages.select(F.col(f"`{id_col}`"), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("canonical"))
    block, words = _place(F.col("canonical"), n_blocks)
    seen = seen.withColumns({"block": block, **{f"m{i}": w for i, w in enumerate(words)}})
    held = [F.coalesce(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"), F.lit(False)) for i in range(4)]
    tested = seen.join(sent(bloom_table(keys, "canonical", n_blocks)), "block", "left")
    tested = tested.select(id_col, "host", "path", "canonical", (held[0] & held[1] & held[2] & held[3]).alias("possible"))
    exact = tested.where("possible").join(keys.withColumn("listed", F.lit(True)).hint("shuffle_merge"), "canonical", "left")
    judged = exact.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(tested.where("not possible").withColumn("listed", F.lit(False)))
    text, action = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", text.alias("rule"), F.coalesce(action, method).alias("verdict"), "possible", "listed")
