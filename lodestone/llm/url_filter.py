"""URL filtering: host and path rules, then a list of canonical URLs.

URLs no rule decides are looked up in the list through a blocked Bloom filter,
one 64-bit word per key, whose possible hits go to an exact hash join. All of
it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

# The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Names of unwanted sites and the domains they move between.
SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
DOMAINS = ["example.com", "example.net", "example.org"]
# The query's list: every site under every domain, each covering what lies below it.
LISTED = [f"{site}.{domain}/" for site in SITES for domain in DOMAINS]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MAX_BLOCKS = 1 << 20
KEYS_PER_BLOCK = 4


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, ASCII lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    start = F.instr(url, "://")
    return F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, site, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(prefix)
        name, verdict = F.when(fits, site + prefix).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def lookups(host: Column, path: Column, longest: int) -> Column:
    """Canonical URLs of `longest` characters or fewer that cover a page: each
    domain suffix of two labels or more, with the site root, each directory and
    the path without its final slash. What is longer than any listed entry is cut
    off first, so a url's lookups don't grow with its length."""
    end = F.right(host, F.lit(longest + 1))
    labels = F.split(end, r"\.")
    labels = F.when(F.length(host) > longest + 1, F.slice(labels, 2, F.size(labels))).otherwise(labels)  # the first may be half a label
    sites = F.when(F.size(F.split(host, r"\.")) < 2, F.array(host)).otherwise(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: i < F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    flat = F.regexp_replace(path, "/+", "/")
    parts = F.split(F.left(flat, F.lit(longest + 1)), "/")
    parts = F.when(F.length(flat) > longest + 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)  # the last may be half a directory
    parts = F.filter(parts, lambda p: p != "")
    paths = F.concat(F.array(F.lit("/")), F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>")))
    each = F.flatten(F.transform(sites, lambda s: F.transform(F.filter(paths, lambda p: F.length(s) + F.length(p) <= longest), lambda p: F.concat(s, p))))
    return F.array_distinct(each)


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: str) -> Column:
    second = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.call_function("shiftright", second, F.lit(6 * i)).bitwiseAND(63).cast("int")) for i in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom_blocks(listed: DataFrame, keys: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of `keys` entries as rows (block, word): a power of two of
    blocks, `max_blocks` at most, so 16 MB bound the broadcast however long the
    list grows."""
    blocks = 1
    while blocks < max_blocks and blocks * KEYS_PER_BLOCK < keys * 2:
        blocks *= 2
    words = listed.groupBy(_block("entry", blocks).alias("block")).agg(F.bit_or(_mask("entry")).alias("word"))
    return words, blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    `listed` has one column, `entry`, of canonical URLs (`host/` or
    `host/dir`). A page that no rule fits is blocked when an entry equals or
    covers it, else allowed.

    Defined cases: a null url, or one without `://`, has an empty host and path
    and is allowed; null and repeated entries are harmless; repeated pages and
    null ids each keep their row; a url of any length costs what its length and
    the list's longest entry say; empty tables give empty results; other
    columns are ignored, whatever their names.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": name, "ruling": verdict})
    entries = listed.select("entry").filter("entry IS NOT NULL").distinct()
    keys, longest = entries.agg(F.count("*"), F.coalesce(F.max(F.length("entry")), F.lit(0))).first()
    words, blocks = bloom_blocks(entries, keys, max_blocks)
    asked = ruled.filter("rule IS NULL").select("host", "path").distinct().select("host", "path", F.explode(lookups(F.col("host"), F.col("path"), longest)).alias("entry"))
    possible = (
        asked.withColumns({"block": _block("entry", blocks), "mask": _mask("entry")})
        .join(F.broadcast(words), "block")  # 16 bytes a row, MAX_BLOCKS rows at most
        .filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask"))
        .select("host", "path", "entry")
    )
    # the possible hits are few: a hash table of one part of the list at a time, however long it is
    found = possible.join(entries.hint("shuffle_hash"), "entry", "left_semi").select("host", "path").distinct().withColumn("listed", F.lit(True))
    return ruled.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruling", F.when(F.col("rule").isNull() & F.col("listed"), "block"), F.lit("allow")).alias("verdict"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against the query's own list; any table of entries fits."""
    listed = spark.createDataFrame([(x,) for x in LISTED], "entry string")
    return filter_urls(table(spark, sf_dir, "pages"), listed)


OP9_SQL = rf"""
WITH r(kind, site, prefix) AS (VALUES {', '.join(str(r) for r in RULES)}),
p AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
q AS (
  SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
),
c AS (
  SELECT q.*,
    (SELECT arg_max(site || prefix, length(site || prefix)) FROM r WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix)) AS rule,
    (SELECT arg_max(kind, length(site || prefix)) FROM r WHERE (host = site OR ends_with(host, '.' || site)) AND starts_with(path, prefix)) AS ruling
  FROM q
)
SELECT page_id, host, path, rule,
  coalesce(ruling, CASE WHEN {' OR '.join(f"host = '{x[:-1]}' OR ends_with(host, '.{x[:-1]}')" for x in LISTED)} THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""
