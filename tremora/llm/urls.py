"""URL filters: explicit rules, and block decisions that spread to aliases.

Pages that redirect to each other or name the same canonical address are one place. Distributed connected components
over those edges find the places; a place with a blocked page and no allowed one is blocked for its other pages too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import UPPER
from tremora.operators.graph import connected_components

Rule = tuple[str, str, str]
#: Fixed values: (verdict, host, path).
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A tag ends at the next angle bracket of either kind, so text without any is read once.
_TAG = r"(?i)<(?:link|meta)\b[^<>]*"
_IS_CANONICAL, _IS_REFRESH = r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH_URL = r"""(?i)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """Host, path and query, the same for both schemes and every fragment; null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest))


def matched(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. Block wins between equals."""
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        chain = chain.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))
    return chain


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) addresses that the canonical links and the refreshes of pages(url, html) tie together, all of a page."""
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(_IS_CANONICAL)), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(_IS_REFRESH)), lambda t: F.regexp_extract(t, _REFRESH_URL, 1))
    links = F.array_distinct(F.concat(canonical, refresh))
    found = pages.where("url is not null and html is not null").select(
        "url", F.explode(F.filter(links, lambda x: F.length(x) > 0)).alias("link")
    )
    link = F.replace(F.col("link"), F.lit("&amp;"), F.lit("&"))
    whole = (
        F.when(F.contains(link, F.lit("://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(F.lit("http://"), host_of(F.col("url")), link))
        .otherwise(
            F.concat(F.lit("http://"), host_of(F.col("url")), F.regexp_replace(path_of(F.col("url")), "[^/]*$", ""), link)
        )
    )
    return found.select(address_of(F.col("url")).alias("a"), address_of(whole).alias("b")).where("a is not null")


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id"
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(id, url, html).

    verdict is that of the longest fitting rule. A page that no rule fits is blocked if its place has a blocked page
    and no page that is allowed explicitly, and allowed otherwise. redirects(source, target) adds edges. Null urls and
    urls without :// have an empty host and path, fit no rule, have no aliases and are allowed. Repeated rows and ids
    keep a row each; other columns aren't read; an empty table gives an empty result.
    """
    chosen = pages.select(F.col(id_col).alias("page_id"), "url", "html")
    ruled = chosen.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("address")
    ).withColumn("match", matched(F.col("host"), F.col("path"), rules))
    edges = alias_edges(chosen)
    if redirects is not None:
        more = redirects.select(address_of(F.col("source")).alias("a"), address_of(F.col("target")).alias("b"))
        edges = edges.unionByName(more.where("a is not null and b is not null"))
    # An address that is no page still has a verdict by its rule.
    joined = connected_components(edges)
    ends = joined.select(
        F.col("node").alias("address"), matched(F.regexp_extract("node", r"^[^/?#]*", 0), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1), rules)["verdict"].alias("verdict")
    )
    known = ruled.where("address is not null").select("address", F.col("match.verdict").alias("verdict")).unionByName(ends)
    decided = known.groupBy("address").agg(
        F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed")
    )
    places = decided.join(joined.withColumnRenamed("node", "address"), "address", "left").select(
        "address", F.coalesce("component", "address").alias("place"), "blocked", "allowed"
    )
    bad = (
        places.groupBy("place")
        .agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
        .where("blocked and not coalesce(allowed, false)")
        .select("place")
    )
    aliases = places.join(bad, "place", "left_semi").select("address", F.lit("block").alias("spread"))
    return ruled.join(aliases, "address", "left").select(
        "page_id",
        "host",
        "path",
        F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", "spread", F.lit("allow")).alias("verdict"),
    )


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages)
