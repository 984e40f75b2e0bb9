"""URL rules, spread over redirect and canonical-link aliases.

A rule is (verdict, host, path prefix): it fits the host and its subdomains; the longest fitting rule
decides. Pages of one redirect class (connected by canonical links, refresh redirects or given
redirects) share block decisions: an URL without a rule is blocked if any member of its class is
blocked by a rule. An explicit allow outranks that for its own URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.shared import ascii_lower, components, written

#: (verdict, host, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, ASCII lower case; empty without :// or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; equal lengths: the first of the list."""
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        choice = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
                        ).otherwise(choice)
    return choice


def node_of(url: Column) -> Column:
    """What stands for a URL in the alias graph: no scheme, host in lower case, no fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def _target(link: Column, url: Column) -> Column:
    """A link of a page as an absolute URL."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), link))
            .when(link.rlike(r"^([?#]|$)"), F.concat(F.regexp_extract(url, r"(?s)^([^?#]*)", 1), link))
            .otherwise(F.concat(scheme, F.lit("://"), host_of(url),
                                F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1), F.lit("")),
                                           F.lit("/")), link)))


def _value(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    single = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 2)
    bare = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 3)
    return F.trim(F.concat(quoted, single, bare))


def alias_links(html: Column) -> Column:
    """Array of the canonical links and refresh targets that a page states."""
    lower = F.lower(html)
    empty = F.array().cast("array<string>")
    links = F.when(lower.contains("canonical"), F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), 1),
                 lambda tag: F.lower(_value(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")),
        lambda tag: F.replace(_value(tag, "href"), F.lit("&amp;"), F.lit("&")))).otherwise(empty)
    refreshed = F.when(lower.contains("refresh"), F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1),
                 lambda tag: F.lower(_value(tag, "http-equiv")) == "refresh"),
        lambda tag: F.replace(F.regexp_extract(_value(tag, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1),
                              F.lit("&amp;"), F.lit("&")))).otherwise(empty)
    found = F.concat(F.coalesce(links, empty), F.coalesce(refreshed, empty))
    return F.filter(found, lambda link: link != "")


def judge_pages(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_root, via (rule, alias or default).

    ``pages`` has page_id, url, html (others are left out); ``redirects`` optionally has
    source_url, target_url from a crawl log. A null or malformed url has no rule, no aliases and the
    verdict allow; null html states no links; repeated rows are judged alike; no pages, no rows.
    """
    rows = pages.select("page_id", "url", "html")
    links = rows.where("html is not null and url is not null").select(
        node_of(F.col("url")).alias("u"), F.explode(alias_links(F.col("html"))).alias("link"), "url")
    edges = links.select("u", node_of(_target(F.col("link"), F.col("url"))).alias("v"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source_url")), node_of(F.col("target_url"))))
    aliases = components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = fitting_rule(host_of(as_url), path_of(as_url), rules)["verdict"]
    blocked = aliases.groupBy("root").agg(F.max(F.coalesce(ruled == "block", F.lit(False))).alias("_blocked"))
    known = written(aliases.join(blocked, "root"), "aliases")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = rows.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node")
                         ).withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    return judged.join(known, "node", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(F.col("_blocked"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("root", "node").alias("alias_root"),
        F.when(F.col("_rule").isNotNull(), "rule").when(F.col("_blocked"), "alias").otherwise("default").alias("via"))
