"""URL filters: rules by host and path, carried to aliases over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
CANONICAL = r"(?i)\srel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?i)\shttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?i)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?i)\burl\s*=\s*([^\"'>]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, a beginning of the path, and what is decided there."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(rest: Column) -> Column:
    """The host at the beginning of what follows the scheme, A-Z in lower case; empty for null."""
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(rest: Column) -> Column:
    """The path between host and query; empty for null."""
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(rest: Column) -> Column:
    """What tells pages apart: host, path and query, without scheme and fragment; null without a host."""
    host = host_of(rest)
    return F.when(host != "", F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)))


def matched(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does; of equally long ones the first by name."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: (len(x.name), [-ord(c) for c in x.name])):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def resolved(link: Column, rest: Column) -> Column:
    """The address a link of the page at ``rest`` leads to; null for other schemes and links within the page."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    folder = F.when(path_of(rest) == "", "/").otherwise(F.regexp_replace(path_of(rest), r"[^/]*$", ""))
    whole = (
        F.when(F.regexp_like(link, F.lit(r"^(?i)https?://")), after_scheme(link))
        .when(F.startswith(link, F.lit("//")), F.substr(link, F.lit(3)))
        .when(F.regexp_like(link, F.lit(SCHEME)) | F.regexp_like(link, F.lit(r"^(?:$|[#?])")), F.lit(None))
        .when(F.startswith(link, F.lit("/")), F.concat(host_of(rest), link))
        .otherwise(F.concat(host_of(rest), folder, link))
    )
    return address(whole)


def links(html: Column) -> Column:
    """The targets a page declares, as written: its first canonical link and its first refresh, outside of comments,
    scripts and styles. Pages that hold neither word are not taken apart."""
    clean = F.regexp_replace(html, HIDDEN, "")

    def first(tag: str, kind: str) -> Column:
        return F.get(F.filter(F.regexp_extract_all(clean, F.lit(rf"(?i)(<{tag}\b[^>]*>)"), 1), lambda x: F.regexp_like(x, F.lit(kind))), F.lit(0))

    link, meta = first("link", CANONICAL), first("meta", REFRESH)
    href = reduce(F.concat, [F.regexp_extract(link, HREF, i) for i in (1, 2, 3)])
    both = F.array_compact(F.array(href, F.nullif(F.regexp_extract(meta, TARGET, 1), F.lit(""))))
    return F.when(F.regexp_like(html, F.lit(r"(?i)\bcanonical\b|\brefresh\b")), both)


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``pages(url, html)`` and ``redirects(url, target)`` -> ``(a, b)``: addresses that stand for one another."""
    rest = after_scheme(F.col("url"))
    found = pages.where(F.regexp_like("html", F.lit(r"(?i)\bcanonical\b|\brefresh\b")) & (host_of(rest) != ""))
    found = found.select(rest.alias("rest"), F.explode(links(F.col("html"))).alias("link"))
    edges = found.select(address(F.col("rest")).alias("a"), resolved(F.col("link"), F.col("rest")).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(rest).alias("a"), resolved(F.col("target"), rest).alias("b")))
    return edges.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, host, path, rule, verdict)``, a row for each row.

    The longest rule that fits a url decides it. A url that no rule fits gets the decision of its aliases: the addresses
    it is connected with over canonical links, refreshes and ``redirects(url, target)``, whether they are pages or only
    targets. Where aliases disagree, allow goes before block; where no rule fits any of them, ``default`` holds.

    Addresses leave out scheme and fragment and are taken as written (no dot segments are resolved); of a page's
    canonical links the first counts, of its refreshes too. A url that is null or has no ``://`` has an empty host
    and path and no aliases. Rules become one expression, so their list is a parameter and not a table; pages are not
    shuffled unless the addresses in links are too many to broadcast, and then only to join them; pages that look no address
    up (a rule decides them, or they have none) are then dealt out by a hash.
    """
    rest = after_scheme(F.col("url"))
    name, verdict = matched(rules, F.col("host"), F.col("path"))
    named = pages.select("page_id", rest.alias("rest")).withColumn("host", host_of(F.col("rest"))).withColumn("path", path_of(F.col("rest")))
    named = named.withColumn("rule", name).withColumn("own", verdict)
    roots = connected_components(alias_edges(pages, redirects))
    known = roots.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))).withColumn("own", verdict)
    decided = known.groupBy("root").agg(F.bool_or(F.col("own") == "allow").alias("allow"), F.bool_or(F.col("own") == "block").alias("block"))
    decided = decided.select("root", F.when(F.col("allow"), "allow").when(F.col("block"), "block").alias("passed")).where("passed is not null")
    passed = known.where("own is null").join(decided, "root").select("node", "passed")
    asks = F.when(F.col("own").isNull(), address(F.col("rest")))  # what a rule decides looks up no alias
    spread = F.concat(F.lit("/"), F.xxhash64("page_id", "rest").cast("string"))  # no address begins so: such rows are dealt out evenly
    out = named.select("page_id", "host", "path", "rule", "own", F.coalesce(asks, spread).alias("node")).join(passed, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "passed", F.lit(default)).alias("verdict"))
