"""URL rules, and redirect equivalence: blocks reach every alias of a blocked address, explicit allows go first.

Two addresses are aliases where a page declares the other as its canonical link, where it sends the reader on to it at
once, or where a table of redirects says so, and through any chain of these. Aliases are the connected components of those
edges, found over digests of addresses by alternating stars. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .near_dedup import components

#: Rules are part of the plan: more than these belong in a table of their own.
MOST_RULES = 1_000
#: Markup that holds no tags of the page, and the tags that declare an address.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<textarea\b.*?</textarea\s*>"
DECLARING = r"(?is)<(?:link|meta)\b[^>]*>"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


@dataclass(frozen=True)
class Rule:
    """Allow or block the addresses of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, it does not {self.verdict}")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lowered; empty for null or without it."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct (n, rule, verdict), null where none does; of equally long ones a block.

    Only as many labels of a host are looked up as a rule's host has at most.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, of which at most {MOST_RULES} can be part of a plan")
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host.lower(), []).append(r)
    one = lambda r: F.struct(F.lit(r.path).alias("path"), F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
    known = F.map_from_arrays(F.array(*[F.lit(h) for h in by_host]), F.array(*[F.array(*[one(r) for r in rs]) for rs in by_host.values()]))
    deepest = max(h.count(".") + 1 for h in by_host)
    tails = F.array(*[F.substring_index(host, ".", -n) for n in range(1, deepest + 1)])
    held = F.flatten(F.filter(F.transform(F.array_distinct(tails), lambda t: F.try_element_at(known, t)), lambda rs: rs.isNotNull()))
    fitting = F.transform(F.filter(held, lambda r: F.startswith(path, r["path"])), lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    # verdicts in order: allow, then block
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, without its quotes; empty where it is missing."""
    raw = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(raw, r"""^["']|["']$""", "")


def declared_target(tag: Column) -> Column:
    """The address to which a tag points as canonical link or immediate redirect, null where it does neither."""
    rel = F.split(F.lower(F.trim(attribute(tag, "rel"))), r"\s+")
    href = attribute(tag, "href")
    sent = F.regexp_extract(attribute(tag, "content"), r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
    link = F.when(F.rlike(tag, F.lit(r"(?i)^<link\b")) & F.array_contains(rel, "canonical"), href)
    refresh = F.when(F.rlike(tag, F.lit(r"(?i)^<meta\b")) & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh"), sent)
    found = F.trim(F.regexp_replace(F.coalesce(link, refresh), r"(?i)&(?:amp|#38|#x26);", "&"))
    return F.when(found != "", found)


def declared_targets(html: Column) -> Column:
    """The addresses that a page declares, in page order; comments, scripts and the like declare none.

    Pages that don't hold the words are not searched. A tag ends at its first ``>``.
    """
    likely = F.rlike(html, F.lit(r"(?i)\bcanonical\b|\brefresh\b"))
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(DECLARING), F.lit(0))
    return F.when(likely, F.filter(F.transform(tags, declared_target), lambda t: t.isNotNull()))


def address(url: Column) -> Column:
    """An absolute address in one form: scheme and host in lower case, dot segments resolved, without fragment; null for
    anything that is not one."""
    base = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    segments = F.split(F.regexp_replace(path_of(url), r"^/", ""), "/")
    ends_open = F.element_at(segments, -1).isin(".", "..")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))))
    path = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_open & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return F.when((base != "") & (host_of(url) != ""), F.concat(F.lower(base), F.lit("://"), host_of(url), path, query))


def resolved(target: Column, page: Column) -> Column:
    """A target as the page's reader follows it, in one form; null for addresses of other kinds."""
    scheme = F.regexp_extract(page, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(page))
    here = F.concat(root, path_of(page))
    folder = F.concat(root, F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path_of(page), "^/", "")), r"[^/]*$", ""))
    whole = (
        F.when(F.rlike(target, F.lit(SCHEME + "//")), target)
        .when(F.rlike(target, F.lit(SCHEME)), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(here, target))
        .when(target.startswith("#"), F.lit(None))
        .otherwise(F.concat(folder, target))
    )
    return address(whole)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Distinct edges (source, target) between addresses, from pages (url, html) and from redirects (source, target)."""
    told = pages.select("url", F.explode(declared_targets(F.col("html"))).alias("target"))
    edges = told.select(address(F.col("url")).alias("source"), resolved(F.col("target"), F.col("url")).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("source"), resolved(F.col("target"), F.col("source")).alias("target")))
    return edges.where("source <> target").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: host, path, rule, verdict and what gave it (``by``: rule, alias or nothing).

    The longest rule that fits decides. Where none fits, a page is blocked if an alias of its address is blocked by a rule,
    whether or not that alias is among the pages; all else is allowed. An address that a rule allows stays allowed whatever
    its aliases, and it does not shield them. Null urls, and urls without ``://``, have an empty host and path, no rule and
    no aliases. Null and empty pages declare nothing; pages of any length are searched whole. Rows keep their multiplicity,
    of rows with one url each may declare, and an empty table gives no rows. Other columns are ignored, whatever their names.

    Only pages that declare an address, and the few columns of a url, are shuffled. A target of a large share of all pages
    is a long group only for sums with partial sums before the shuffle, and for joins with one row on the other side.
    """
    slim = pages.select(F.col(f"`{id_column}`").cast("bigint").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html"))
    edges = written(alias_edges(slim, redirects), "alias-edges")
    ends = written(edges.select(F.explode(F.array("source", "target")).alias("address")).distinct(), "alias-ends")
    own = ends.select(digest(F.col("address")).alias("id"), matching_rule(host_of(F.col("address")), path_of(F.col("address")), rules)["verdict"].alias("verdict"))
    if ends.isEmpty():
        blocked = own.select("id").limit(0)
    else:
        joined = components(edges.select(digest(F.col("source")).alias("a"), digest(F.col("target")).alias("b")))
        placed = written(own.join(joined, "id", "left").select("id", "verdict", F.coalesce("component", "id").alias("component")), "alias-components")
        blocked = placed.join(placed.where("verdict = 'block'").select("component").distinct(), "component", "left_semi").select("id")
    blocked = blocked.select(F.col("id").alias("blocked_id"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    # pages without an address meet nothing: keys of their own, a byte longer than a digest, keep them apart from one another
    nowhere = F.unhex(F.concat(F.lit("00"), F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    judged = slim.select("page_id", host.alias("host"), path.alias("path"), matching_rule(host, path, rules).alias("r"), F.coalesce(digest(address(F.col("url"))), nowhere).alias("id"))
    met = judged.join(blocked, F.col("id") == F.col("blocked_id"), "left")
    hit = F.col("blocked_id").isNotNull()
    verdict = F.coalesce(F.col("r.verdict"), F.when(hit, F.lit("block")).otherwise(F.lit("allow")))
    by = F.when(F.col("r").isNotNull(), F.lit("rule")).when(hit, F.lit("alias"))
    return met.select(F.col("page_id").alias(id_column), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))


def judge_sql(rules: list[Rule], table: str = "pages") -> str:
    """DuckDB SQL for the verdicts on ``table`` (page_id, url, html) without further redirects."""
    upper = ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1){upper}"
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    scheme = lambda u: f"regexp_extract({u}, '(?s)^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)"
    value = lambda name: rf"""regexp_replace(regexp_extract(tag, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""

    def in_form(u: str) -> str:
        segments = f"string_split(regexp_replace({path(u)}, '^/', ''), '/')"
        kept = f"list_reduce(list_prepend('', {segments}), lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END)"
        open_ = f"(list_last({segments}) IN ('.', '..') OR {kept} = '')"
        return f"CASE WHEN {scheme(u)} <> '' AND {host(u)} <> '' THEN lower({scheme(u)}) || '://' || {host(u)} || {kept} || CASE WHEN {open_} THEN '/' ELSE '' END || regexp_extract({u}, '(?s)^[^?#]*(\\?[^#]*)', 1) END"

    def rule_of(h: str, p: str, what: str) -> str:
        return f"(SELECT {what} FROM rules r WHERE ({h} = r.host OR ends_with({h}, '.' || r.host)) AND starts_with({p}, r.path) ORDER BY length(r.host || r.path) DESC, r.verdict DESC LIMIT 1)"

    given = ", ".join(f"('{r.verdict}', '{r.host.lower()}', '{r.path}', '{r.host + r.path}')" for r in rules)
    return rf"""WITH RECURSIVE rules(verdict, host, path, rule) AS (VALUES {given}),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{HIDDEN}', ' ', 'g'), '{DECLARING}')) AS tag FROM {table} WHERE regexp_matches(html, '(?i)\bcanonical\b|\brefresh\b')),
told AS (SELECT url, trim(regexp_replace(CASE WHEN regexp_matches(tag, '(?i)^<link\b') AND list_contains(regexp_split_to_array(lower(trim({value('rel')})), '\s+'), 'canonical') THEN {value('href')}
  WHEN regexp_matches(tag, '(?i)^<meta\b') AND lower(trim({value('http-equiv')})) = 'refresh' THEN regexp_extract({value('content')}, '(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"'']*)', 1) END, '(?i)&(?:amp|#38|#x26);', '&', 'g')) AS target FROM tags),
whole AS (SELECT url, CASE WHEN regexp_matches(target, '{SCHEME}//') THEN target WHEN regexp_matches(target, '{SCHEME}') THEN NULL WHEN target LIKE '//%' THEN {scheme('url')} || ':' || target
  WHEN target LIKE '/%' THEN {scheme('url')} || '://' || {host('url')} || target WHEN target LIKE '?%' THEN {scheme('url')} || '://' || {host('url')} || {path('url')} || target WHEN target LIKE '#%' THEN NULL
  ELSE {scheme('url')} || '://' || {host('url')} || regexp_replace('/' || regexp_replace({path('url')}, '^/', ''), '[^/]*$', '') || target END AS target FROM told WHERE target <> ''),
links AS (SELECT DISTINCT {in_form('url')} AS a, {in_form('target')} AS b FROM whole),
ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
blocked(node) AS (SELECT DISTINCT a FROM ways WHERE {rule_of(host('ways.a'), path('ways.a'), 'r.verdict')} = 'block' UNION SELECT b FROM blocked JOIN ways ON a = node),
judged AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {in_form('url')} AS own FROM {table}),
ruled AS (SELECT *, {rule_of('judged.host', 'judged.path', 'r.rule')} AS rule, {rule_of('judged.host', 'judged.path', 'r.verdict')} AS verdict FROM judged)
SELECT page_id, ruled.host, ruled.path, rule, coalesce(verdict, CASE WHEN node IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN node IS NOT NULL THEN 'alias' END AS "by" FROM ruled LEFT JOIN blocked ON own = node"""
