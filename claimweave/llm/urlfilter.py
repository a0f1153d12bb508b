"""URL filters: rules decide, and decisions reach aliases over redirect and canonical links. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower
from .components import connected_components

#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Verdict of a page that neither a rule nor an alias decides.
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    """``?`` and what follows it up to ``#`` or the end; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)


def url_alias(url: Column) -> Column:
    """Host, path and query: what makes two urls the same page. Empty for null or no ``://``."""
    return F.concat(url_host(url), url_path(url), url_query(url))


def apply_rules(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of equal length the
    first one wins. ``rules`` is a short list of the configuration; they become one expression, so no row is shuffled.
    """
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        decided = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, decided) if out is None else out.when(fits, decided)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def link_targets(html: Column) -> Column:
    """Targets of canonical links and meta refreshes as they are written, as an array."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b[^>]*\brel\s*=\s*[\"']?canonical\b")),
        lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
    )
    refresh = F.transform(
        F.filter(tags, lambda t: t.rlike(r"(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b")),
        lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*['\"]?([^\"'\s>;]+)", 1),
    )
    found = F.transform(F.concat(canonical, refresh), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.filter(found, lambda u: u != "")


def without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments."""
    parts = F.split(F.substr(path, F.lit(2)), "/", -1)
    ends = F.element_at(parts, -1).isin(".", "..")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(F.when(ends, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))


def resolve(url: Column, target: Column) -> Column:
    """``target`` as an absolute url, seen from the page ``url``; null for other schemes and where the page has no host.

    Only a leading scheme makes a target absolute; it stays as it is. A relative one keeps its query.
    """
    target = F.trim(target)
    base, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.concat(F.regexp_extract(url_path(url), r"(?s)^(.*)/", 1), F.lit("/"))
    inner = F.when(path == "", url_path(url)).when(path.startswith("/"), without_dots(path)).otherwise(without_dots(F.concat(folder, path)))
    query = F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    query = F.when((path == "") & (query == ""), url_query(url)).otherwise(query)
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(base == "", F.lit(None))
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(base, inner, query))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between the aliases (host, path and query) of a page and of its canonical or redirect target."""
    found = pages.where(F.col("html").rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh")).select("url", F.explode(link_targets(F.col("html"))).alias("target"))
    return alias_links(found)


def alias_links(links: DataFrame) -> DataFrame:
    """Edges (a, b) of a table (url, target); targets are resolved, and urls without ``://`` have no alias and give none."""
    links = links.select("url", resolve(F.col("url"), F.col("target")).alias("target"))
    return links.select(url_alias(F.col("url")).alias("a"), url_alias(F.col("target")).alias("b")).where("a != '' and b != '' and a != b")


def judge_urls(pages: DataFrame, rules=RULES, links: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    Where a rule fits, its verdict holds. Else, urls of the same host, path and query are one alias, and aliases are
    joined over canonical and redirect links (of the html, and of ``links`` (url, target) if given): if any
    alias of the component is allowed by a rule, the page is allowed; else if any is blocked, it is blocked;
    else it is allowed. Null urls have an empty host and path and no alias. Repeated rows are judged alike.
    """
    edges = page_links(pages)
    if links is not None:
        edges = edges.unionByName(alias_links(links))
    found = connected_components(edges, "a", "b")
    host, path = F.regexp_extract("node", r"(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    seeds = found.withColumn("seed", apply_rules(host, path, rules).getField("verdict")).groupBy("component").agg(F.max(F.col("seed") == "allow").alias("allowed"), F.max(F.col("seed") == "block").alias("blocked"))
    spread = found.join(seeds, "component").select("node", F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block")).alias("spread"))
    judged = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_alias(F.col("url")).alias("node"))
    judged = judged.withColumn("found", apply_rules(F.col("host"), F.col("path"), rules))
    joined = judged.join(spread, "node", "left")
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "spread", F.lit(DEFAULT)).alias("verdict"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query
  FROM pages),
tags AS (
  SELECT host || path || query AS a, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag
  FROM parsed WHERE host || path || query <> ''),
targets AS (
  SELECT a, CASE WHEN regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                 WHEN regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*[''"]?([^"''\s>;]+)', 1) END AS target
  FROM tags),
edges AS (
  SELECT DISTINCT a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         || regexp_extract(target, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b
  FROM (SELECT a, replace(target, '&amp;', '&') AS target FROM targets) WHERE target LIKE '%://%'),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
urls AS (
  SELECT DISTINCT host || path || query AS node, host, path FROM parsed
  UNION SELECT other, regexp_extract(other, '(?s)^([^/?]*)', 1), regexp_extract(other, '(?s)^[^/?]*([^?]*)', 1) FROM reach),
ruled AS (
  SELECT node, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
spread AS (
  SELECT r.node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v
  FROM reach r JOIN ruled u ON r.other = u.node GROUP BY r.node)
SELECT page_id, host, path, u.rule, coalesce(u.v, s.v, 'allow') AS verdict
FROM parsed p LEFT JOIN ruled u ON p.host || p.path || p.query = u.node LEFT JOIN spread s ON p.host || p.path || p.query = s.node
"""
