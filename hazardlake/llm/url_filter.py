"""Allow and block decisions for urls, carried over redirects and canonical links.  DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.llm.common import LOWER, UPPER, stage
from hazardlake.llm.components import components

# Fixed values of the task: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# canonical as any word of the rel list
_CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*(?:["']?canonical\b|"[^">]*\scanonical[\s"]|'[^'>]*\scanonical[\s'])"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _folded(path: Column) -> Column:
    """The path from the root, with its ``.`` and ``..`` steps taken."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    step = lambda done, part: (F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                               .otherwise(F.array_append(done, part)))
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(ends, F.array().cast("array<string>"), step), "/"))


def _targets(url: Column, html: Column) -> Column:
    """Absolute addresses of canonical links and refresh redirects in a page's tags; targets of other schemes (``mailto:``) are left out."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(_CANONICAL)),
                            lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")),
                          lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    # A target without a path of its own is the page itself; others start in the folder of the page's path.
    path, own = path_of(url), lambda t: F.regexp_extract(t, r"(?s)^[^?#]*", 0)
    near = lambda t: F.when(own(t) == "", path).otherwise(_folded(F.concat(F.regexp_replace(path, r"[^/]*$", ""), own(t))))
    whole = lambda t: (F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
                       .when(t.startswith("/"), F.concat(scheme, F.lit("://"), host_of(url), t))
                       .when((t != "") & ~t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(scheme, F.lit("://"), host_of(url), near(t))))
    return F.filter(F.transform(F.concat(canonical, refresh), whole), lambda t: t.isNotNull())


def link_edges(pages: DataFrame) -> DataFrame:
    """``(from_url, to_url)`` of the canonical links and redirects that ``pages(url, html)`` state; relative ones start at the page's own url."""
    return pages.select(F.col("url").alias("from_url"), F.explode(_targets(F.col("url"), F.col("html"))).alias("to_url"))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)  # a host has no slash and a path begins with one


def best_rules(places: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(key, rule, verdict)``: the longest fitting rule of each distinct ``(key, host, path)``; at equal length allow wins.

    A rule fits its host and all subdomains if the path starts with its own.  Each host is looked up by its
    endings, no longer than the longest rule host; Spark sends the rules to all tasks only while they are small.
    """
    spark = places.sparkSession
    table = spark.createDataFrame([(h, h, p, v) for v, h, p in rules], "tail string, rule_host string, rule_path string, rule_verdict string")
    depth = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - depth + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = places.select("key", "path", F.explode(tails).alias("tail")).join(table, "tail").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    return (found.groupBy("key").agg(F.max(F.struct(F.length(rule).alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), rule.alias("rule"))).alias("r"))
            .select("key", "r.rule", F.when(F.col("r.allow"), "allow").otherwise("block").alias("verdict")))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, links: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages(page_id, url, html)``.

    Addresses that differ only in scheme, query, fragment or the case of the host are one place.  Places tied by
    redirects or canonical links (``links(from_url, to_url)``, by default those the pages state) are aliases.  A
    place with a rule of its own follows it.  One without is blocked if a rule blocks any of its aliases and none
    of them is allowed by a rule; an explicit allow comes first.  Null urls and urls without ``://`` have empty host
    and path, no rule and no aliases, and are allowed.  Repeated rows each get a row; an empty table gives an
    empty result; other columns are ignored, and a missing ``html`` column states no links.
    """
    if links is None:
        links = link_edges(pages) if "html" in pages.columns else pages.sparkSession.createDataFrame([], "from_url string, to_url string")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", _key(F.col("host"), F.col("path")))
    ends = stage(links.select(*[f(F.col(c)).alias(f"{side}_{name}") for side, c in (("from", "from_url"), ("to", "to_url")) for name, f in (("host", host_of), ("path", path_of))]).distinct())
    edges = ends.select(_key(F.col("from_host"), F.col("from_path")).alias("a"), _key(F.col("to_host"), F.col("to_path")).alias("b")).filter("from_host <> '' and to_host <> ''")
    places = (parsed.select("key", "host", "path").union(ends.select(_key(F.col("from_host"), F.col("from_path")), "from_host", "from_path"))
              .union(ends.select(_key(F.col("to_host"), F.col("to_path")), "to_host", "to_path")).filter("host <> ''").distinct())
    ruled = stage(best_rules(places, rules))
    roots = components(edges)
    tied = roots.join(ruled.select(F.col("key").alias("node"), "verdict"), "node").groupBy("root").agg(
        F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed"))
    carried = roots.join(tied.filter("blocked and not allowed"), "root").select(F.col("node").alias("key"), F.lit("block").alias("carried"))
    return (parsed.join(ruled.hint("merge"), "key", "left").join(carried.hint("merge"), "key", "left")
            .select("page_id", "host", "path", "rule", F.coalesce("verdict", "carried", F.lit("allow")).alias("verdict")))
