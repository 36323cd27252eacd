"""URL rules with redirect equivalence.

Rules are matched by host (subdomains included) and path prefix, the longest wins.  Redirects
(meta refresh) and canonical links of the pages are edges between urls; their connected
components are computed in Spark, and a block decision reaches all urls of a component that no
rule judges, unless an allow rule judges one of them: an explicit allow wins over a propagated
block, and a url's own rule over both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed_input, written
from .components import connected_components

#: (host, path prefix, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s)(?:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s)(?:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out


def node_of(url: Column) -> Column:
    """Name of a url as a node: without scheme and fragment, host in lower case."""
    rest = F.regexp_extract(url, r"^(?s)(?:.*?)://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def targets(html: Column) -> Column:
    """Urls that a page declares by rel=canonical or a meta refresh."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TAG), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b")), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.filter(F.concat(canonical, refresh), lambda u: u != "")


def _without_dots(path: Column) -> Column:
    """A path with its . and .. steps followed."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def _absolute(target: Column, url: Column) -> Column:
    """A target against the url of its page: absolute (scheme://..), //host/.., /path, ?query, or relative to
    the page's folder; other schemes (mailto:) and pages without a scheme give none."""
    scheme = F.regexp_extract(url, r"^(?s)(.*?)://", 1)
    path, rest = F.regexp_extract(target, r"^(?s)([^?#]*)", 1), F.regexp_extract(target, r"^(?s)[^?#]*(.*)", 1)
    folder = F.regexp_extract(path_of(url), r"^(?s)(.*/)", 1)
    page = F.concat(F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), F.when(target.startswith("#"), F.regexp_extract(url, r"^(?s)[^?#]*(\?[^#]*)", 1)).otherwise(F.lit("")))
    full = F.when(path.startswith("/"), path).when(path == "", page).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~url.contains("://"), F.lit(None))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).otherwise(F.concat(scheme, F.lit("://"), host_of(url), _without_dots(full), rest)))


def judged_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=None, redirects: DataFrame | None = None) -> DataFrame:
    """One row per input row: the id, host, path, rule (or null), verdict (allow or block) and
    propagated (the verdict came from the component).

    redirects: further edges (url, target), such as HTTP redirects of a crawl.

    Defined cases: a null url, or one without ``://``, has empty host and path, no rule, no edge
    and is allowed; null or empty pages declare nothing; a url that only occurs as a target takes
    part with its own rule; repeated rows are judged alike; an empty table gives an empty result;
    further columns are not read.
    """
    rules = RULES if rules is None else rules
    base = renamed_input(pages, id=id_col, url=url_col, html=html_col)
    edges = base.select("url", F.explode(targets(F.col("html"))).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = edges.select("url", _absolute(F.col("target"), F.col("url")).alias("target")).filter("url is not null and target is not null")
    edges = written(edges.select("url", "target", node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")).filter("u is not null and v is not null"), "edges")
    roots = connected_components(edges.select("u", "v"))
    own = lambda c: _rule(host_of(c), path_of(c), rules)
    # what the rules say of the urls of each component, the targets included
    urls = edges.select(F.col("u").alias("node"), F.col("url").alias("x")).unionByName(edges.select(F.col("v").alias("node"), F.col("target").alias("x"))).distinct()
    said = urls.join(roots, "node").select("root", own(F.col("x"))["verdict"].alias("said")).groupBy("root").agg(F.bool_or(F.col("said") == "block").alias("blocked"), F.bool_or(F.col("said") == "allow").alias("allowed"))
    passed = roots.join(said, "root").filter("blocked and not coalesce(allowed, false)").select("node")
    judged = base.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), own(F.col("url")).alias("r"), node_of(F.col("url")).alias("node"))
    judged = judged.join(passed.withColumn("hit", F.lit(True)), "node", "left")
    spread = F.col("r").isNull() & F.coalesce("hit", F.lit(False))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
                         F.coalesce(F.col("r.verdict"), F.when(spread, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), spread.alias("propagated"))
