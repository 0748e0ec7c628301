"""Allow and block rules for urls, spread over redirects and canonical links.

All of it is DataFrame work. A rule is found by equality joins on a suffix of the host and a prefix of the path, so its cost
does not grow with the number of rules. Aliases are the connected components over redirect and canonical-link edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import components, table
from lakeload.workspace import stage

# The rules of the query (host, path, action).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Query parameters that name a visit, not a document.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref|source)"
#: A refresh after more seconds is no redirect: the page itself is meant to be read.
IMMEDIATE = 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The address a url stands for: no scheme, ``www.`` or ``m.``, fragment, tracking parameter, ``.html`` or last ``/``."""
    host = F.regexp_replace(host_of(url), r"\A(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?s)(/index)?(\.html?|/)\z", "")
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"\A{TRACKING}(=|\z)"))
    rest = F.array_join(F.array_sort(kept), "&")
    return F.concat(F.lit("//"), host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; ``..`` above the root goes."""
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/"),
        none,
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(kept, "/")


def resolve(target: Column, url: Column) -> Column:
    """The whole url that ``target`` names on the page ``url``; null for one without a place of its own.

    A target may be whole, start at ``//`` (scheme of the page), ``/`` (its host), ``?`` (its path), or be relative to the
    folder of the page's path. Other schemes (``mailto:``), fragments and empty targets name no page.
    """
    scheme = F.regexp_extract(url, r"(?s)\A(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    path, rest = F.regexp_extract(target, r"(?s)\A([^?#]*)", 1), F.regexp_extract(target, r"(?s)\A[^?#]*(.*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)\A/?(.*/)?", 1)
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"\A([A-Za-z][A-Za-z0-9+.-]*:|#|\z)"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .when(target.startswith("/"), F.concat(site, F.lit("/"), _without_dots(F.substr(path, F.lit(2))), rest))
        .otherwise(F.concat(site, F.lit("/"), _without_dots(F.concat(folder, path)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of every page's canonical link and immediate redirect, in canonical form; pages have url and html.

    Targets are resolved against the page's url. A refresh counts if it states a delay of ``IMMEDIATE`` seconds at most.
    """
    link = F.regexp_extract("html", r"(?i)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    meta = F.regexp_extract("html", r"(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    link, meta = (F.replace(tag, F.lit("&amp;"), F.lit("&")) for tag in (link, meta))
    delay = F.regexp_extract(meta, r"(?i)\bcontent\s*=\s*[\"']?\s*(\d+)", 1).try_cast("long")
    redirect = F.regexp_extract(meta, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    targets = F.array(
        F.regexp_extract(link, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
        F.when(delay <= IMMEDIATE, redirect),
    )
    linked = pages.where(F.col("html").rlike(r"(?i)<(link|meta)\b[^>]*(canonical|refresh)"))
    found = linked.select(F.col("url").alias("src"), F.explode(targets).alias("target"))
    whole = resolve(F.col("target"), F.col("src"))
    return found.select("src", canonical(whole).alias("dst")).where("dst IS NOT NULL AND dst <> '//'")


def url_edges(pages: DataFrame) -> DataFrame:
    """Edges over which decisions spread: url to its canonical form, and the links that the pages themselves state."""
    named = pages.where("url LIKE '%://%'")
    own = named.select(F.col("url").alias("src"), canonical(F.col("url")).alias("dst"))
    return own.unionAll(page_links(named))


def rule_of(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds host, path, rule and action to ``urls`` (url, distinct): the longest rule that fits, null without one.

    Of rules of one length (they differ in host and path length only) allow goes first. Rules: host, path, action.
    """
    rules = rules.groupBy("host", "path").agg(F.min("action").alias("action"))  # allow before block
    lengths = rules.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.length("path")).alias("_lengths"))
    parted = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = parted.select("url", "path", F.explode(suffixes).alias("_host")).join(lengths, "_host")
    asked = asked.select("url", "_host", "path", F.explode("_lengths").alias("_length"))
    asked = asked.where("length(path) >= _length").select(
        "url", F.col("_host").alias("host"), F.expr("substring(path, 1, _length)").alias("path")
    )
    fits = asked.join(rules, ["host", "path"]).withColumn("rule", F.concat("host", "path"))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("a"), "rule", "action"))
    won = fits.groupBy("url").agg(best.alias("b")).select("url", "b.rule", "b.action")
    return parted.join(won, "url", "left")


def judge_urls(urls: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(url, host, path, rule, verdict) for every distinct url of ``urls``, null last included once.

    A url with a rule takes the rule's action. Any other takes what its aliases say: allow if one of them is allowed by a
    rule, else block if one is blocked, else allow. ``edges`` (src, dst) are redirects and canonical links.
    Other columns of ``urls`` are not looked at, whatever their names; repeated urls give one row, no urls give none, and
    without rules or edges everything is allowed or judged by rule alone.
    """
    judged = stage(rule_of(urls.select("url").where("url IS NOT NULL").distinct(), rules), "url-rules")
    # only what a decision can reach matters, but links may pass through urls that are not judged
    roots = components(edges, "url-components")
    placed = judged.join(roots.withColumnRenamed("node", "url"), "url", "left")
    placed = stage(placed.select("url", "host", "path", "rule", "action", F.coalesce("root", "url").alias("root")), "urls")
    said = placed.where("action IS NOT NULL").groupBy("root").agg(F.min("action").alias("spread"))
    said = stage(said, "url-said")
    out = placed.join(said, "root", "left").select(
        "url", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict")
    )
    nothing = urls.where("url IS NULL").select("url").limit(1)  # one row stands for all urls that are null
    empty = F.lit("").alias
    return out.unionAll(nothing.select("url", empty("host"), empty("path"), F.lit(None).cast("string"), F.lit("allow")))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    judged = judge_urls(pages, rules, url_edges(pages)).alias("b")
    return (
        pages.select("page_id", "url")
        .alias("a")
        .join(judged, F.expr("a.url <=> b.url"), "left")
        .select("page_id", "host", "path", "rule", "verdict")
    )


SQL10 = r"""
WITH rules(rhost, rpath, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id
    ORDER BY length(rhost || rpath) DESC, action) AS nth
    FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
own AS (SELECT p.*, rule, action,
    '//' || regexp_replace(host, '\A(www|m)\.', '') || regexp_replace(path, '(?s)(/index)?(\.html?|/)\z', '') ||
    coalesce((SELECT '?' || string_agg(q, '&' ORDER BY q) FROM unnest(string_split(
        regexp_extract(url, '(?s)\A[^?#]*\?([^#]*)', 1), '&')) AS t(q)
        WHERE q <> '' AND NOT regexp_matches(q, '\A(utm_[a-z]+|gclid|fbclid|ref|source)(=|\z)')), '') AS root
    FROM p LEFT JOIN fits ON fits.page_id = p.page_id AND nth = 1),
said AS (SELECT root, min(action) AS spread FROM own WHERE action IS NOT NULL GROUP BY root)
SELECT page_id, host, path, rule, coalesce(action, spread, 'allow') AS verdict
FROM own LEFT JOIN said USING (root)
"""
