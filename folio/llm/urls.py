"""URL block and allow rules with redirect equivalence.

Urls that redirect to or name the same canonical page are aliases. Their edges come from
``<link rel="canonical">`` and ``<meta http-equiv="refresh">`` of the page (``&amp;`` read as ``&``) and from the url's own
canonical form (no scheme, fragment, tracking parameter, trailing slash or .html). Connected
components of these edges carry a block on one alias to those that no rule names.

DataFrame operations only. Rules meet urls by an equi join on the host's suffixes, so the
work per url is the number of its host's labels, whatever the number of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import ascii_lower, written
from folio.llm.graph import components

AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL_TAG = r"(?is)<link\s[^>]*rel\s*=\s*[\"']?canonical[\"'\s>][^>]*>?"
REFRESH_TAG = r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[\"'\s][^>]*>"
BASE_TAG = r"(?is)<base\s(?:[^>]*\s)?href\s*=\s*[\"']?([^\"'\s>]+)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
RULES_BROADCAST = 64 << 20      # bytes of rules, as texts with some room for each


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, AFTER, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER, 2), F.lit(""))


def canonical_form(url: Column) -> Column:
    """Host and path without index page, .html and trailing slash, then what is left of the
    query after tracking parameters; a url without ``://`` is its own form."""
    path = F.regexp_replace(path_of(url), r"(?:/index)?\.html?$|/+$", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), r"(?:^|&)(?:utm_[a-z]+|ref)=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.when(F.instr(url, "://") == 0, url).otherwise(
        F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), 0)


def _unescaped(href: Column) -> Column:
    return F.replace(href, F.lit("&amp;"), F.lit("&"))


def _without_dots(path: Column) -> Column:
    """A path from the root without its . and .. segments."""
    def step(kept, x):
        return F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, x))
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    clean = F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step), "/"))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), clean).otherwise(path)


def resolved(href: Column, base: Column) -> Column:
    """The url that ``href`` names on a page of url ``base``; null if it names none: another scheme than
    those with ``://``, or relative to a base that is no url."""
    own, rest = (F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", k) for k in (1, 2))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    path = F.when(own == "", path_of(base)).when(own.startswith("/"), own).otherwise(
        F.concat(F.when(folder == "", "/").otherwise(folder), own))
    query = F.when((own == "") & ~rest.startswith("?"), F.regexp_extract(base, r"(?s)\?[^#]*", 0)).otherwise(F.lit(""))
    return F.when(href.rlike(SCHEME + "//"), href).when(href.rlike(SCHEME), F.lit(None)).when(
        href.startswith("//"), F.concat(F.lit("http:"), href)).when(
        base.rlike(SCHEME + "//"), F.concat(F.lit("http://"), host_of(base), _with(path, _without_dots), query, rest))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): alias edges of the pages, between urls and canonical forms."""
    u = F.col(url).cast("string")
    own = pages.select(u.alias("a"), canonical_form(u).alias("b"))
    h = F.col(html).cast("string")
    hrefs = F.concat(
        F.transform(F.regexp_extract_all(h, F.lit(CANONICAL_TAG), 0), lambda t: F.regexp_extract(t, r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(F.regexp_extract_all(h, F.lit(REFRESH_TAG), 0), lambda t: F.regexp_extract(t, r"(?is)url\s*=\s*[\"']?([^\"'\s>]+)", 1)))
    named = pages.where(h.rlike(r"(?i)canonical|refresh")).select(u.alias("a"), _unescaped(F.regexp_extract(h, BASE_TAG, 1)).alias("base"), hrefs.alias("hrefs"))
    # a step a projection, and exploded last: a filter on the result would else carry every step into every use of the one before it
    named = named.select("a", F.coalesce(F.when(F.col("base") != "", resolved(F.col("base"), F.col("a"))), "a").alias("base"), "hrefs")
    targets = F.transform(F.filter("hrefs", lambda x: x != ""), lambda x: _with(_unescaped(x), lambda y: resolved(y, F.col("base"))))
    forms = F.transform(F.filter(targets, lambda x: x.isNotNull()), canonical_form)
    return own.union(named.select("a", F.explode(forms).alias("b"))).where("a IS NOT NULL").distinct()


def explicit_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict): the longest rule that fits each url of (url, host, path); of equal
    rules allow wins. ``rules``: (verdict, host, path)."""
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    size = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 100).alias("bytes"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    if (size["bytes"] or 0) <= RULES_BROADCAST:
        r = F.broadcast(r)
    labels = F.split("host", r"\.")
    # no more of a host's suffixes than the longest host of a rule has labels
    first = F.greatest(F.lit(1), F.size(labels) - (size["labels"] or 1) + 1)
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.select("url", "path", F.explode(suffixes).alias("rule_host")).join(r, "rule_host").where(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.char_length(rule).alias("n"), (F.col("rule_verdict") == "allow").alias("allow"), rule.alias("rule"), F.col("rule_verdict").alias("verdict")))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
          default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page row.

    The longest fitting rule decides. A url that no rule fits takes its aliases' decision: allow
    if a rule allows one of them, else block if a rule blocks one, else ``default``. A null url or
    one without ``://`` has empty host and path and no rule. Repeated rows come back as often as
    given, a null page_id stays null, null html has no links, an empty table gives an empty table,
    and other columns are not read."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    urls = p.where("url IS NOT NULL").select("url").distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    explicit = written(explicit_rules(urls, rules), "url_rules")
    alias = components(link_edges(p), "a", "b")
    known = urls.select("url").join(alias.withColumnRenamed("node", "url"), "url", "left").select(
        "url", F.coalesce("root", "url").alias("root")).join(explicit, "url", "left")
    group = known.where("verdict IS NOT NULL").groupBy("root").agg(
        F.max(F.when(F.col("verdict") == "allow", "allow").otherwise("")).alias("allowed"))
    judged = known.join(group, "root", "left").select(
        "url", "rule", F.coalesce("verdict", F.when(F.col("allowed") == "allow", "allow").when(F.col("allowed") == "", "block"), F.lit(default)).alias("verdict"))
    return p.drop("html").join(judged, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
