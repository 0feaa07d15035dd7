"""URL filters: allow and block rules on hosts and paths, and redirect equivalence.

A url has the decision of its longest fitting rule. Urls without one take part in classes of aliases, the connected
components over redirects, refreshes, canonical links and trivial spellings of one address: one blocked member blocks
every alias that no rule allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaframe.operators.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the url's path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query
RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """One name for spellings of one address: no scheme, fragment or closing slash, host in lower case; null without one."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), query))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest fitting rule, a block before an allow of the same text; null where none fits."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.action)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, action = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.action)).otherwise(action)
    return text, action


# how tags and attributes are read; the SQL counterpart uses the same patterns
TAGS = r"(?is)<(?:link|meta|base)\b[^>]*>"
CANONICAL = r"""(?is)^<link\b.*[\s"'/]rel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"""
REFRESH = r"""(?is)^<meta\b.*[\s"'/]http-equiv\s*=\s*(?:"\s*refresh\s*"|'\s*refresh\s*'|refresh[\s/>])"""
BASE = r"(?is)^<base\b"
VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
HREF, CONTENT = r"""(?is)[\s"'/]href""" + VALUE, r"""(?is)[\s"'/]content""" + VALUE
JUMP = r"""(?is)(?:^|[\s;,])url\s*=\s*["']?([^"'\s]+)"""
SCHEME, ANY_SCHEME = "(?is)^[a-z][a-z0-9+.-]*://", "(?is)^[a-z][a-z0-9+.-]*:"
ORIGIN = "(?s)^(.*?://[^/?#]*)"


def _value(tag: Column, pattern: str) -> Column:
    """Value of an attribute, whichever way it is quoted."""
    found = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.trim(F.replace(found, F.lit("&amp;"), F.lit("&")), F.lit(" \t\n\r\f"))


def straight(path: Column) -> Column:
    """A path without . and .. segments; one that names a folder ends with a slash."""
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.concat(F.lit("/"), kept, F.when(path.rlike(r"(?:^|/)\.{0,2}$") & (kept != ""), "/").otherwise(""))


def resolved(base: Column, link: Column) -> Column:
    """The absolute address of a link on a page of address `base`; null where it names no other address."""
    origin, path = F.regexp_extract(base, ORIGIN, 1), path_of(base)
    tail = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    stem = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    return (
        F.when(link.rlike(SCHEME), link).when(link.rlike(ANY_SCHEME) | (link == "") | link.startswith("#"), None)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link)).when(origin == "", None)
        .when(link.startswith("?"), F.concat(origin, path, link)).when(link.startswith("/"), F.concat(origin, straight(stem), tail))
        .otherwise(F.concat(origin, straight(F.concat(folder, F.lit("/"), stem)), tail))
    )


def targets(url: Column, html: Column) -> Column:
    """Addresses that a page names as its canonical one or refreshes to. Tags may have any length, `rel` any number of words;
    links are relative to the page, or to its first `base`."""
    tags = F.regexp_extract_all(html, F.lit(TAGS), F.lit(0))
    links = F.transform(F.filter(tags, lambda t: t.rlike(CANONICAL)), lambda t: _value(t, HREF))
    jumps = F.transform(F.filter(tags, lambda t: t.rlike(REFRESH)), lambda t: F.regexp_extract(_value(t, CONTENT), JUMP, 1))
    bases = F.filter(F.transform(F.filter(tags, lambda t: t.rlike(BASE)), lambda t: _value(t, HREF)), lambda x: x != "")
    named = F.get(bases, F.lit(0))
    base = F.when(named.isNull(), url).otherwise(F.coalesce(resolved(url, named), url))
    found = F.filter(F.transform(F.concat(links, jumps), lambda x: resolved(base, x)), lambda x: x.isNotNull())
    return F.when(F.lower(html).rlike("canonical|refresh"), found)


def judged(
    pages: DataFrame, rules: list[Rule] | None = None, redirects: DataFrame | None = None,
    id_column: str = "page_id", url_column: str = "url", html_column: str | None = "html",
) -> DataFrame:
    """`(page_id, host, path, rule, verdict)`, a row for each row of `pages`.

    `redirects` may give more equivalences `(src, dst)` of urls. A null url, or one without `://`, has an empty host and
    path, no rule and no alias, and is allowed; so is every url that neither a rule nor an alias decides. An explicit
    allow stands before every inherited block. Null html names no alias, long html is read whole; repeated rows are judged
    alike; an empty table gives an empty result; other columns are not read.
    """
    rules = RULES if rules is None else rules
    url = F.col(f"`{url_column}`").cast("string")
    wanted = [F.col(f"`{id_column}`").alias("page_id"), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path")]
    named = pages.select(*wanted, key_of(url).alias("_key"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    named = named.withColumn("rule", text).withColumn("_own", action)
    edges = pages.sparkSession.createDataFrame([], "src string, dst string")
    if html_column is not None:
        html = F.col(f"`{html_column}`").cast("string")
        edges = edges.unionByName(pages.select(url.alias("src"), F.explode(targets(url, html)).alias("dst")))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    ends = edges.select(key_of(F.col("src")).alias("a"), key_of(F.col("dst")).alias("b"), "src", "dst")
    comps = components(ends.select("a", "b"))
    # decisions of all addresses that are pages or stand on an edge
    places = named.select(F.col("_key").alias("key"), "_own").unionByName(
        ends.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("src").alias("u")), F.struct(F.col("b").alias("key"), F.col("dst").alias("u")))).alias("x"))
        .select("x.key", rule_of(host_of(F.col("x.u")), path_of(F.col("x.u")), rules)[1].alias("_own"))
    )
    blocked = places.where("_own = 'block' AND key IS NOT NULL").select("key").distinct()
    comp_of = lambda df, key: df.join(comps.withColumnRenamed("vid", key), key, "left").withColumn("_class", F.coalesce("comp", key)).drop("comp")
    bad = comp_of(blocked, "key").select("_class").distinct().withColumn("_bad", F.lit(True))
    # only addresses without a rule of their own can inherit one
    open_ = comp_of(named.where("_own IS NULL AND _key IS NOT NULL"), "_key").join(bad, "_class", "left")
    inherited = open_.select("page_id", "host", "path", "rule", F.when(F.col("_bad"), "block").otherwise("allow").alias("verdict"))
    sure = named.where("_own IS NOT NULL OR _key IS NULL")
    return sure.select("page_id", "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict")).unionByName(inherited)
