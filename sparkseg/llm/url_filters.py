"""URL rules by host suffix and path prefix, and their spread over aliases.

Pages that link to one another by redirect or canonical link, or that name one target, are aliases:
connected components over all such edges.  A page takes the verdict of the longest rule that fits its
own URL; one without a rule is blocked if a rule blocks any of its aliases, crawled or not.  A rule of
its own always goes first, so an explicit allow holds inside a blocked group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .frames import cut
from .quality_rules import let


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))
_TAGS = r"(?is)<(?:link|meta)\b[^>]*"
_BASE = r"(?is)<base\b[^>]*"
#: Patterns of the two tags, the attribute with the target in the three ways of quoting, and what a refresh has before its target.
_CANONICAL, _REFRESH = r"""(?is)^<link\b.*\srel\s*=\s*["']?\s*canonical\b""", r"""(?is)^<meta\b.*\shttp-equiv\s*=\s*["']?\s*refresh\b"""
_WAYS = ('"([^"]*)', "'([^']*)", "([^\"'\\s>][^\\s>]*)")
_DELAY = r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ://"""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The rule that fits with the longest host and path together; of equals the first by host."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.host)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def page_key(url: Column) -> Column:
    """What URLs of one page have in common: host and path without a fragment, query kept."""
    return F.concat(lower_ascii(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)://[^/?#]*([^#]*)", 1))


def resolved(url: Column, target: Column) -> Column:
    """A target as an absolute URL, seen from the page's URL; null for other schemes than those with //, and without a base."""
    origin = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    named, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    joined = F.when(F.startswith(target, F.lit("/")), named).otherwise(F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), named))
    parts = F.split(F.regexp_replace(joined, "^/", ""), "/")

    def step(a: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))

    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    plain = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), ends), "/"))
    relative = F.when(named == "", F.concat(origin, path, F.when(F.startswith(rest, F.lit("?")), rest).otherwise(F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)))).otherwise(F.concat(origin, plain, rest))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((origin == "") | target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(url, "(?s)^([^:/?#]*:)", 1), target))
        .otherwise(relative)
    )


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not, without surrounding spaces and with & decoded; empty if there is none."""
    value = F.concat(*(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{way}", 1) for way in _WAYS))
    return F.regexp_replace(F.trim(value), "&(?:amp|#38|#x26);", "&")


def page_targets(html: Column, url: Column) -> Column:
    """Redirect and canonical targets that all of a page's tags name, as absolute URLs, seen from its base element if it has one."""
    home = F.coalesce(resolved(url, F.nullif(attribute(F.regexp_extract(html, _BASE, 0), "href"), F.lit(""))), url)

    def target(tag: Column) -> Column:
        content = attribute(tag, "content")
        moved = F.when(content.rlike(_DELAY), F.regexp_replace(F.regexp_replace(content, _DELAY, ""), "^[\"']|[\"'].*$", ""))
        return F.when(tag.rlike(_CANONICAL), attribute(tag, "href")).when(tag.rlike(_REFRESH), moved)

    named = F.filter(F.transform(F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0)), target), lambda x: x.isNotNull() & (x != ""))
    return F.filter(let(home, lambda h: F.transform(named, lambda x: resolved(h, x))), lambda x: x.isNotNull())


def filter_urls(pages: DataFrame, edges: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Returns the id, host, path, rule (or null) and verdict (allow or block) of each page.

    edges (source, target: URLs) adds redirects that a crawl has logged; chains through URLs that aren't
    pages count, and rules judge these URLs too.  Targets are resolved against the page's URL.  Without aliases and rule a page is allowed.  A null URL has an empty host and path, fits
    no rule and has no aliases; a null page id is judged like any other, and repeated rows alike.  Scheme
    and fragment don't tell URLs apart.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), (F.col(f"`{html_col}`").cast("string") if html_col else F.lit(None).cast("string")).alias("html"))
    host, path = host_path(F.col("url"))
    judged = base.select("id", "url", "html", host.alias("host"), path.alias("path")).select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("own"))
    links = judged.where("url is not null and html is not null and (contains(lower(html), 'canonical') or contains(lower(html), 'refresh'))").select(F.col("url").alias("source"), F.explode(page_targets(F.col("html"), F.col("url"))).alias("target"))
    if edges is not None:
        links = links.unionAll(edges.select("source", "target"))
    node = lambda c: F.xxhash64(page_key(F.col(c)))
    bad = lambda c: F.coalesce(longest_rule(*host_path(F.col(c)), rules)["verdict"] == "block", F.lit(False))
    links = cut(links.where("source is not null and target is not null").select(node("source").alias("a"), node("target").alias("b"), bad("source").alias("bad_a"), bad("target").alias("bad_b")).where("a <> b"))
    if links.isEmpty():
        out = judged.select("id", "host", "path", "own", F.lit(None).cast("boolean").alias("blocked"))
    else:
        groups = connected_components(links.select("a", "b"))
        mine = judged.select("id", "host", "path", "own", F.when(F.contains("url", F.lit("://")), node("url")).alias("node"))
        bad_ends = links.where("bad_a").select(F.col("a").alias("node")).unionAll(links.where("bad_b").select(F.col("b").alias("node"))).distinct()
        blocked = bad_ends.join(groups, "node").select("component").distinct().join(groups, "component").select("node", F.lit(True).alias("blocked"))
        out = mine.join(blocked, "node", "left").select("id", "host", "path", "own", "blocked")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def url_aliases_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a log of redirects in which each page moved to a short link of its path's last part, so that pages of all hosts meet in uncrawled aliases."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    edges = pages.select(F.col("url").alias("source"), F.concat(F.lit("https://go.example/"), F.regexp_extract("url", r"://[^?#]*/([^/?#]+)", 1)).alias("target"))
    return filter_urls(pages, edges)


_CASES = " ".join(f"WHEN ({{0}} = '{r.host}' OR ends_with({{0}}, '.{r.host}')) AND starts_with({{1}}, '{r.path}') THEN '{r.name}'" for r in sorted(RULES, key=lambda r: (-len(r.name), r.host)))
_BLOCKS = ", ".join(f"'{r.name}'" for r in RULES if r.verdict == "block")
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = "coalesce(" + _LOWER.format("regexp_extract(CASE WHEN contains({0}, '://') THEN {0}[instr({0}, '://') + 3:] END, '(?s)^([^/?#]*)', 1)") + ", '')"
_PATH = "coalesce(regexp_extract(CASE WHEN contains({0}, '://') THEN {0}[instr({0}, '://') + 3:] END, '(?s)^[^/?#]*([^?#]*)', 1), '')"
_KEY = _LOWER.format("regexp_extract({0}, '(?s)://([^/?#]*)', 1)") + " || regexp_extract({0}, '(?s)://[^/?#]*([^#]*)', 1)"
_QUOTED = lambda x: x.replace("'", "''")


def _sql_attribute(tag: str, name: str) -> str:
    ways = " || ".join(f"regexp_extract({tag}, '{_QUOTED(rf'(?is)\s{name}\s*=\s*{way}')}', 1)" for way in _WAYS)
    return f"regexp_replace(trim({ways}), '&(?:amp|#38|#x26);', '&', 'g')"


def _sql_resolved(url: str, target: str) -> str:
    """`resolved` over a row's columns, in steps: (SELECT ... FROM (SELECT ...))."""
    return f"""(SELECT CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN origin = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(t, '//') THEN regexp_extract(u, '(?s)^([^:/?#]*:)', 1) || t
      WHEN named = '' THEN origin || path || CASE WHEN starts_with(rest, '?') THEN rest ELSE regexp_extract(u, '(?s)^[^?#]*([?][^#]*)', 1) END
      ELSE origin || '/' || array_to_string(list_reduce(list_transform(parts, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] WHEN x[1] = '.' THEN a ELSE list_concat(a, x) END, CAST([] AS VARCHAR[])) || CASE WHEN parts[-1] IN ('.', '..') THEN [''] ELSE CAST([] AS VARCHAR[]) END, '/') || rest END
      FROM (SELECT *, string_split(regexp_replace(CASE WHEN starts_with(t, '/') THEN named ELSE regexp_extract(path, '(?s)^(.*/)', 1) || named END, '^/', ''), '/') AS parts
      FROM (SELECT {url} AS u, {target} AS t, regexp_extract({url}, '(?s)^([^:/?#]*://[^/?#]*)', 1) AS origin, regexp_extract({url}, '(?s)^[^:/?#]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract({target}, '(?s)^([^?#]*)', 1) AS named, regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1) AS rest)))"""


_MOVED = f"CASE WHEN regexp_matches(c, '{_QUOTED(_DELAY)}') THEN regexp_replace(regexp_replace(c, '{_QUOTED(_DELAY)}', ''), '^[\"'']|[\"''].*$', '', 'g') END"


def oracle_sql(logged: str = "SELECT NULL AS s, NULL AS d WHERE false") -> str:
    """The verdicts in SQL; logged selects (s, d) of logged redirects."""
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages),
r AS (SELECT *, CASE {_CASES.format("host", "path")} END AS rule, CASE WHEN contains(url, '://') THEN {_KEY.format("url")} END AS k FROM p),
g AS (SELECT url, nullif({_sql_attribute(f"regexp_extract(html, '{_BASE}')", "href")}, '') AS b, unnest(regexp_extract_all(html, '{_TAGS}')) AS tag FROM r WHERE url IS NOT NULL),
v AS (SELECT url, coalesce({_sql_resolved("url", "b")}, url) AS home, tag, {_sql_attribute("tag", "content")} AS c FROM g),
n AS (SELECT url, home, CASE WHEN regexp_matches(tag, '{_QUOTED(_CANONICAL)}') THEN {_sql_attribute("tag", "href")} WHEN regexp_matches(tag, '{_QUOTED(_REFRESH)}') THEN {_MOVED} END AS x FROM v),
l AS (SELECT url AS s, {_sql_resolved("home", "x")} AS d FROM n WHERE x <> '' UNION ALL {logged}),
e AS (SELECT {_KEY.format("s")} AS a, {_KEY.format("d")} AS b, s, d FROM l WHERE s IS NOT NULL AND d IS NOT NULL),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
m AS (SELECT a AS k, s AS url FROM e UNION SELECT b, d FROM e),
c AS (SELECT k FROM m WHERE (CASE {_CASES.format(_HOST.format("url"), _PATH.format("url"))} END) IN ({_BLOCKS}) UNION SELECT u.b FROM c JOIN u ON u.a = c.k)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKS}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN k IN (SELECT k FROM c) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


ORACLE_SQL = oracle_sql()
LOGGED_SQL = oracle_sql("SELECT url, 'https://go.example/' || regexp_extract(url, '://[^?#]*/([^/?#]+)', 1) FROM pages")
