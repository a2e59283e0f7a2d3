"""URL filters (operator 4): rules plus redirect equivalence, with DataFrame functions only.

A rule names a host and a path prefix; it fits that host and its subdomains, and the longest fitting rule
decides.  Urls that no rule fits inherit from their aliases.  Aliases are the connected components over
 - spellings of one address (scheme, letter case of the host, fragment, tracking parameters, final slash),
 - every canonical link and every meta refresh found in the page (character references decoded, relative
   targets resolved against the page's own address; a base element is not read),
 - rows of a redirect table, if given.
A component with a blocked address blocks its undecided members, unless an address of it is explicitly
allowed: an allow takes precedence.  A rule's own verdict is never overturned.

Only (id, host, path, address) travel, never the html.  Common addresses are pre-aggregated.
Null url, or one without ``://``: empty host and path, no rule, no alias, verdict allow.  Null html: no
link.  Repeated rows get equal verdicts.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import decode_entities
from ledgerlens.llm.common import ascii_lower, let, table, written
from ledgerlens.llm.components import connected_components

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
LINK_TAG = r"""(?is)<link\b[^>]*\srel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"""
META_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
ATTRIBUTE = r"""(?is)[\s"']%s\s*=\s*(?:"([^">]*)|'([^'>]*)|([^"'\s>]+))"""
DELAYED = r"""(?is)^\s*(?:[\d.]*+[\s;,]*+url\s*=\s*|[\d.]++[\s;,]++(?!url\s*=))["']?([^"']+)"""
TRACKING = r"(?:^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """One spelling per address; null for a url without host."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query))
                                               .otherwise(F.lit(""))))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, its action) of the longest fitting rule, or nulls."""
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else F.when(fits, F.lit(h + p)).otherwise(name)
        action = F.when(fits, F.lit(act)) if action is None else F.when(fits, F.lit(act)).otherwise(action)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def link_values(html: Column) -> Column:
    """The address attributes, as written, of all canonical links and meta refreshes of a page."""
    def values(tags, attribute, kind):
        tags = F.coalesce(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), F.array().cast("array<string>"))
        return F.transform(tags, lambda t: F.struct(F.lit(kind).alias("kind"), F.concat(
            *[F.regexp_extract(t, ATTRIBUTE % attribute, i) for i in (1, 2, 3)]).alias("raw")))
    return F.concat(values(LINK_TAG, "href", "link"), values(META_TAG, "content", "refresh"))


def link_target(kind: Column, raw: Column, host: Column, path: Column) -> Column:
    """Absolute url of one attribute of ``link_values`` on the page at host and path, or null."""
    plain = let(decode_entities(raw), lambda r: F.when(kind == "refresh", F.regexp_extract(r, DELAYED, 1)).otherwise(r))
    plain = F.regexp_replace(F.regexp_replace(plain, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    return let(plain, lambda r: _absolute(r, host, path))


def _absolute(raw: Column, host: Column, path: Column) -> Column:
    own = F.regexp_extract(raw, r"^[^?#]*", 0)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"^.*/", 0)
    full = (F.when(own == "", path).when(own.startswith("/"), own).otherwise(F.concat(folder, own)))
    full = F.regexp_replace(full, r"/\.{1,2}$", "$0/")
    parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), lambda done, p: (
        F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(p)))))
    return (F.when((raw == "") | raw.startswith("#"), None)
            .when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), raw)
            .when(raw.startswith("//"), F.concat(F.lit("http:"), raw))
            .when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (host == ""), None)
            .otherwise(F.concat(F.lit("http://"), host, F.array_join(parts, "/"), F.regexp_extract(raw, r"(?s)[?#].*", 0))))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.  ``redirects`` has (from_url, to_url)."""
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                          address_of(url).alias("address"), link_values(F.col("html")).alias("links"))
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    judged = written(judged.withColumns({"rule": rule, "action": action}), "url-judged")
    far = judged.select("address", F.col("host").alias("h"), F.col("path").alias("p"), F.explode("links").alias("link"))
    # written: the target is referred to many times below
    far = written(far.select("address", "h", "p", F.col("link.kind").alias("kind"), F.col("link.raw").alias("raw")).select(
        "address", link_target(F.col("kind"), F.col("raw"), F.col("h"), F.col("p")).alias("target")), "url-links")
    far = far.filter("target is not null")
    if redirects is not None:
        far = far.union(redirects.select(address_of(F.col("from_url")), "to_url"))
    t = F.col("target")
    far = far.select("address", address_of(t).alias("to"), rule_columns(host_of(t), path_of(t), rules)[1].alias("action"))
    nodes = (judged.select("address", "action").union(far.select("to", "action"))
             .filter("address is not null").groupBy("address")
             .agg(F.max(F.coalesce(F.col("action") == "block", F.lit(False))).alias("blocked"),
                  F.max(F.coalesce(F.col("action") == "allow", F.lit(False))).alias("allowed")))
    comps = connected_components(far.select(F.col("address").alias("a"), F.col("to").alias("b")), "url-cc")
    member = written(nodes.join(comps, F.col("address") == F.col("node"), "left")
                     .select("address", F.coalesce("component", "address").alias("component"), "blocked", "allowed"),
                     "url-members")
    groups = (member.groupBy(F.col("component").alias("c"))
              .agg(F.max("blocked").alias("b"), F.max("allowed").alias("w")).filter("b and not w"))
    blocked = (member.join(groups, F.col("component") == F.col("c"), "left_semi")
               .select(F.col("address").alias("bad")))
    return (judged.join(blocked, F.col("address") == F.col("bad"), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("action", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).alias("verdict")))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_PARTS = r"""CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"""


def _host(u: str) -> str:
    return (rf"translate(regexp_extract({_PARTS.format(u=u)}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            rf"'abcdefghijklmnopqrstuvwxyz')")


def _node(u: str) -> str:
    rest = _PARTS.format(u=u)
    q = (rf"regexp_replace(regexp_replace(regexp_extract({rest}, '^[^?#]*\?([^#]*)', 1), "
         rf"'{TRACKING}', '', 'g'), '^&+', '')")
    return (rf"CASE WHEN {_host(u)} <> '' THEN {_host(u)} || regexp_replace(regexp_extract({rest}, "
            rf"'^[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END")


def _ruled(host: str, path: str, what: int) -> str:
    out = "NULL"
    for r in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        say = r[0] if what == 0 else r[1] + r[2]
        out = (f"CASE WHEN ({host} = '{r[1]}' OR ends_with({host}, '.{r[1]}')) AND starts_with({path}, '{r[2]}') "
               f"THEN '{say}' ELSE {out} END")
    return out


_Q = lambda s: s.replace("'", "''")

OP4_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce({_host('url')}, '') AS host,
    coalesce(regexp_extract({_PARTS.format(u='url')}, '^[^/?#]*([^?#]*)', 1), '') AS path, {_node('url')} AS address,
    regexp_extract(regexp_extract(html, '{_Q(CANONICAL)}'), '{_Q(HREF)}', 1) AS c1,
    regexp_extract(regexp_extract(html, '{_Q(REFRESH)}'), '{_Q(REFRESH_URL)}', 1) AS c2 FROM pages),
q AS (SELECT *, CASE WHEN coalesce(c1, '') <> '' THEN c1 ELSE coalesce(c2, '') END AS raw FROM p),
j AS (SELECT *, {_ruled('host', 'path', 0)} AS act, {_ruled('host', 'path', 1)} AS rule,
    CASE WHEN raw = '' THEN NULL WHEN contains(raw, '://') THEN raw WHEN starts_with(raw, '//') THEN 'http:' || raw
    WHEN starts_with(raw, '/') THEN 'http://' || host || raw END AS target FROM q),
f AS (SELECT address, {_node('target')} AS dest, {_host('target')} AS thost,
    regexp_extract({_PARTS.format(u='target')}, '^[^/?#]*([^?#]*)', 1) AS tpath FROM j WHERE target IS NOT NULL),
n AS (SELECT address AS node, act FROM j UNION ALL SELECT dest, {_ruled('thost', 'tpath', 0)} FROM f),
e AS (SELECT address AS a, dest AS b FROM f UNION SELECT dest, address FROM f),
r(node, reach) AS (SELECT DISTINCT node, node FROM n WHERE node IS NOT NULL
    UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS comp FROM r GROUP BY node),
g AS (SELECT comp FROM n JOIN c USING (node) GROUP BY comp HAVING bool_or(act = 'block') AND NOT coalesce(bool_or(act = 'allow'), false)),
bad AS (SELECT node FROM c WHERE comp IN (SELECT comp FROM g))
SELECT page_id, host, path, rule,
    coalesce(act, CASE WHEN address IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
