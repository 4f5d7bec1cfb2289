"""URL rules with redirect equivalence.

Rules name a host (with its subdomains) and the beginning of a path; the
longest one that fits decides.  A page that no rule fits takes over decisions
of its aliases: redirects, refresh tags and canonical links are edges between
addresses, connected components of these edges are groups of aliases, and a
blocked address blocks its whole group.  Explicit allow rules go first: a page
that an allow rule fits stays allowed, whatever its aliases are; what only
neighbours an allowed address is not thereby allowed.

Only addresses that some edge names enter the components; all other pages pass
through one broadcastable join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stipendia.llm.common import saved
from stipendia.llm.components import components

# (verdict, host, beginning of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# Possessive, so that a tag of any length is read without a stack.
_TAG = r"""(?i)<(?:link|meta)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to the path, A-Z lower-cased; empty without one."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    The rules are written into the plan: meant for lists of some hundreds.
    """
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    if not by_length:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in by_length]
    return (F.coalesce(*[F.when(fit, F.lit(h + p)) for fit, (_, h, p) in zip(fits, by_length)]),
            F.coalesce(*[F.when(fit, F.lit(v)) for fit, (v, _, _) in zip(fits, by_length)]))


def address(url: Column) -> Column:
    """The node of a url: scheme and host lower-cased, dot segments resolved, no fragment; null without scheme or host."""
    clean = F.regexp_replace(F.trim(url), r"[\t\n\r]", "")
    head = F.regexp_extract(clean, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(clean, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(clean, r"\A[^?#]*(\?[^#]*)", 1)
    segments = F.split(path, "/", -1)
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(s))))
    ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    plain = F.when(path.contains("/."), F.concat(F.array_join(folded, "/"), ends)).otherwise(path)
    return F.when(head != "", F.concat(_lower(head), plain, query))


def resolved(link: Column, base: Column) -> Column:
    """The url a link stands for on the page ``base`` (an address); null for links to no other page."""
    ref = F.regexp_replace(F.trim(link), r"[\t\n\r]", "")
    scheme, root = F.regexp_extract(base, r"\A([^:]+:)", 1), F.regexp_extract(base, r"\A([^:]+://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"\A[^:]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"\A(.*/)", 1))
    return (F.when((ref == "") | ref.startswith("#"), F.lit(None))
            .when(ref.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), ref)
            .when(ref.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(ref.startswith("//"), F.concat(scheme, ref))
            .when(ref.startswith("/"), F.concat(root, ref))
            .when(ref.startswith("?"), F.concat(root, path, ref))
            .otherwise(F.concat(root, folder, ref)))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, without quotes and with ``&amp;`` read; empty if the tag has none."""
    value = F.regexp_extract(tag, rf"""(?i)[\s"'/]{name}{_VALUE}""", 1)
    bare = F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.regexp_replace(bare, "(?i)&amp;|&#38;|&#x26;", "&")


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): edges from each page to what its canonical links and refresh tags name.

    Tags in comments, scripts and styles do not count.  Null pages and pages without an address have no edges.
    """
    rows = pages.select(address(F.col(f"`{url_col}`")).alias("a"), F.col(f"`{html_col}`").alias("html"))
    rows = rows.where(F.col("a").isNotNull() & F.col("html").rlike("(?i)canonical|refresh"))
    tags = rows.select("a", F.explode(F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = _lower(F.col("tag")).startswith("<link") & _attribute(F.col("tag"), "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)")
    refresh = _lower(F.col("tag")).startswith("<meta") & _attribute(F.col("tag"), "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    to = F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?i)^[\s0-9.]*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
    named = tags.select("a", F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, to).alias("link"))
    return named.select("a", address(resolved(F.col("link"), F.col("a"))).alias("b")).where("b is not null and a <> b").distinct()


def alias_verdicts(links: DataFrame, rules=RULES) -> DataFrame:
    """(address, component, blocked): every address named by ``links`` (a, b), and whether a rule blocks an alias of it."""
    groups = saved(components(links).withColumnRenamed("id", "address"))
    verdict = matched(host_of(F.col("address")), path_of(F.col("address")), rules)[1]
    blocked = groups.groupBy("component").agg(F.bool_or(F.coalesce(verdict == "block", F.lit(False))).alias("blocked"))
    return groups.join(blocked, "component").select("address", "component", "blocked")


def judged(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id",
           url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, component): one row per row of ``pages``.

    ``redirects`` (from_url, to_url), as a crawler logs them, add edges to those of the pages.  ``component`` is the
    smallest address of the page's aliases, null if no edge names it.  A null url or one without ``://`` has empty host
    and path and no aliases, and is allowed; a null or empty html has no links.  Repeated rows are judged alike.  Other
    columns are not read; an empty table gives an empty table.  Relative links count from the page's own url (a base tag
    is not read).
    """
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        both = redirects.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b"))
        links = links.union(both.where("a <> b")).distinct()
    aliases = saved(alias_verdicts(links, rules))
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        address(url).alias("address"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("own")).join(aliases, "address", "left")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(
        "own", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"), "component")


def _case(host: str, path: str, position: slice) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    whens = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') "
                     f"THEN '{''.join((v, h, p)[position])}'" for v, h, p in ordered)
    return f"CASE {whens} END"


_FOLD = (r"list_reduce(list_prepend(['\x00'], [[s] FOR s IN string_split({0}, '/')]), lambda acc, x: CASE x[1] WHEN '.' THEN acc "
         r"WHEN '..' THEN acc[:greatest(len(acc) - 1, 2)] ELSE list_concat(acc, x) END)[2:]")


def _address(url: str) -> str:
    clean = rf"regexp_replace(trim({url}, ' '), '[\t\n\r]', '', 'g')"
    head = rf"regexp_extract({clean}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)"
    path = rf"regexp_extract({clean}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)"
    query = rf"regexp_extract({clean}, '^[^?#]*(\?[^#]*)', 1)"
    plain = (f"CASE WHEN contains({path}, '/.') THEN array_to_string({_FOLD.format(path)}, '/') || CASE WHEN string_split({path}, '/')[-1] "
             f"IN ('.', '..') THEN '/' ELSE '' END ELSE {path} END")
    return f"CASE WHEN {head} <> '' THEN translate({head}, '{_UPPER}', '{_LOWER}') || ({plain}) || {query} END"


def _attribute_sql(name: str) -> str:
    value = rf"""regexp_extract(tag, '(?i)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    bare = f"""CASE WHEN {value}[1] IN ('"', '''') THEN {value}[2:-2] ELSE {value} END"""
    return f"regexp_replace({bare}, '(?i)&amp;|&#38;|&#x26;', '&', 'g')"


# The same for DuckDB, components by a recursive statement over the addresses that edges name.
SQL = rf"""
WITH RECURSIVE p AS (
       SELECT page_id, url, html, {_address('url')} AS address,
              coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
     tags AS (SELECT address AS a, unnest(regexp_extract_all(
                regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
                '(?i)<(?:link|meta)[\s/](?:[^>"'']+|"[^"]*"|''[^'']*'')*>')) AS tag
              FROM p WHERE address IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
     named AS (SELECT a, CASE WHEN lower(tag[1:5]) = '<link' AND regexp_matches({_attribute_sql('rel')}, '(?i)(?:^|\s)canonical(?:\s|$)')
                 THEN {_attribute_sql('href')}
                 WHEN lower(tag[1:5]) = '<meta' AND regexp_matches({_attribute_sql('http-equiv')}, '(?i)^\s*refresh\s*$')
                 THEN regexp_extract({_attribute_sql('content')}, '(?i)^[\s0-9.]*[;,]?\s*url\s*=\s*["'']?([^"'']*)', 1) END AS link FROM tags),
     refs AS (SELECT a, regexp_replace(trim(link, ' '), '[\t\n\r]', '', 'g') AS ref, regexp_extract(a, '^([^:]+:)', 1) AS scheme,
                     regexp_extract(a, '^([^:]+://[^/?#]*)', 1) AS root, regexp_extract(a, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM named),
     ends AS (SELECT a, CASE WHEN ref = '' OR ref[1] = '#' THEN NULL
                WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref
                WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                WHEN starts_with(ref, '//') THEN scheme || ref WHEN ref[1] = '/' THEN root || ref
                WHEN ref[1] = '?' THEN root || path || ref
                ELSE root || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || ref END AS b FROM refs),
     links AS (SELECT DISTINCT a, {_address('b')} AS b FROM ends),
     edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
     reach(a, b) AS (SELECT a, a FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
     nodes AS (SELECT DISTINCT b, coalesce(regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1), '') AS host,
                      coalesce(regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM reach),
     blocked AS (SELECT DISTINCT a FROM reach JOIN nodes USING (b) WHERE {_case('host', 'path', slice(0, 1))} = 'block')
SELECT page_id, host, path, {_case('host', 'path', slice(1, 3))} AS rule,
       coalesce({_case('host', 'path', slice(0, 1))}, CASE WHEN blocked.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN blocked ON p.address = blocked.a"""
