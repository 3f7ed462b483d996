"""Audit of raw pages: metadata, accessibility, security and link checks as columns, and pages within some links of a root.

Every check reads a page's own html, so all of them share one scan without a shuffle; only summaries, the choice of
pages and reach() shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: Patterns of the checks, valid in Java and RE2.
TITLE = "(?is)<title[^>]*>(.*?)</title>"
DESCRIPTION = '(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"'
PATTERNS = {
    "og_title": '(?i)<meta[^>]+property="og:title"', "og_description": '(?i)<meta[^>]+property="og:description"', "og_image": '(?i)<meta[^>]+property="og:image"',
    "favicon": '(?i)<link[^>]+rel="[^"]*icon', "charset": "(?i)<meta[^>]+charset=", "viewport": '(?i)<meta[^>]+name="viewport"',
    "noindex": '(?i)<meta[^>]+name="(robots|googlebot|bingbot)"[^>]+content="[^"]*noindex', "main": '(?i)<main[ >]|role="main"', "nav": '(?i)<nav[ >]|role="navigation"',
    "hidden_focus": '(?i)<(button|input|select|textarea)[^>]*aria-hidden="true"', "mixed": '(?i)<(img|script|iframe|source|audio|video|embed)[^>]+src="http://',
    "private_key": "-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", "access_key": "AKIA[0-9A-Z]{16}", "git_token": "gh[pousr]_[A-Za-z0-9]{20,}",
    "sql_words": r"(?i)\b(select|insert into|delete from)\b", "sql_call": r"(?i)\b(query|execute|exec)\s*\(",
}
IMAGE, BLANK, HEADING, ANCHOR, ID = '(?i)<img[^>]*>', '(?i)<a[^>]+target="_blank"[^>]*>', "(?i)<h([1-6])[ >]", "(?is)<a[ >][^>]*>.*?</a>", '(?i) id="([^"]*)"'
REFERENCE = '(?i)aria-(?:labelledby|describedby|controls|owns)="([^"]*)"'
SCRIPT = '(?is)<script[^>]+type="application/ld.json"[^>]*>(.*?)</script>'
DEPTH, PAGES_PER_SITE = 2, 12


def _all(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all("html", F.lit(pattern), group)


def _number(c: Column) -> Column:
    return F.size(c).cast("long")


def heading_issue(levels: Column) -> Column:
    """none, no_h1, many_h1 or skip of a page's heading levels in order; a page without headings is none_found."""
    ones = F.size(F.filter(levels, lambda x: x == 1))
    steps = F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: b - a)
    return (
        F.when(F.size(levels) == 0, "none_found").when(ones == 0, "no_h1").when(ones > 1, "many_h1")
        .when(F.exists(steps, lambda s: F.coalesce(s, F.lit(0)) > 1), "skip").otherwise("none")
    )


def page_audit(spark: SparkSession, d: str) -> DataFrame:
    title, description = F.trim(F.regexp_extract("html", TITLE, 1)), F.trim(F.regexp_extract("html", DESCRIPTION, 1))
    ids, references = _all(ID, 1), F.flatten(F.transform(_all(REFERENCE, 1), lambda r: F.split(r, " ")))
    unnamed = F.filter(_all(ANCHOR), lambda a: (F.trim(F.regexp_replace(a, "(?s)<[^>]*>", " ")) == "") & ~a.rlike('(?i)(aria-label|title|alt)="[^"]'))
    fits = (title == "") | F.length(title).between(15, 70)
    return table(spark, d, "pages").select(
        "page_id", *[F.col("html").rlike(p).alias(n) for n, p in PATTERNS.items()],
        (fits & ((description == "") | F.length(description).between(50, 160))).alias("lengths_fit"),
        _number(F.filter(_all(IMAGE), lambda t: ~t.rlike("(?i) alt="))).alias("images_without_alt"),
        _number(F.filter(_all(BLANK), lambda t: ~t.rlike("(?i)noopener|noreferrer"))).alias("open_blanks"),
        _number(unnamed).alias("unnamed_links"),
        (_number(ids) - _number(F.array_distinct(ids))).alias("repeated_ids"),
        _number(F.array_except(F.filter(references, lambda r: r != ""), ids)).alias("lost_references"),
        heading_issue(F.transform(_all(HEADING, 1), lambda x: x.cast("int"))).alias("headings"),
        _number(F.filter(_all(SCRIPT, 1), lambda s: F.try_parse_json(s).isNull())).alias("broken_json_ld"),
    )


def security_headers(headers: Column, https: Column) -> Column:
    """Names of the missing or weak headers of a response, in a fixed order. Names are looked up in lower case."""
    low = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(e["value"]).alias("v"))))
    value = lambda n: F.coalesce(F.try_element_at(low, F.lit(n)), F.lit(""))
    csp, age = value("content-security-policy"), F.coalesce(F.regexp_extract(value("strict-transport-security"), r"max-age=(\d+)", 1).try_cast("long"), F.lit(0))
    weak = [
        ("content-security-policy", (csp == "") | csp.contains("unsafe-eval")), ("strict-transport-security", https & (age < 180 * 86400)),
        ("x-content-type-options", value("x-content-type-options") != "nosniff"),
        ("x-frame-options", ~value("x-frame-options").isin("deny", "sameorigin") & ~csp.contains("frame-ancestors")),
        ("referrer-policy", value("referrer-policy").isin("", "unsafe-url")),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in weak]), lambda n: n.isNotNull())


def robots_groups(text: Column) -> Column:
    """The groups of a robots file: arrays of (field, value) in lower case, each from its first agent to the next group's."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?m)#.*$", "")
    # A group begins at an agent line that doesn't follow another agent line.
    parts = F.split(F.concat(F.lit("\n"), clean), r"(?m)\n(?=[ \t]*user-agent[ \t]*:)")
    pairs = lambda part: F.transform(
        F.filter(F.split(part, "\r?\n"), lambda x: x.rlike("^[ \t]*[a-z-]+[ \t]*:")),
        lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("field"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")),
    )
    return F.transform(parts, pairs)


def robots_block_all(text: Column) -> Column:
    """Whether a robots file closes the whole site to all crawlers: a group for * disallows /."""
    groups = robots_groups(text)
    is_agent = lambda p: p["field"] == "user-agent"
    # Agents listed one below the other share the rules after the last of them.
    def closed(part, at):
        later = F.slice(groups, at + 1, F.size(groups))
        full = F.filter(later, lambda g: F.exists(g, lambda p: ~is_agent(p)))
        rules = F.coalesce(F.get(full, F.lit(0)), F.array().cast("array<struct<field:string,value:string>>"))
        named = F.exists(part, lambda p: is_agent(p) & (p["value"] == "*"))
        return named & F.exists(rules, lambda p: (p["field"] == "disallow") & (p["value"] == "/"))

    return F.exists(F.transform(groups, closed), lambda x: x)


#: A string literal, a name or number, or any other sign of a line of code.
TOKEN = r"""f?"(?:[^"\\\n]|\\.)*"|f?'(?:[^'\\\n]|\\.)*'|f?`[^`]*`|[A-Za-z_$][A-Za-z0-9_]*|[^ \t]"""
JOINS = ("+", ".", "%")


def splices(code: Column) -> Column:
    """Whether a string literal is put together with a value: joined to a name by an operator, or with a hole in it."""
    tokens = F.regexp_extract_all(code, F.lit(TOKEN), 0)

    def literal(t):
        return t.rlike("^f?[\"'`]")

    def hole(t):
        return literal(t) & (t.rlike(r"[$#]\{[^}]+\}") | (t.startswith("f") & t.rlike(r"\{[^}]+\}")))

    def spliced(found):
        joined = F.transform(
            found,
            lambda t, i: literal(t) & F.get(found, i + 1).isin(*JOINS) & F.coalesce(F.get(found, i + 2).rlike("^[A-Za-z_$]") & ~literal(F.get(found, i + 2)), F.lit(False)),
        )
        return F.exists(found, hole) | F.exists(joined, lambda x: F.coalesce(x, F.lit(False)))

    return F.get(F.transform(F.array(tokens), spliced), F.lit(0))


def dynamic_sql(lines: DataFrame, key: str, number: str, line: str, width: int = 4) -> DataFrame:
    """Lines from which a statement is put together within ``width`` lines: a call, an SQL word and a spliced value."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(0, width - 1)
    seen = lines.withColumn("_s", F.array_join(F.collect_list(line).over(w), " "))
    return seen.filter(F.col("_s").rlike(PATTERNS["sql_call"]) & F.col("_s").rlike(PATTERNS["sql_words"]) & splices(F.col("_s"))).drop("_s")


def reach(links: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """root, page and depth of the pages within ``depth`` links of each root, by their shortest way.

    links: src, dst; roots: page. One join and one aggregation a step; a page counts once a root however many ways there are.
    """
    found = front = roots.select(F.col("page").alias("root"), "page", F.lit(0).alias("depth"))
    for step in range(1, depth + 1):
        ahead = front.join(links.select(F.col("src").alias("page"), "dst"), "page").select("root", F.col("dst").alias("page")).distinct()
        front = ahead.join(found.select("root", "page"), ["root", "page"], "left_anti").withColumn("depth", F.lit(step))
        found = found.unionByName(front)
    return found


def nearest_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of each host the 12 pages with the shortest paths, at most two parts deep: the pages an audit of the site looks at."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1))
    depth = F.size(F.filter(F.split(F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*|[?#].*$", ""), "/"), lambda p: p != ""))
    seen = table(spark, d, "pages").select("page_id", host.alias("host"), depth.cast("long").alias("depth")).filter(F.col("depth") <= DEPTH)
    nearest = Window.partitionBy("host").orderBy("depth", "page_id")
    return seen.withColumn("place", F.row_number().over(nearest).cast("long")).filter(F.col("place") <= PAGES_PER_SITE)


def heading_summary(spark: SparkSession, d: str) -> DataFrame:
    return page_audit(spark, d).groupBy("headings").agg(F.count(F.lit(1)).alias("pages"), F.sum("unnamed_links").alias("unnamed"))


QUERIES = {"page_audit": page_audit, "site_nearest_pages": nearest_pages, "heading_summary": heading_summary}


def _sql_all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(html, '{pattern}', {group})"


_TITLE, _DESC = f"trim(regexp_extract(html, '{TITLE}', 1))", f"trim(regexp_extract(html, '{DESCRIPTION}', 1))"
_LEVELS = f"list_transform({_sql_all(HEADING, 1)}, lambda x: x::INTEGER)"
_IDS = _sql_all(ID, 1)
_AUDIT = f"""SELECT page_id, {', '.join(f"regexp_matches(html, '{p}') AS {n}" for n, p in PATTERNS.items())},
  ({_TITLE} = '' OR length({_TITLE}) BETWEEN 15 AND 70) AND ({_DESC} = '' OR length({_DESC}) BETWEEN 50 AND 160) AS lengths_fit,
  len(list_filter({_sql_all(IMAGE)}, lambda t: NOT regexp_matches(t, '(?i) alt='))) AS images_without_alt,
  len(list_filter({_sql_all(BLANK)}, lambda t: NOT regexp_matches(t, '(?i)noopener|noreferrer'))) AS open_blanks,
  len(list_filter({_sql_all(ANCHOR)}, lambda a: trim(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g')) = '' AND NOT regexp_matches(a, '(?i)(aria-label|title|alt)="[^"]'))) AS unnamed_links,
  len({_IDS}) - len(list_distinct({_IDS})) AS repeated_ids,
  len(list_filter(list_distinct(string_split(array_to_string({_sql_all(REFERENCE, 1)}, ' '), ' ')), lambda r: r <> '' AND NOT list_contains({_IDS}, r))) AS lost_references,
  CASE WHEN len({_LEVELS}) = 0 THEN 'none_found' WHEN len(list_filter({_LEVELS}, lambda x: x = 1)) = 0 THEN 'no_h1' WHEN len(list_filter({_LEVELS}, lambda x: x = 1)) > 1 THEN 'many_h1'
    WHEN len(list_filter(list_zip({_LEVELS}[:-2], {_LEVELS}[2:]), lambda p: p[2] > p[1] + 1)) > 0 THEN 'skip' ELSE 'none' END AS headings,
  len(list_filter({_sql_all(SCRIPT, 1)}, lambda s: NOT json_valid(s))) AS broken_json_ld FROM pages"""
ORACLE = {
    "page_audit": _AUDIT,
    "heading_summary": f"WITH a AS ({_AUDIT}) SELECT headings, count(*) AS pages, sum(unnamed_links)::BIGINT AS unnamed FROM a GROUP BY headings",
    "site_nearest_pages": f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
      len(list_filter(string_split(regexp_replace(url, '^[A-Za-z]+://[^/?#]*|[?#].*$', '', 'g'), '/'), lambda x: x <> '')) AS depth FROM pages)
      SELECT *, row_number() OVER (PARTITION BY host ORDER BY depth, page_id) AS place FROM p WHERE depth <= {DEPTH} QUALIFY place <= {PAGES_PER_SITE}""",
}
