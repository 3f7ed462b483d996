"""References in pages as absolute urls, and the links and resources of a page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that load something by src, and relations of link elements that do.
LOADING = ("img", "script", "iframe", "source", "audio", "video", "track", "embed")
RELATIONS = ("stylesheet", "icon", "manifest", "preload", "modulepreload", "apple-touch-icon")
_HTTP = "(?i)^https?://[^/?#]"
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without_dots(path: Column) -> Column:
    """An absolute path with its . and .. segments applied; .. at the top stays at the top."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, none,
        lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))),
    )
    open_end = F.when(path.rlike("(^|/)[.][.]?$"), F.array(F.lit(""))).otherwise(none)
    return F.when(path.rlike("(^|/)[.][.]?(/|$)"), F.concat(F.lit("/"), F.array_join(F.concat(kept, open_end), "/"))).otherwise(path)


def _normal(url: Column) -> Column:
    """Lower-case scheme and host, no default port or fragment, at least / as path, no dot segments."""
    origin = F.regexp_replace(F.lower(F.regexp_extract(url, "(?i)^https?://[^/?#]+", 0)), "^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    path = F.regexp_extract(url, "(?i)^https?://[^/?#]+([^?#]*)", 1)
    return F.concat(origin, F.when(path == "", "/").otherwise(_without_dots(path)), F.regexp_extract(url, "^[^?#]*([?][^#]*)", 1))


def absolute(base: Column, reference: Column) -> Column:
    """A reference in a page as absolute http(s) url without its fragment; null for other schemes, a null reference, and a
    base that isn't an http(s) url. Percent escapes stay as they are."""
    origin, path = F.regexp_extract(base, "(?i)^https?://[^/?#]+", 0), F.regexp_extract(base, "(?i)^https?://[^/?#]+([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    plain = F.replace(F.regexp_replace(F.regexp_replace(reference, "[\\t\\r\\n]", ""), "^ +| +$", ""), F.lit("&amp;"), F.lit("&"))

    def joined(r: Column) -> Column:
        return (
            F.when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r).when(r.startswith("//"), F.concat(F.regexp_extract(base, "^[A-Za-z]+:", 0), r))
            .when(r == "", F.regexp_replace(base, "#.*$", "")).when(r.startswith("?"), F.concat(origin, path, r))
            .when(r.startswith("/"), F.concat(origin, r)).otherwise(F.concat(origin, folder, r))
        )

    full = joined(F.regexp_replace(plain, "#.*$", ""))
    return F.when(base.rlike(_HTTP), _let(full, lambda u: F.when(u.rlike(_HTTP), _normal(u))))


def origin(url: Column) -> Column:
    """Scheme, host and port of an absolute url."""
    return F.regexp_extract(url, "^[a-z]+://[^/?#]+", 0)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, null where there is none."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}{_VALUE}", 1)
    return F.when(found != "", F.regexp_replace(found, "^[\"']|[\"']$", ""))


def links(html: Column, base: Column) -> Column:
    """Distinct absolute urls of the page's anchors in their order, wherever href stands in the tag and however it is quoted."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\s[^>]*>"), 0)
    urls = F.transform(tags, lambda t: absolute(base, _attribute(t, "href")))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull()))


def internal_links(html: Column, base: Column) -> Column:
    """The links that stay on the page's scheme, host and port."""
    return _let(_let(base, lambda b: origin(absolute(b, F.lit("")))), lambda own: F.filter(links(html, base), lambda u: origin(u) == own))


def resources(html: Column, base: Column) -> Column:
    """Distinct (url, label) that a page loads: src, srcset and poster of LOADING elements, href of link elements with one of
    RELATIONS. The label names the element; of several for one url, the first."""
    pair = "array<struct<reference:string,label:string>>"
    tags = lambda names: F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf"(?is)<(?:{'|'.join(names)})\b[^>]*>"), 0)

    def loaded(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, "^<([A-Za-z]+)", 1))
        one = lambda attribute, label: F.struct(_attribute(tag, attribute).alias("reference"), label.alias("label"))
        several = F.transform(
            F.split(F.coalesce(_attribute(tag, "srcset"), F.lit("")), ","),
            lambda s: F.struct(F.nullif(F.regexp_extract(s, r"\S+", 0), F.lit("")).alias("reference"), F.concat(name, F.lit(" srcset")).alias("label")),
        )
        poster = F.struct(F.when(name == "video", _attribute(tag, "poster")).alias("reference"), F.lit("video poster").alias("label"))
        return F.concat(F.array(one("src", name), poster).cast(pair), several.cast(pair))

    def related(tag: Column) -> Column:
        rel = F.lower(F.coalesce(_attribute(tag, "rel"), F.lit("")))
        fits = F.arrays_overlap(F.split(rel, r"\s+"), F.array(*map(F.lit, RELATIONS)))
        return F.struct(F.when(fits, _attribute(tag, "href")).alias("reference"), F.concat(F.lit("link rel="), rel).alias("label"))

    all_ = F.concat(F.flatten(F.transform(tags(LOADING), loaded)), F.transform(tags(("link",)), related).cast(pair))
    found = F.transform(F.filter(all_, lambda x: x["reference"].isNotNull()), lambda x: F.struct(absolute(base, x["reference"]).alias("url"), x["label"].alias("label")))

    def firsts(f: Column) -> Column:
        urls = F.transform(f, lambda x: x["url"])
        return F.filter(f, lambda x, i: x["url"].isNotNull() & (F.array_position(urls, x["url"]) == i + 1))

    return _let(found, firsts)
