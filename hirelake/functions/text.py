"""Scalar functions on texts, ids, urls and scores, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(text: Column) -> Column:
    """Dashes and hard spaces made plain, white space collapsed, trimmed, lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ёЁ–—−   ", "еЕ---   ")
    return F.lower(F.trim(F.regexp_replace(plain, r"[ \t\n\r\f\x0B]+", " ")))


def content_hash(title: Column, description: Column) -> Column:
    return F.sha2(F.concat(normalize_text(title), F.lit("\n"), normalize_text(description)), 256)


def hash31(text: Column) -> Column:
    """31-hash of code points in 32 bits, unsigned."""
    points = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(points, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(4294967295))


def site_job_id(text: Column) -> Column:
    """Absolute value of the hash read as a signed 32-bit number."""
    h = hash31(text)
    return F.when(h >= 2147483648, 4294967296 - h).otherwise(h)


def stable_job_id(text: Column) -> Column:
    h = hash31(text).bitwiseAND(2147483647)
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def slug(text: Column) -> Column:
    body = F.regexp_replace(F.lower(text), "[^a-zа-яё0-9]+", "-")
    body = F.regexp_replace(F.regexp_replace(body, "^-", ""), "-$", "")
    return F.concat(body, F.lit("-"), F.lower(F.conv(site_job_id(text).cast("string"), 10, 36)))


def initials(text: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), " +"), lambda w: w != "")
    joined = F.upper(F.array_join(F.transform(F.slice(parts, 1, 2), lambda w: F.substring(w, 1, 1)), ""))
    return F.when(joined == "", "IT").otherwise(joined)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, path without closing slashes, no query or fragment."""
    head = F.lower(F.regexp_extract(url, "^([A-Za-z]+://[^/?#]*)", 1))
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return F.concat(head, F.regexp_replace(path, "/+$", ""))


def token_set(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of three and more letters, digits, + # and dots, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zа-яё0-9+#.]{3,})"), 1))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "excellent").when(score >= 70, "strong").when(score >= 55, "fair").when(score >= 40, "weak")
        .otherwise("poor")
    )


def any_contains(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.lower(text).contains(n)
    return out


def first_match(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """Label of the first rule whose pattern occurs in the lower-cased text."""
    out = None
    for pattern, label in rules:
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)
