"""Vacancy pages as columns: element bodies, JSON-LD postings and their place, generic descriptions, titled sections.

All of it is built from Spark's own functions, so a page is read in one projection. Null pages and pages without the mark
looked for give empty texts (postings: null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .resume import fragment_text

#: Elements that are no part of a description, its least length, and the word for remote work.
ASIDE = "script|style|noscript|header|nav|footer|aside|form"
LEAST = 120
REMOTE = "Удалённо"
LD_JSON = """(?is)<script[^>]+type=["']application/ld[+]json["'][^>]*>(.*?)</script>"""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def element_body(html: Column, opening: str, tag: str = "div") -> Column:
    """What is inside the first element whose opening tag fits the pattern, up to its own closing tag.

    The text is cut before each tag of that name; a fold over the pieces keeps the depth and how many lie inside. Elements
    that are never closed are empty texts.
    """
    rest = F.regexp_extract(F.coalesce(html, F.lit("")), f"(?is){opening}(.*)", 1)

    def inside(pieces: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

        def step(at: Column, piece: Column) -> Column:
            lower = F.lower(piece)
            move = F.when(lower.rlike(f"^</{tag}\\b"), -1).when(lower.rlike(f"^<{tag}\\b"), 1).otherwise(0)
            depth = at["depth"] + move
            return F.when(at["depth"] == 0, at).otherwise(F.struct(depth.alias("depth"), F.when(depth == 0, at["n"]).otherwise(at["n"] + 1).alias("n")))

        end = F.aggregate(pieces, start, step)
        return let(end, lambda e: F.when(e["depth"] == 0, F.array_join(F.slice(pieces, F.lit(1), e["n"]), "")).otherwise(""))

    return let(F.split(rest, f"(?i)(?=</?{tag}\\b)"), inside)


def text_at(html: Column, pattern: str) -> Column:
    """First group of the pattern's first match, as text."""
    return fragment_text(F.regexp_extract(F.coalesce(html, F.lit("")), f"(?is){pattern}", 1))


def _elements(json: Column) -> Column:
    """JSON texts of an array's elements; any other value is its own one element, null none."""
    return F.when(json.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(json, "array<string>"), F.array(json)))


def posting(html: Column) -> Column:
    """JSON text of the page's first JobPosting: on its own, in an array, or in a graph; null without one."""
    texts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LD_JSON), 1)
    plain = F.transform(texts, lambda t: stripped(F.replace(F.replace(t, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))))

    def with_graph(one: Column) -> Column:
        graph = F.from_json(one, "struct<`@graph`:array<string>>")["@graph"]
        return F.concat(_elements(one), F.coalesce(graph, F.array().cast("array<string>")))

    found = F.flatten(F.transform(plain, with_graph))
    return F.get(F.filter(found, lambda e: F.get_json_object(e, "$['@type']") == "JobPosting"), F.lit(0))


def posting_field(json: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(""))


def posting_place(json: Column) -> Column:
    """Towns of a posting (failing that its region, its street, or an address in words), each once, and remote work."""

    def place(one: Column) -> Column:
        parts = [F.nullif(F.get_json_object(one, f"$.address.{f}"), F.lit("")) for f in ("addressLocality", "addressRegion", "streetAddress")]
        address = F.get_json_object(one, "$.address")
        return F.coalesce(*parts, F.when(~address.rlike(r"^\s*[{\[]"), address))

    towns = F.transform(_elements(F.get_json_object(json, "$.jobLocation")), place)
    remote = F.array(F.when(F.get_json_object(json, "$.jobLocationType") == "TELECOMMUTE", REMOTE))
    return F.coalesce(F.array_join(F.array_distinct(F.filter(F.concat(towns, remote), lambda x: x.isNotNull() & (x != ""))), ", "), F.lit(""))


def description(html: Column, title: Column) -> Column:
    """Text of the article, else of the main part, else of the page, after the title's last mention; the first of them with
    120 characters. Page furniture is left out."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), f"(?is)<({ASIDE})\\b[^>]*>.*?</\\1>", "")

    def after_title(text: Column) -> Column:
        back = F.instr(F.reverse(F.lower(text)), F.reverse(F.lower(title)))
        return stripped(F.when((F.coalesce(title, F.lit("")) != "") & (back > 0), F.right(text, back - 1)).otherwise(text))

    def longest(page: Column) -> Column:
        parts = F.array(element_body(page, "<article[^>]*>", "article"), element_body(page, "<main[^>]*>", "main"), page)
        texts = F.transform(F.transform(parts, fragment_text), after_title)
        return F.coalesce(F.get(F.filter(texts, lambda t: F.length(t) >= LEAST), F.lit(0)), F.lit(""))

    return let(body, longest)


def sections(html: Column, heading: str, body: str) -> Column:
    """Titled sections as text: each h2 whose class has ``heading``, with the next div whose class has ``body``; sections
    without text are left out."""
    mark = f'<h2[^>]+class="[^"]*{heading}[^"]*"[^>]*>'

    def read(pieces: Column) -> Column:
        def one(piece: Column, at: Column) -> Column:
            tail = F.array_join(F.slice(pieces, at + 1, F.size(pieces)), "")
            text = fragment_text(element_body(tail, f'<div[^>]+class="[^"]*{body}[^"]*"[^>]*>'))
            return F.when(piece.rlike(f"(?is)^{mark}") & (text != ""), F.concat_ws("\n", text_at(piece, f"{mark}(.*?)</h2>"), text))

        return F.array_join(F.filter(F.transform(pieces, one), lambda x: x.isNotNull()), "\n")

    return let(F.split(F.coalesce(html, F.lit("")), f"(?is)(?={mark})"), read)


def listed(text: Column, most: int = 30) -> Column:
    """Parts of a comma list, trimmed, without empty ones, the first ``most``."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def stated_years(text: Column, known: Column) -> Column:
    """Years of experience as known, else the first number of the text, with a comma or a point."""
    return F.coalesce(known, F.translate(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)", 1), ",", ".").try_cast("double"))


def availability(closed_at: Column, stale: Column) -> Column:
    """closed, stale or null."""
    return F.when(F.coalesce(closed_at.cast("string"), F.lit("")) != "", "closed").when(stale, "stale")
