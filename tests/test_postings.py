import json

import pytest
from pyspark.sql import functions as F

from hirelake.functions import postings as P


@pytest.fixture
def one(spark):
    def read(column, *pages):
        return [r.x for r in spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, html string").orderBy("k").select(column.alias("x")).collect()]

    return read


def test_element_body(one):
    nested = '<p>0</p><DIV class="a x">1<div>2</div>3</DIV>4<div class="x">5</div>'
    assert one(P.element_body(F.col("html"), '<div[^>]+class="[^"]*x"[^>]*>'), nested, '<div class="x">open <div>in</div>', "none", None) == ["1<div>2</div>3", "", "", ""]
    assert one(P.text_at(F.col("html"), "<h1[^>]*>(.*?)</h1>"), "<H1 id=a>Data <b>Engineer</b></H1>", "") == ["Data Engineer", ""]


def ld(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def test_postings(one):
    job = {"@type": "JobPosting", "title": "QA", "jobLocation": {"address": {"addressLocality": "Omsk"}}}
    pages = [ld("{broken") + ld(job), ld([{"@type": "Thing"}, job]), ld({"@graph": [{"@type": "WebPage"}, job]}), ld({"@type": "Thing"}), None]
    assert one(P.posting_field(P.posting(F.col("html")), "title"), *pages) == ["QA", "QA", "QA", "", ""]
    many = {"@type": "JobPosting", "jobLocationType": "TELECOMMUTE", "jobLocation": [
        {"address": {"addressLocality": "Omsk", "addressRegion": "R"}}, {"address": {"addressLocality": "", "addressRegion": "Ural"}},
        {"address": {"streetAddress": "Main 1"}}, {"address": "Tomsk, centre"}, {"address": {"addressLocality": "Omsk"}}, {}]}
    got = one(P.posting_place(P.posting(F.col("html"))), ld(job), ld(many), ld({"@type": "JobPosting"}), "")
    assert got == ["Omsk", "Omsk, Ural, Main 1, Tomsk, centre, Удалённо", "", ""]


def test_descriptions(one):
    long = "word " * 40
    pages = [
        f"<nav>menu {long}</nav><main>Data Engineer<p>about data engineer</p> {long}</main>", f"<article>short</article><p>{long}</p>",
        "<main>short</main>", f"<article>{long}</article><main>main {long}</main>", None,
    ]
    got = one(P.description(F.col("html"), F.lit("Data Engineer")), *pages)
    assert got == [long.strip(), "short\n" + long.strip(), "", long.strip(), ""]


def test_sections(one):
    page = '<h2 class="s_head">Tasks</h2><div class="s_body"><div>write</div>test</div><h2 class="s_head">Empty</h2><div class="s_body"></div><h2 class="other">No</h2>'
    assert one(P.sections(F.col("html"), "s_head", "s_body"), page, "", None) == ["Tasks\nwrite\ntest", "", ""]


def test_small_fields(one):
    assert one(P.listed(F.col("html"), 2), " a, ,b,c", None) == [["a", "b"], []]
    assert one(P.stated_years(F.col("html"), F.lit(None).cast("double")), "about 3,5 years", "none") == [3.5, None]
    assert one(P.availability(F.col("html"), F.col("html").isNull()), "2024-01-01", "", None) == ["closed", None, "stale"]
