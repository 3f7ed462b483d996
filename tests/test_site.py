"""References against the standard library, links and resources of a page, crawls against a plain walk."""

import random
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import functions as F

from hirelake.functions import urls as U
from hirelake.plans import site as S

BASES = ["http://A.org", "https://a.org/", "http://a.org/b/c/d?q=1#x", "https://a.org:8443/b/", "http://a.org/b/../c/./d.html"]
REFERENCES = ["", "#top", "?y=2", "x", "./x", "../x", "../../../../x/", "/x/./y/../z", "//c.org/z", "..", ".", "x/..", "/..", "http://B.org", "HTTPS://b.org/q/../r?s#t", "x?y=/../z", "a:b/c", "mailto:a@b.c", "javascript:void(0)", "a/b;c=1/../d"]


def plain(base, reference):
    found, _ = urldefrag(urljoin(base, reference))
    parts = urlsplit(found)
    if parts.scheme not in ("http", "https"):
        return None
    # A base that is taken as it is still has its own dot segments.
    path = urlsplit(urljoin(f"http://x{parts.path or '/'}", parts.path or "/")).path
    return f"{parts.scheme}://{parts.netloc.lower()}{path}" + (f"?{parts.query}" if parts.query else "")


def test_references(spark):
    cases = [(b, r, plain(b, r)) for b in BASES for r in REFERENCES]
    got = spark.createDataFrame(cases, "b string, r string, want string").select("b", "r", "want", U.absolute(F.col("b"), F.col("r")).alias("got")).collect()
    assert [tuple(x) for x in got if x.got != x.want] == []
    odd = [("ftp://a/b", "x", None), (None, "x", None), ("http://a/b", None, None), ("http://a:80/b", "", "http://a/b"), ("https://a/b", " /c\n?x=1&amp;y=2 ", "https://a/c?x=1&y=2")]
    got = spark.createDataFrame(odd, "b string, r string, want string").select("want", U.absolute(F.col("b"), F.col("r")).alias("got")).collect()
    assert [x.got for x in got] == [x.want for x in got]


def test_links_and_resources(spark):
    html = """<A class=x HREF='two'>2</A><a href="/one#a">1</a><a href=/one>again</a><abbr href="/no"></abbr><a data-href="/no">n</a><a href="http://h.org:81/p">port</a>
      <a href="mailto:x@y.z">m</a><img src=a.png srcset="a.png 1x, b.png 2x"><video poster='p.jpg' src="v.mp4"></video><link rel="Shortcut ICON" href=i.ico><link rel=canonical href=/c><script>x</script>"""
    row = spark.createDataFrame([(html, "http://h.org/d/e")], "html string, url string")
    r = row.select(U.links(F.col("html"), F.col("url")).alias("l"), U.internal_links(F.col("html"), F.col("url")).alias("i"), U.resources(F.col("html"), F.col("url")).alias("r")).first()
    assert r.l == ["http://h.org/d/two", "http://h.org/one", "http://h.org:81/p"]
    assert r.i == ["http://h.org/d/two", "http://h.org/one"]
    assert sorted((x.url.rpartition("/")[2], x.label) for x in r.r) == [
        ("a.png", "img"), ("b.png", "img srcset"), ("i.ico", "link rel=shortcut icon"), ("p.jpg", "video poster"), ("v.mp4", "video"),
    ]
    none = spark.createDataFrame([(None, "http://h.org"), ("<a href=x>", None)], "html string, url string")
    assert [tuple(x) for x in none.select(U.internal_links(F.col("html"), F.col("url")), U.resources(F.col("html"), F.col("url"))).collect()][0] == ([], [])


def walk(graph, root, depth, most):
    found, front = {root: (0, 1)}, [root]
    for step in range(1, depth + 1):
        ahead = []
        for page in front:
            for dst in graph.get(page, []):
                if dst not in found and len(found) < most:
                    found[dst] = (step, len(found) + 1)
                    ahead.append(dst)
        front = ahead
    return found


def test_crawl(spark):
    rnd = random.Random(2)
    names = [f"http://s.org/{i}" for i in range(40)]
    # One page links to all, some to many, some to none; five linked pages aren't landed.
    graph = {u: (names if i == 3 else rnd.choices(names, k=rnd.choice([0, 2, 5, 30]))) for i, u in enumerate(names[:35])}
    pages = spark.createDataFrame([(u, " ".join(f'<a href="{x[12:]}">l</a>' for x in to)) for u, to in graph.items()], "url string, html string")
    for depth, most in ((2, 12), (2, 4), (4, 30)):
        got = S.crawl(pages, pages.union(pages).select("url"), depth, most).collect()
        assert len(got) == len({(r.root, r.url) for r in got})
        for root in graph:
            assert {r.url: (r.depth, r.place) for r in got if r.root == root} == walk(graph, root, depth, most)
        assert all(r.landed == (r.url in graph) for r in got)
    assert S.crawl(pages.limit(0), pages.select("url").limit(0)).collect() == []
