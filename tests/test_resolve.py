"""Pages resolved to vacancies against all pairs, and their parts."""

import random

from hirelake.plans import resolve as R

STRUCT = "{} long, url string, title string, company string"


def words(title):
    import re

    return set(re.findall(r"[a-zа-яё0-9+#.]{3,}", (title or "").lower())) - set(R.STOP)


def plain(pages, vacancies):
    """All pairs, a loop over vacancies in their order."""

    def canon(u):
        head, sep, rest = (u or "").partition("://")
        host, _, path = rest.split("?")[0].split("#")[0].partition("/")
        return (head.lower() + sep + host.lower() + ("/" + path if path else "")).rstrip("/") if sep else "", host.lower()

    out = {}
    for pid, url, title, company in pages:
        best, (u, host) = (0.0, None), canon(url)
        a = words(title)
        for vid, vurl, vtitle, vcompany in sorted(vacancies):
            vu, vhost = canon(vurl)
            if u and u == vu:
                best = (None, vid)
                break
            b = words(vtitle)
            has = bool(company) and company.lower() in (vcompany or "").lower()
            score = len(a & b) / max(1, len(a | b)) * 0.75 + float(has) * 0.2 + (0.25 if u and vu and host == vhost else 0.0) * 0.05
            best = (score, vid) if score > best[0] else best
        found = best[0] is None or best[0] >= 0.62
        out[pid] = (best[1] if found else None, "url" if best[0] is None else "title" if found else "", None if best[0] is None or not found else round(best[0], 9))
    return out


def test_against_all_pairs(spark):
    rnd = random.Random(5)
    # Few words, so that some are in nearly all titles.
    pool = ["java", "senior", "developer", "the", "c++", "data", "lead", "аналитик", "go", "qa1", "node.js", "for"]
    named = ["Acme", "Acme Labs", "AC", "Крок", "", None, "labs"]

    def row(i, path):
        title = rnd.choice([None, "", " ".join(rnd.choices(pool, k=rnd.randint(1, 7))), " ".join(rnd.choices(pool, k=rnd.randint(3, 6)))])
        url = rnd.choice([None, "", f"https://H{rnd.randint(1, 3)}.org/{path}/{rnd.randint(1, 90)}/?q=1", f"http://h{rnd.randint(1, 3)}.org/{path}/{i}#x"])
        return i, url, title, rnd.choice(named)

    pages = [row(i, rnd.choice(["jobs", "seen"])) for i in range(150)]
    vacancies = [row(i, "jobs") for i in range(1, 180)] + [(500, "x", "java senior developer data lead", "Acme")] * 3
    want = plain(pages, vacancies)
    p, v = spark.createDataFrame(pages, STRUCT.format("page_id")), spark.createDataFrame(vacancies, STRUCT.format("vacancy_id"))
    for cell in (R.CELL, 5):  # 5: words dealt over many cells
        got = {r.page_id: (r.vacancy_id, r.how, None if r.score is None else round(r.score, 9)) for r in R.resolve(p, v, cell).collect()}
        assert got == want
    assert {how for _, how, _ in want.values()} == {"url", "title", ""}


def test_pairs_come_once(spark):
    a = spark.createDataFrame([("aa bb cc dd",), ("aa bb",), ("",)], "said string")
    b = spark.createDataFrame([("aa bb cc",), ("aa bb cc dd ee",), ("zz",), ("aa bb",), ("aa bb",)], "said string")
    for cell in (4000, 1):
        got = sorted((r.a, r.b, round(r.share, 6)) for r in R.title_pairs(a, b, cell).collect())
        assert got == [("aa bb", "aa bb", 1.0), ("aa bb", "aa bb cc", 0.666667), ("aa bb cc dd", "aa bb cc", 0.75), ("aa bb cc dd", "aa bb cc dd ee", 0.8)]


def test_containing(spark):
    needles, names = ["a", "bc", "acme", "zzz", "acme labs gmbh"], ["acme", "acme labs", "bcd", "x", ""]
    got = R.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted(map(tuple, got)) == sorted((n, m) for n in needles for m in names if n in m)


def test_empty(spark):
    p, v = spark.createDataFrame([], STRUCT.format("page_id")), spark.createDataFrame([], STRUCT.format("vacancy_id"))
    assert R.resolve(p, v).collect() == []
    one = spark.createDataFrame([(1, "https://a.b/c", "java developer", None)], STRUCT.format("page_id"))
    assert [tuple(r) for r in R.resolve(one, v).collect()] == [(1, None, "", None)]


def test_pairs_are_not_written(spark, monkeypatch):
    """Titles that are all alike: what is written between steps grows with the titles, not with their pairs."""
    written = []

    def counting(df, settled=R.settled):
        out = settled(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(R, "settled", counting)
    row = lambda i, site, company: (i, f"https://{site}.org/{i}", f"senior java developer data lead x{i}", company)
    p = spark.createDataFrame([row(i, "seen", "acme") for i in range(60)], STRUCT.format("page_id"))
    v = spark.createDataFrame([row(i, "jobs", "acme") for i in range(100, 160)], STRUCT.format("vacancy_id"))
    got = R.resolve(p, v).collect()
    assert {(r.vacancy_id, r.how) for r in got} == {(100, "title")} and len(got) == 60
    assert max(written) <= 130
