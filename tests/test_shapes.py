import json

import pytest

from hirelake.sources import shapes as S


def landed(spark, *bodies):
    return spark.createDataFrame([("s", k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "source_key string, page int, body string")


def rows(df):
    return {r.external_id: r for r in df.collect()}


def test_json_shapes(spark):
    g = rows(S.adapter("greenhouse")(landed(spark, {"jobs": [{"id": 7, "title": "Dev", "location": {"name": "Remote"}, "content": "&lt;p&gt;Build &amp;amp; ship&lt;/p&gt;", "absolute_url": "u", "departments": [{"name": "A"}, {"name": "B"}]}]}, "broken")))
    assert g["7"].team == "A, B" and g["7"].location == "Remote" and g["7"].description.startswith("Build &") and g["7"].posted_at == ""
    v = rows(S.adapter("lever")(landed(spark, [{"id": "x", "text": "Dev", "categories": {}, "descriptionPlain": None, "lists": [{"text": "Details", "content": "<li>Python</li>"}], "createdAt": 0}])))
    assert v["x"].location == "" and v["x"].description == "Details • Python" and v["x"].posted_at == "1970-01-01T00:00:00Z"
    b = rows(S.adapter("board")(landed(spark, {"items": [{"id": "1", "name": "old"}]}, {"items": [{"id": "1", "name": "new", "professional_roles": [{"name": "QA"}], "snippet": {"requirement": "<b>SQL</b>"}}]})))
    assert len(b) == 1 and b["1"].title == "new" and b["1"].team == "QA" and b["1"].description == "SQL"


def test_html_shapes(spark):
    page = '<a href="/jobs/42">Backend <b>Engineer</b></a><a href="/jobs/42">again</a><a href="/jobs/43">x</a><a href="/about">About us</a>'
    got = rows(S.adapter("html_links")(landed(spark, page)))
    assert set(got) == {"42"}
    state = '<script id="__NEXT_DATA__" type="x">{"vacancies": [{"id": 5, "title": "QA", "text": "<p>a</p><p>b</p>"}]}</script>'
    assert rows(S.adapter("embedded_state")(landed(spark, state, "<p>none</p>")))["5"].description == "a\nb"
    with pytest.raises(ValueError):
        S.adapter("fax")


def test_joins_and_guards(spark):
    listed = spark.createDataFrame([("s", "1", "short", "a"), ("s", "2", "kept", "z")], "source_key string, external_id string, description string, city string")
    details = spark.createDataFrame([("s", "1", "long", "x"), ("s", "2", "", "y")], "source_key string, external_id string, description string, skills string")
    got = rows(S.with_details(listed, details))
    assert got["1"].description == "long" and got["2"].description == "kept" and got["2"].skills == "y"
    options = spark.createDataFrame([("a", "Amsterdam")], "city string, name string")
    assert {k: r.place for k, r in rows(S.looked_up(listed, options, "city", "name", "place")).items()} == {"1": "Amsterdam", "2": ""}
    expected = spark.createDataFrame([("s", 2, None), ("t", None, 1), ("u", None, None)], "source_key string, declared int, least int")
    assert [r.source_key for r in S.shortfall(listed, expected).collect()] == ["t"]
