import pytest
from pyspark.sql import functions as F

from hirelake.plans import features as P
from hirelake.plans import match_score as S
from hirelake.plans.taxonomy import Concept, Taxonomy, java_backend

T = java_backend()
TEXT = "Java 17 и Spring Boot. Нужны Kafka, PostgreSQL, Docker и Kubernetes. Опыт от 3 лет, микросервисов много."


def jobs(spark, *rows):
    return spark.createDataFrame([("s", str(k), *r) for k, r in enumerate(rows)], "source_key string, external_id string, title string, description string")


def test_mentions():
    found = P.Mentions(T)
    names = [n for _, _, n in found.spans(TEXT.lower())]
    assert names.count("JAVA") == 1 and "JAVA_17" in names and "SPRING_BOOT" in names and "SPRING" not in names
    assert "MICROSERVICES" in names and found.min_years(TEXT.lower()) == 3
    assert found.min_years("не менее пяти лет опыт") == 5 and found.min_years("нам 7 лет") is None


def _toy(*aliases):
    from dataclasses import replace

    return P.Mentions(replace(T, concepts=tuple(replace(T.concepts[0], name=n, aliases=a) for n, a in aliases)))


@pytest.mark.parametrize(
    "text, names",
    [("aa bb cc dd ee ff gg", ["A", "C"]), ("aa bb cc", ["A"]), ("bb cc dd ee ff gg bb cc dd", ["B", "C", "B"]), ("aa bb x bb cc dd", ["A", "B"]), ("dd ee", ["S"]), ("bb cc dd ee", ["B", "E"])],
)
def test_longest_first(text, names):
    """Chains of overlaps: the longest match stays whatever begins before it; a shorter alias takes the place of one that goes."""
    found = _toy(("A", ("aa bb",)), ("B", ("bb cc dd", "bb cc")), ("C", ("dd ee ff gg",)), ("S", ("dd ee",)), ("E", ("ee",)))
    assert [n for _, _, n in found.spans(text)] == names


@pytest.mark.parametrize("text, value", [("kafka будет плюсом", 0.5), ("kafka не обязателен", 0.15), ("мигрируем с kafka", 0.05), ("kafka", 1.0), ("без kafka", 0.0)])
def test_context(text, value):
    at = text.index("kafka")
    assert P.Mentions(T).contexts(text, [(at, at + 5, "KAFKA")]) == [value]


def test_extract_and_index(spark):
    j = jobs(spark, ("Senior Java developer", TEXT), ("Android developer", "kafka and mysql"), (None, None), ("Backend engineer", "java"))
    f = P.extract(j, T)
    got = {r.external_id: r for r in f.collect()}
    assert got["0"].role.primary == "BACKEND" and got["0"].seniority.level == "SENIOR" and got["0"].years == 3
    assert got["1"].negatives[0].id == "ANDROID_PRIMARY" and got["2"].concepts == {} and got["3"].role.match == 1.0
    assert P.outdated(j, f, T.version).count() == 0 and P.outdated(j, f, "other").count() == 4
    changed = j.withColumn("description", F.when(F.col("external_id") == "1", "x").otherwise(F.col("description")))
    assert [r.external_id for r in P.outdated(changed, f, T.version).collect()] == ["1"]
    again = P.upsert(f, P.extract(changed.filter("external_id = '1'"), T))
    assert again.count() == 4 and again.filter("external_id = '1'").first().concepts == {}
    back = {r.external_id: r for r in P.inflate(P.compact(f), T.version).collect()}
    assert back["0"].concepts == got["0"].concepts and back["0"].role == got["0"].role
    assert P.inflate(P.compact(f), "other").count() == 0


def test_score(spark):
    c = S.Candidate("BACKEND", "SENIOR", 5, (("JAVA", "MUST_HAVE"), ("SPRING_BOOT", "MUST_HAVE"), ("RABBITMQ", "STRONG_PREFERENCE"), ("MYSQL", "BONUS")))
    j = jobs(spark, ("Senior Java developer", TEXT), ("Android developer", "java"), ("Backend engineer", "mysql"), ("x", ""), ("Backend engineer", "kafka"))
    got = {r.external_id: r for r in S.score(P.extract(j, T), c, T).collect()}
    a = got["0"]
    # Skills: language 1, framework 1, messaging 0.6, database 0.65 under weights 0.3, 0.24, 0.16, 0.18.
    skills = (0.3 + 0.24 + 0.16 * 0.6 + 0.18 * 0.65) / 0.88
    # Coverage: Java 5, Java 17 3, Spring Boot 5, Kafka 4 x 0.6, PostgreSQL 4 x 0.65, others (3, 3, 3) none.
    cover = (5 + 3 + 5 + 2.4 + 2.6) / 30
    assert a.score == pytest.approx(100 * (0.5 * skills + 0.3 * cover + 0.1 + 0.1), abs=0.01)
    assert a.matched == ["JAVA", "SPRING_BOOT"] and a.partial == ["RABBITMQ", "MYSQL"] and a.eligibility == "ELIGIBLE" and a.hard_match == 100
    assert got["1"].score <= 20 and got["1"].eligibility == "INELIGIBLE" and "WRONG_PRIMARY_ROLE" in got["1"].gates
    assert got["2"].score <= 25 and got["2"].eligibility == "INELIGIBLE" and got["2"].missing == ["JAVA", "SPRING_BOOT", "RABBITMQ"]
    assert got["3"].eligibility == "UNCERTAIN" and got["3"].coverage is None
    order = [r.external_id for r in S.ranked(S.score(P.extract(j, T), c, T)).collect()]
    assert order[0] == "0" and order[-1] == "3"
    with pytest.raises(ValueError):
        S.score(P.extract(j, T), S.Candidate("BACKEND", "SENIOR", 5, (("COBOL", "MUST_HAVE"),)), T)
    with pytest.raises(ValueError):
        S.score(P.extract(j, T), S.Candidate("BACKEND", "SENIOR", 5, (("JAVA", "PERHAPS"),)), T)


def test_candidate_without_needs(spark):
    j = jobs(spark, ("Backend engineer", "java"))
    r = S.score(P.extract(j, T), S.Candidate("BACKEND", "?", None, ()), T).first()
    assert r.score == 0 and r.eligibility == "UNCERTAIN" and r.hard_match is None


def test_taxonomy_check():
    with pytest.raises(ValueError):
        Taxonomy("1", (Concept("A", "x", 1, ("a",)),), {"x": 0.5}, bands=((0.0, "NO"),)).check()
