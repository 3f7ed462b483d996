"""Features and scores against their SQL on texts that the test tables don't hold."""

import duckdb
import pytest
from test_catalogue import rows

from hirelake.catalogue_queries import ORACLE, QUERIES

TEXTS = [
    None, "", " ", "the", "The\nof the on, the.", "of the on the on of the", "for the x. not the with from", "no the", "no thing or other then the",
    "And\nwe want 5+ years experience with the, that and ing", "x\n3 years developer. 12345 years developer. " + "y " * 60 + "7 years of rest",
    "from\nне менее пяти лет опыт with", "thanks\nthe with", "a\nthanks in the. with", "a\nthanks, работают many. the", "stupid in\nder mit und ung",
    "is zu\nof and ing ing ing ing ing", "of and in\nthat that tion that von für", "the-with/that_the #the the# c++ the+", "für " + "w " * 70 + "the\nthe " * 3,
    "le la der the le la not le", "not. the; for! with? no the — the", "experience 4years and 4 + years", "опыт от двух лет\nот 6 лет опыт der",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    made = [(k, t, ("en", "de", None)[k % 3], ("src1", "src2", None)[k % 3]) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["vacancy_mentions", "vacancy_features", "vacancy_scores"])
def test_odd_texts(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    got = QUERIES[name](spark, odd).toPandas()
    assert rows(got) == rows(con.execute(ORACLE[name]).df())
    assert len(got) == len(TEXTS) or name == "vacancy_mentions"


def test_years_are_met(spark, odd):
    assert {r.external_id: r.years for r in QUERIES["vacancy_features"](spark, odd).filter("years is not null").collect()} == {"9": 5, "10": 3, "11": 5, "22": 4, "23": 6}


def test_table_function_in_sql(spark):
    from hirelake.plans.features import mention_table
    from hirelake.plans.taxonomy import java_backend

    spark.udtf.register("mentions_of", mention_table(java_backend()))
    got = spark.sql("SELECT k, m.* FROM VALUES (1, 'kafka не обязателен'), (2, ''), (3, CAST(NULL AS STRING)) t(k, x), LATERAL mentions_of(x) m").collect()
    assert [tuple(r) for r in got] == [(1, "KAFKA", 0, 5, 0.15)]
