"""Pages that users saw, resolved to vacancies of the catalogue.

Every document is a vacancy (its first eight words are the title, its source the company) and, as copied to some other place,
a page that was seen: the page's title has five to eight of the words and its company four letters of the source. Pages of
English documents have the vacancy's own url in another form; the others share at most its host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import resolve as R
from ..sources.tables import table


def page_vacancies(spark: SparkSession, d: str) -> DataFrame:
    """The vacancy of each page seen, by url or else by title, company and host; scores to six places."""
    c = F.col
    words = F.split(F.coalesce("text", F.lit("")), " ")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", words.alias("w"))
    title = lambda n: F.array_join(F.slice("w", F.lit(1), n), " ")
    own = F.concat(F.lit("https://"), F.coalesce("source", F.lit("")), F.lit(".example.com/jobs/"), c("doc_id").cast("string"))
    seen = F.concat(
        F.when(c("doc_id") % 3 == 0, "https://board.example.net").otherwise(F.concat(F.lit("https://"), F.coalesce("source", F.lit("")), F.lit(".example.com"))),
        F.lit("/seen/"), c("doc_id").cast("string"),
    )
    url = F.when(c("lang") == "en", F.concat(F.lit("HTTPS"), F.substring(own, 6, 1000), F.lit("/?ref=mail#top"))).otherwise(seen)
    pages = docs.select(c("doc_id").alias("page_id"), url.alias("url"), title((5 + c("doc_id") % 4).cast("int")).alias("title"), F.substring("source", 1, 4).alias("company"))
    vacancies = docs.select(c("doc_id").alias("vacancy_id"), own.alias("url"), title(F.lit(8)).alias("title"), c("source").alias("company"))
    return R.resolve(pages, vacancies).withColumn("score", F.round("score", 6))


QUERIES = {"page_vacancies": page_vacancies}
_WORDS = f"""list_filter(list_distinct(regexp_extract_all(lower({{}}), '([a-zа-яё0-9+#.]{{{{3,}}}})', 1)), lambda w: w NOT IN {R.STOP})"""
_TITLE = "array_to_string(string_split(coalesce(text, ''), ' ')[1:{}], ' ')"
_OWN = "'https://' || lower(coalesce(source, '')) || '.example.com'"
ORACLE = {
    "page_vacancies": f"""WITH p AS (SELECT doc_id AS page_id, {_WORDS.format(_TITLE.format('5 + doc_id % 4'))} AS pw, lower(substr(coalesce(source, ''), 1, 4)) AS pc,
        CASE WHEN lang = 'en' OR doc_id % 3 <> 0 THEN {_OWN} ELSE 'https://board.example.net' END AS ph, CASE WHEN lang = 'en' THEN '/jobs/' ELSE '/seen/' END || doc_id AS pp FROM documents),
      v AS (SELECT doc_id AS vacancy_id, {_WORDS.format(_TITLE.format('8'))} AS vw, lower(coalesce(source, '')) AS vc, {_OWN} AS vh, '/jobs/' || doc_id AS vp FROM documents),
      x AS (SELECT page_id, vacancy_id, ph || pp = vh || vp AS same,
        (len(list_intersect(pw, vw)) / greatest(1, len(list_distinct(list_concat(pw, vw))))) * {R.TITLE}::DOUBLE
          + (CASE WHEN pc <> '' AND contains(vc, pc) THEN 1 ELSE 0 END)::DOUBLE * {R.COMPANY}::DOUBLE + (CASE WHEN ph = vh THEN {R.SAME_HOST} ELSE 0 END)::DOUBLE * {R.HOST}::DOUBLE AS score FROM p, v),
      b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY same DESC, CASE WHEN same THEN 0 ELSE score END DESC, vacancy_id) = 1)
      SELECT page_id, CASE WHEN same OR score >= {R.LEAST}::DOUBLE THEN vacancy_id END AS vacancy_id, CASE WHEN same THEN 'url' WHEN score >= {R.LEAST}::DOUBLE THEN 'title' ELSE '' END AS how,
        CASE WHEN NOT same AND score >= {R.LEAST}::DOUBLE THEN round(score, 6) END AS score FROM b""",
}
