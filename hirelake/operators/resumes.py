"""Resume fields, relative dates and page fragments over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resume as R
from ..sources.tables import table

NOW = "1998-08-03 12:00:00"
#: Words of the invented prose that stand for skills.
WORDS = (("the", "language", ("the", "der")), ("of", "language", ("of",)), ("und", "data", ("und", "and")), ("para", "cloud", ("para", "pour")))


def resume_fields(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", R.email(t).alias("email"), R.phone(t).alias("phone"), R.telegram(t).alias("telegram"), R.position(t).alias("position"),
        F.array_join(R.skills(t, WORDS), ",").alias("skills"),
    )


def relative_dates(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the words for their age; dates of odd keys are dotted, every eleventh isn't a date."""
    n, at = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(n % 11 == 0, "31.02.1997").when(n % 2 == 1, F.date_format(at, "dd.MM.yyyy HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    words = R.relative_date(text, F.lit("soon"), F.lit(NOW).cast("timestamp"))
    return table(spark, d, "orders").groupBy(words.alias("age")).agg(F.count(F.lit(1)).alias("orders"))


def page_fragments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", R.fragment_text(F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1)).alias("text"))


QUERIES = {"resume_fields": resume_fields, "relative_dates": relative_dates, "page_fragments": page_fragments}
_T = "coalesce(text, '')"
_LINES = f"list_transform(string_split_regex({_T}, '\\r?\\n'), lambda x: trim(regexp_replace(regexp_replace(x, '[ \\t•-]+', ' ', 'g'), '^ ', ''), ' '))"
_P = f"regexp_replace(regexp_extract({_T}, '{R.PHONE}', 1), '[^0-9]', '', 'g')"
_EDGE = r"[^\pL\pN_+#.]"
_SKILLS = ", ".join(rf"CASE WHEN regexp_matches(lower({_T}), '(^|{_EDGE})({'|'.join(a)})($|{_EDGE})') THEN '{n}' END" for n, _, a in WORDS)
_DAYS = "days::VARCHAR || ' ' || CASE WHEN days % 100 BETWEEN 11 AND 14 THEN 'дней' WHEN days % 10 = 1 THEN 'день' WHEN days % 10 BETWEEN 2 AND 4 THEN 'дня' ELSE 'дней' END || ' назад'"


def _replace(sql: str, *pairs: tuple[str, str]) -> str:
    for pattern, to in pairs:
        sql = f"regexp_replace({sql}, '{pattern}', {to}, 'g')"
    return sql


_BODY = _replace(
    "regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)", ("(?is)<(script|style)[^>]*>.*?</(script|style)>", "' '"), ("(?i)<li[^>]*>", "chr(10) || '• '"),
    ("(?i)</?(p|div|br|ul|ol|h[1-6]|section|article|tr|table)( [^>]*)?/?>", "chr(10)"), ("(?s)<[^>]*>", "' '"),
)
for _e, _c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _BODY = f"replace({_BODY}, '{_e}', '{_c}')"
ORACLE = {
    "resume_fields": f"""SELECT doc_id, regexp_extract({_T}, '{R.EMAIL}', 1) AS email,
      CASE WHEN length({_P}) = 11 THEN '+7 (' || substr({_P}, 2, 3) || ') ' || substr({_P}, 5, 3) || '-' || substr({_P}, 8, 2) || '-' || substr({_P}, 10, 2) ELSE '' END AS phone,
      CASE WHEN regexp_extract({_T}, '{R.TELEGRAM}', 1) = '' THEN '' ELSE '@' || regexp_extract({_T}, '{R.TELEGRAM}', 1) END AS telegram,
      coalesce(list_filter({_LINES}[1:30], lambda x: length(x) <= 120 AND NOT contains(x, '@') AND NOT contains(lower(x), 'http') AND regexp_matches(x, '{R.POSITION}'))[1], '') AS position,
      array_to_string(list_filter([{_SKILLS}], lambda s: s IS NOT NULL), ',') AS skills FROM documents""",
    "relative_dates": f"""WITH a AS (SELECT o_orderkey % 11 = 0 AS bad, floor(greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 3600)::BIGINT AS hours, hours // 24 AS days FROM orders)
      SELECT CASE WHEN bad THEN 'дата неизвестна' WHEN hours < 1 THEN 'только что' WHEN hours < 24 THEN hours::VARCHAR || ' ч назад' ELSE {_DAYS} END AS age, count(*) AS orders FROM a GROUP BY 1""",
    "page_fragments": f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split({_BODY}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'), ' ')),
      lambda x: x NOT IN ('', '•')), chr(10)) AS text FROM pages""",
}
