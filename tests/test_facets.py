from pyspark.sql import functions as F

from hirelake.functions import rules as R
from hirelake.operators import account_reports as A
from hirelake.operators import facets as X


def test_rules(spark):
    said = {
        "Java и PostgreSQL": ["Java", "SQL"], "JavaScript, TypeScript": ["JavaScript", "TypeScript"], "C# и .NET": ["C# / .NET"], "Go developer": ["Go"], "let it go": [],
        "1С:Предприятие, Битрикс24": ["1С", "Bitrix24"], "ML-инженер, LLM": ["Data / ML"], "k8s, тестирование": ["DevOps / SRE", "QA"], "c++": ["C / C++"], None: [],
    }
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", R.technologies(F.col("t"))).collect()
    assert {r[0]: r[1] for r in rows} == said and len(R.TECHNOLOGIES) == 21 and len(R.CATEGORIES) == 16 and len(R.INDUSTRIES) == 9
    titles = {
        "Стажер Java": "Стажировка", "AQA engineer": "QA", "UX дизайнер": "Дизайн", "Linux администратор": "DevOps", "Linux C++ developer": "Embedded", "Java разработчик": "Backend",
        "Системный аналитик": "Аналитика", "Программист 1С": "1С", "React developer": "Frontend", "Программист": "Backend", "Повар": "Другое", None: "Другое",
    }
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", R.first_of(F.col("t"), R.CATEGORIES, R.NO_CATEGORY)).collect()
    assert dict(map(tuple, rows)) == titles
    names = {"Т-Банк": "Fintech", "Kaspersky": "Security", "Ozon": "Retail tech", "МТС": "Telecom & media", "Крок": "IT services", "Ромашка": "Technology"}
    rows = spark.createDataFrame([(t,) for t in names], "t string").select("t", R.first_of(F.col("t"), R.INDUSTRIES, R.NO_INDUSTRY)).collect()
    assert dict(map(tuple, rows)) == names


def test_public_url(spark):
    urls = {
        "https://a.example.com/x": True, "HTTP://A.example.com": True, "ftp://a.example.com": False, "https://u:p@a.example.com": False, "http://localhost:80/": False, "http://10.1.2.3": False,
        "http://172.15.0.1": True, "http://172.31.0.1": False, "http://192.168.0.1/": False, "http://[::1]/": False, "http://intranet/": False, "": False, None: False,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.public_url(F.col("u"))).collect()
    assert dict(map(tuple, rows)) == urls


def test_selections(spark):
    j = spark.createDataFrame(
        [(1, "a", "Java dev", ["java"], "remote", "", True, False, "QA"), (2, "a", "cook", ["java", "go"], "x", "гибрид", True, False, "QA"), (3, "a", "Java", [], "remote", "", False, False, "QA"), (4, "b", "Java", ["java"], "remote", "", True, False, "QA")],
        "external_id int, company string, title string, technologies array<string>, location string, type string, active boolean, stale boolean, category string",
    )
    ids = lambda d: sorted(r.external_id for r in d.collect())
    assert ids(X.company_page(j, "a", "JAVA")) == [1, 2] and ids(X.company_page(j, "a", techs=("java", "go"), remote=True)) == [2]
    assert ids(X.company_page(j, "a", category="Data")) == [] and ids(X.complete(j.withColumn("description", F.lit(" ")))) == []
    cities = F.when(F.col("external_id") == 1, F.array()).when(F.col("external_id") == 2, F.array(F.lit("Рига"), F.lit("Омск"))).otherwise(F.array(F.lit("Рига")))
    assert ids(X.outside(j, cities, ("Рига",))) == [1, 2]
    people = spark.createDataFrame([(True, True, "1", ["ANY", "офис"], 140.0), (False, True, "2", None, 1.0), (True, True, "", None, 1.0), (True, True, "4", None, None)], "enabled boolean, new_jobs boolean, chat_id string, formats array<string>, min_score double")
    assert sorted((r.chat_id, r.formats, r.min_score) for r in X.eligible(people).collect()) == [("1", ["офис"], 100.0), ("4", [], 0.0)]


def test_runs(spark):
    runs = spark.createDataFrame([("s", "", "2024-01-01 10:00:00", "2024-01-01 10:00:05", "ok", 2), ("t", "own", "2024-01-01 10:14:00", "2024-01-01 10:16:30", "failed", 3), ("u", None, "2024-01-01 09:00:00", "2024-01-01 09:01:00", "ok", 9)], "source_key string, company string, started_at string, finished_at string, status string, n int")
    runs = runs.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
    r = A.run_report(runs, ("n",)).first()
    assert (r.n, r.seconds, r.ok, r.failed) == (3, 150.0, 0, 1)
    jobs = spark.createDataFrame([("s", "A"), ("s", "B")], "source_key string, company string")
    assert {x.source_key: x.company for x in A.named_runs(runs, jobs).collect()} == {"s": "B", "t": "own", "u": "u"}
    assert A.run_report(runs.limit(0), ("n",)).first().n == 0


def test_compiled_rules(spark):
    """Patterns as Spark runs them find what the portable ones find, at all borders; none begins by reading a border."""
    said = ["java", "xjava", "java1", "(java)", "a_java", "java_", "\njava\n", "go developer", "go-engineer", "algo engineer", "c#", "c#x", "x.net", ".nets", "c++", "c++b", "cpp", "с++", "1c", "21с", "1c-enterprise", "ml/x", "xml-", "ai ", "l2", "l2x", "bi", "bix",
            "машинное обучение", "ux", "uxe", "aqa", "qa", "java java1", "xjava java", "😀java", "яjava", "", "dynamics ax", "dynamics axe", "internship", "interns", "arm64", "iot,", "riot"]
    rules = R.TECHNOLOGIES + R.CATEGORIES + R.INDUSTRIES
    t = spark.createDataFrame([(t,) for t in said], "t string")
    both = lambda f: F.array(*[F.col("t").rlike(f(p)) for _, p in rules])
    rows = t.select("t", both(R.portable).alias("a"), both(R._compiled).alias("b")).collect()
    assert [r.t for r in rows if r.a != r.b] == [] and any(any(r.a) for r in rows)
    assert not any(R._compiled(p).startswith("(?:^|") for _, p in rules)
