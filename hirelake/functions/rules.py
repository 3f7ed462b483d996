"""Classification of jobs by ordered rules: technologies of a text, category of a title, industry of a company.

Patterns are read in lower case; ``<`` and ``>`` stand for the beginning and the end of a word. They use only what both
Java's and RE2's regular expressions know, so the same patterns serve Spark and SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Technologies and their patterns, in the catalogue's order.
TECHNOLOGIES = (
    ("Java", "<java>"),
    ("Kotlin", "<kotlin>"),
    ("Python", "<python>"),
    ("Go", "<golang>|<go[- ](developer|engineer|разработчик)>"),
    ("JavaScript", "<javascript>|<js>"),
    ("TypeScript", "<typescript>"),
    ("C# / .NET", "<c#>|[.]net>|<dotnet>"),
    ("C / C++", "<c[+][+]>|<cpp>|<с[+][+]"),
    ("PHP", "<php>"),
    ("Ruby", "<ruby>"),
    ("Scala", "<scala>"),
    ("Rust", "<rust>"),
    ("1С", "<1[сc]>|1[сc][:-]?предприятие|1c[:-]?enterprise"),
    ("Bitrix24", "<bitrix24>|битрикс24"),
    ("BPMSoft", "<bpmsoft>"),
    ("Axapta / Dynamics AX", "<(axapta|dynamics ax)>"),
    ("Optimacros", "<optimacros>"),
    ("SQL", "<sql>|postgres(ql)?|clickhouse"),
    ("Data / ML", "<machine learning>|<data science>|<ml[- /]|<llm>|<ai[- /]|машинн[\\pL]+ обучен"),
    ("DevOps / SRE", "<devops>|<sre>|kubernetes|<k8s>|terraform"),
    ("QA", "<qa>|тестиров[\\pL]+|quality assurance"),
)
#: Categories by a title, the first that fits; a title without any is "Другое".
CATEGORIES = (
    ("Стажировка", "стажер|стажёр|стажировк|практикант|практика|<intern(ship)?>|<trainee>"),
    ("QA", "<a?qa>|тестир|testing|tester|quality +assurance|quality +engineer"),
    ("Дизайн", "<(ux|ui)>|дизайн|design"),
    ("Менеджмент", "менеджер|manager|management|руководител|начальник|директор|координатор|супервайзер"),
    ("Embedded", "embedded|встраиваем|firmware|прошивк|микроконтрол|rtos|arm(64| +cortex)|stm32|esp32|<iot>|internet +of +things|протокол[\\pL]* +.*сет|linux.*[cс][+][+]|[cс][+][+].*linux"),
    ("Поддержка", "поддержк|support|саппорт|help *desk|service *desk|l[123]>|(первая|первой|1-й|1) +линии|техподдерж|сервисн(ый|ая)"),
    ("1С", "<1c>|1с|1-с"),
    ("Аналитика", "аналитик|аналитич|<analyst>|analytics"),
    ("Backend", "<java>"),
    ("DevOps", "devops|sre|инфраструктур|kubernetes|terraform|cloud|администратор|системн|сетев|linux *(engineer|инженер)|(engineer|инженер) +linux"),
    ("Security", "security|безопасност|кибер|pentest"),
    ("AI/ML", "ai|ml|машинн|нейросет|llm"),
    ("Data", "data|аналитик|bi>|etl|dwh|spark|clickhouse"),
    ("Mobile", "ios|android|mobile|мобильн"),
    ("Frontend", "frontend|front-end|react|vue|angular|веб-разработ"),
    ("Backend", "backend|back-end|разработ|developer|программист|software +engineer"),
)
NO_CATEGORY = "Другое"
#: Industries by a company's name, the first that fits; a name without any is "Technology".
INDUSTRIES = (
    ("Fintech", "банк|bank|финанс|бирж|страх|qiwi|yoomoney|юmoney"),
    ("Security", "безопас|security|kaspersky|dr[.]web|usergate|infotecs|infowatch|bi[.]zone|solar|информзащит"),
    ("Cloud", "облак|cloud|selectel|хост|data.?center|цод|rtlabs"),
    ("Retail tech", "маркет|ритейл|магаз|ламод|ozon|wildber|магнит|лента|ашан|детский мир|вкусвилл|купер|самолет|leman|sportmaster|x5|cdek|dodo|достав|ecom"),
    ("Travel tech", "авиа|s7|туту|travel|туризм"),
    ("Industry", "нефть|газпром|росатом|северстал|сибур|нлмк|фосагро|транснеф|россети|норник|полюс|тмк|металл|энерг"),
    ("Digital platforms", "карты|2гис|циан|домклик|недвиж|яндекс|авито|head.?hunter|hh|rabota|уч[.]ру|skyeng|skillbox"),
    ("Telecom & media", "телеком|мегафон|мтс|ростелеком|билайн|t2|nexign|rutube|vk|okko"),
    ("IT services", "интегратор|консалт|soft|it_|it one|крок|ланит|ибс|корус|ай-теко|рексофт|axenix|neoflex|haиlmont|simbir|glowbyte|bell integrator|jet|т1|t1"),
)
NO_INDUSTRY = "Technology"
#: Places and kinds of work that are remote or partly so.
REMOTE = "remote|удалён|удален|гибрид"


_IN = r"[\pL\pN_]"


def portable(pattern: str) -> str:
    """The pattern with its word borders written out."""
    return pattern.replace("<", r"(?:^|[^\pL\pN_])").replace(">", r"(?:$|[^\pL\pN_])")


def _compiled(pattern: str) -> str:
    """The pattern for Spark, which finds the same texts as ``portable``: borders are looked at, not read, and that before a word
    only after its first letter has been found, so that nearly all places of a text cost one comparison."""
    lone = r"[^\\()\[\]{}|?*+.<>^$]"
    # Borders as other characters first: what is put in has < and > of its own.
    marked = re.sub(rf"<({lone})(?![?*+{{])", "\\1\x00\\1\x01", pattern).replace("<", "\x02").replace(">", f"(?!{_IN})")
    return re.sub("\x00(.)\x01", lambda m: f"(?<!{_IN}{m[1]})", marked).replace("\x02", f"(?<!{_IN})")


def _once(text: Column, use) -> Column:
    """``use`` of the text in lower case, which is made once a row."""
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), use)[0]


def technologies(text: Column, rules: tuple = TECHNOLOGIES) -> Column:
    """Names of all rules that fit, in their order."""
    return _once(text, lambda low: F.array_compact(F.array(*[F.when(low.rlike(_compiled(p)), F.lit(n)) for n, p in rules])))


def first_of(text: Column, rules: tuple, default: str) -> Column:
    """Name of the first rule that fits."""

    def named(low: Column) -> Column:
        out = F.lit(default)
        for name, pattern in reversed(rules):
            out = F.when(low.rlike(_compiled(pattern)), name).otherwise(out)
        return out

    return _once(text, named)


def sql_technologies(text: str, rules: tuple = TECHNOLOGIES) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(lower(coalesce({text}, '')), '{portable(p)}') THEN '{n}' END" for n, p in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_first_of(text: str, rules: tuple, default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(coalesce({text}, '')), '{portable(p)}') THEN '{n}'" for n, p in rules)
    return f"CASE {cases} ELSE '{default}' END"
