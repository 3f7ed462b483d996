"""Score of vacancies against a candidate: pure column expressions over the features table, no shuffle and no Python rows.

Taxonomy and candidate are settings of bounded size; they become literals of the plan. Only the ranking sorts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import Taxonomy


@dataclass(frozen=True)
class Candidate:
    role: str
    seniority: str
    years: float | None
    requirements: tuple[tuple[str, str], ...]
    excluded: frozenset[str] = frozenset()


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _match(name: str) -> Column:
    return F.coalesce(F.try_element_at("concepts", F.lit(name))["match"], F.lit(0.0))


def resolve(name: str, c: Candidate, t: Taxonomy) -> Column:
    """found, semantic and exact for one requirement: the concept itself, else its closest relation, else null."""
    options = [] if name in c.excluded else [(name, None), *sorted(t.concept(name).related, key=lambda r: -r[1])]
    out = F.lit(None).cast("struct<found:string,semantic:double,exact:boolean>")
    for found, share in reversed(options):
        semantic = _match(found) if share is None else F.lit(float(share))
        made = F.struct(F.lit(found).alias("found"), semantic.alias("semantic"), F.lit(share is None).alias("exact"))
        out = F.when(F.map_contains_key("concepts", F.lit(found)), made).otherwise(out)
    return out


def effective(found: Column, t: Taxonomy) -> Column:
    """semantic x context x confidence x boost of repeated mentions, at most 1; 0 without a match."""
    low, high, most = t.boost
    entry = F.try_element_at("concepts", found["found"])
    counted = (F.least(entry["mentions"], F.lit(high)) - low + 1) / (high - low + 1)
    boost = F.when(entry["mentions"] >= low, 1 + most * counted).otherwise(1.0)
    product = found["semantic"] * entry["context"] * entry["confidence"] * boost
    return F.when(product.isNotNull(), F.least(F.lit(1.0), product)).otherwise(0.0)  # least() alone passes over nulls


def support(name: str, mine: set[str], t: Taxonomy) -> float:
    """How far the candidate's concepts cover one of the vacancy: itself or its parent version, else a relation."""
    parent, _, version = name.rpartition("_")
    if name in mine or (version.isdigit() and any(name.startswith(m + "_") for m in mine)):
        return 1.0
    return max((s for r, s in t.concept(name).related if r in mine), default=0.0)


def coverage(c: Candidate, t: Taxonomy) -> Column:
    """Weighted share of the vacancy's concepts that the candidate covers; null without concepts on either side."""
    mine = {n for n, _ in c.requirements} - c.excluded
    context = {k.name: F.coalesce(F.try_element_at("concepts", F.lit(k.name))["context"], F.lit(0.0)) for k in t.concepts}
    whole = total([context[k.name] * float(k.weight) for k in t.concepts])
    covered = total([context[k.name] * float(k.weight * support(k.name, mine, t)) for k in t.concepts])
    return F.when((whole > 0) & F.lit(bool(mine)), covered / whole)


def experience(c: Candidate, t: Taxonomy) -> Column:
    if c.years is None:
        return F.lit(None).cast("double")
    delta = F.lit(float(c.years)) - F.col("years")
    out = F.lit(0.0)
    for threshold, value in sorted(t.year_rules):
        out = F.when(delta >= threshold, F.lit(value)).otherwise(out)
    return F.when(F.col("years").isNotNull(), out)


def seniority(c: Candidate, t: Taxonomy) -> Column:
    rank = {level: n for level, n, _ in t.levels}
    out = F.lit(None).cast("double")
    for level, n in rank.items():
        if c.seniority in rank:
            step = min(abs(rank[c.seniority] - n), len(t.distance) - 1)
            out = F.when(F.col("seniority.level") == level, F.lit(t.distance[step])).otherwise(out)
    return out


def gate_conditions(c: Candidate) -> dict[str, Column]:
    must = {n for n, i in c.requirements if i == "MUST_HAVE"}
    weak_role = F.col("role.match") < 0.5
    java, frame = _match("JAVA"), F.greatest(*[_match(n) for n in ("SPRING_BOOT", "SPRING", "QUARKUS", "MICRONAUT")])
    return {
        "JAVA_PRIMARY_MISSING": java < 0.5,
        "BACKEND_ROLE_MISSING": weak_role,
        "JAVA_BACKEND_FRAMEWORK_MISSING": (java >= 0.5) & (frame < 0.5),
        "WRONG_PRIMARY_ROLE": F.exists("negatives", lambda n: n["conflict"]),
        "DEVOPS_ROLE_MISSING": weak_role,
        "LINUX_MISSING": F.greatest(_match("LINUX"), _match("UNIX")) < 0.5,
        "KUBERNETES_CRITICAL_MISSING": F.lit("KUBERNETES" in must) & (F.greatest(_match("KUBERNETES"), _match("OPENSHIFT") * 0.7) < 0.5),
        "ONE_C_PRIMARY_MISSING": (_match("ONE_C_PLATFORM") < 0.5) & weak_role,
        "DEVELOPER_ROLE_MISSING": weak_role,
        "QUERY_LANGUAGE_CRITICAL_MISSING": F.lit("ONE_C_QUERY_LANGUAGE" in must) & (_match("ONE_C_QUERY_LANGUAGE") < 0.5),
    }


PRIMARY = ("JAVA_PRIMARY_MISSING", "DEVOPS_ROLE_MISSING", "ONE_C_PRIMARY_MISSING")


def score(features: DataFrame, c: Candidate, t: Taxonomy) -> DataFrame:
    """features with score, level, confidence, eligibility, hard_match, coverage, matched, partial, missing, wanted, gates.

    Scores, confidence, coverage and hard_match are per cent with two decimals. ``wanted`` lists the vacancy's heavy
    concepts that the candidate lacks. Raises ValueError for unknown concepts or importances.
    """
    unknown = [i for _, i in c.requirements if i not in t.importance]
    if unknown:
        raise ValueError(f"unknown importance: {unknown[0]}")
    needs = [(n, i, t.importance[i]) for n, i in c.requirements]
    base = features.withColumns({f"_f{k}": resolve(n, c, t) for k, (n, _, _) in enumerate(needs)})
    base = base.withColumns({f"_e{k}": effective(F.col(f"_f{k}"), t) for k in range(len(needs))})
    eff = [F.col(f"_e{k}") for k in range(len(needs))]

    by_category: dict[str, list[tuple[float, Column]]] = {}
    for (n, _, w), e in zip(needs, eff, strict=True):
        by_category.setdefault(t.concept(n).category, []).append((w, e))
    active = sum(t.category_weight[k] for k in by_category)
    skills = total([total([e * w for w, e in v]) / sum(w for w, _ in v) * (t.category_weight[k] / active) for k, v in by_category.items()])

    conditions = gate_conditions(c)
    gates = F.filter(F.array(*[F.when(conditions[g], F.struct(F.lit(g).alias("id"), F.lit(float(m)).alias("most"))) for g, m in t.gates]), lambda g: g.isNotNull()) if t.gates else F.array().cast("array<struct<id:string,most:double>>")
    hard = [e for (_, i, _), e in zip(needs, eff, strict=True) if i == "MUST_HAVE"]
    base = base.withColumns({"_skills": skills, "_coverage": coverage(c, t), "_years": experience(c, t), "_level": seniority(c, t), "_gates": gates})

    w = t.component
    parts = [("skills", "_skills"), ("coverage", "_coverage"), ("experience", "_years"), ("seniority", "_level")]
    combined = total([F.coalesce(F.col(x), F.lit(0.0)) * w[k] for k, x in parts]) * 100
    penalised = combined - F.aggregate("negatives", F.lit(0.0), lambda a, n: a + n["penalty"])
    capped = F.least(penalised, F.array_min(F.transform("_gates", lambda g: g["most"])))
    values = F.map_values("concepts")
    evidence = F.aggregate(values, F.lit(0.0), lambda a, v: a + v["confidence"]) / F.nullif(F.size(values), F.lit(0))
    confidence = total([
        F.coalesce(evidence, F.lit(0.0)) * (w["skills"] if needs else 0.0), F.col("_coverage").isNotNull().cast("double") * w["coverage"],
        F.col("_years").isNotNull().cast("double") * w["experience"], F.coalesce(F.col("_level") * 0 + F.col("seniority.confidence"), F.lit(0.0)) * w["seniority"],
    ])
    ids = F.transform("_gates", lambda g: g["id"])
    eligibility = (
        F.when(F.array_contains(ids, "WRONG_PRIMARY_ROLE"), "INELIGIBLE").when(F.lit(not needs), "UNCERTAIN")
        .when((F.col("role.primary") == "UNKNOWN") | (F.size("concepts") == 0), "UNCERTAIN")
        .when(F.arrays_overlap(ids, F.array(*map(F.lit, PRIMARY))), "INELIGIBLE").otherwise("ELIGIBLE")
    )

    def names(rows):
        listed = [F.when(cond, F.lit(n)) for n, cond in rows]
        return F.filter(F.array(*listed), lambda x: x.isNotNull()) if listed else F.array().cast("array<string>")

    found = [(n, i, F.col(f"_f{k}"), eff[k]) for k, (n, i, _) in enumerate(needs)]
    mine = {n for n, _ in c.requirements} - c.excluded
    heavy = sorted((k for k in t.concepts if k.weight >= 4 and support(k.name, mine, t) == 0), key=lambda k: (-k.weight, k.name))
    out = base.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), capped)), 2)).withColumns(
        {
            "level": band(F.col("score"), t),
            "confidence": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 100, 2),
            "eligibility": eligibility,
            "hard_match": F.round(total(hard) / len(hard) * 100, 2) if hard else F.lit(None).cast("double"),
            "coverage": F.round(F.col("_coverage") * 100, 2),
            "matched": names([(n, f["exact"]) for n, _, f, _ in found]),
            "partial": names([(n, ~f["exact"]) for n, _, f, _ in found]),
            "missing": names([(n, e == 0) for n, i, _, e in found if i in ("MUST_HAVE", "STRONG_PREFERENCE")]),
            "wanted": names([(k.name, F.coalesce((F.try_element_at("concepts", F.lit(k.name))["match"] >= 0.5) & (F.try_element_at("concepts", F.lit(k.name))["context"] > 0), F.lit(False))) for k in heavy]),
            "gates": ids,
        }
    )
    return out.withColumn("summary", summary()).drop(*[x for x in out.columns if x.startswith("_")])


def band(value: Column, t: Taxonomy) -> Column:
    out = F.lit(min(t.bands)[1])
    for low, code in sorted(t.bands):
        out = F.when(value >= low, code).otherwise(out)
    return out


def summary() -> Column:
    level = F.lower(F.replace("level", F.lit("_"), F.lit(" ")))
    return F.when(F.size("gates") > 0, F.concat(F.lit("low relevance: "), F.array_join("gates", "; "))).otherwise(level)


def ranked(scored: DataFrame, date: str | None = None, without: float = -1.0) -> DataFrame:
    """Best first: score, hard_match (absent as ``without``), date (unreadable last), id."""
    order = [F.desc("score"), F.desc(F.coalesce("hard_match", F.lit(without)))]
    if date:
        order.append(F.to_timestamp(date).desc_nulls_last() if dict(scored.dtypes)[date] != "string" else F.try_to_timestamp(F.col(date)).desc_nulls_last())
    return scored.orderBy(*order, "external_id")
