"""Vacancy features: concepts mentioned in a text with their context, role, level, years and negative signals.

Mentions need positions (longest match, sentence borders, distance to a modifier), so one Arrow-batched function finds
them; everything else is built from Spark's expressions. Rows stay where they are: extraction has no shuffle.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, normalize_text
from .taxonomy import Taxonomy

WORD = r"[\w+#]"
NEAR, NEGATION_GAP, YEARS_NEAR = 120, 6, 90
BREAK = re.compile("[.!?\n;]")
#: Words that mark years as experience.
EXPERIENCE = re.compile("опыт|experience|commercial|коммерч|разработк|developer|engineer")
#: Marks of a sentence about the company or the team.
ABOUT_OTHERS = "в компании|команд|работают|есть|много"
CONCEPTS = "map<string,struct<match:double,context:double,confidence:double,mentions:int>>"
FOUND = "struct<concepts:array<struct<concept:string,context:double,mentions:int>>,years:int>"


def phrase(text: Column, *words: str) -> Column:
    """Whether one of the phrases stands in the text between word borders; the border before one is looked at after its first letter."""
    edge = r"[\p{L}\p{N}_+#]"
    each = [rf"\Q{w[0]}\E(?<!{edge}\Q{w[0]}\E)\Q{w[1:]}\E" for w in words]
    return text.rlike(rf"(?:{'|'.join(each)})(?!{edge})") if words else F.lit(False)


def _borders(inner: str) -> re.Pattern:
    return re.compile(rf"(?<!{WORD})(?=({inner})(?!{WORD}))")


def _stem(alias: str) -> str:
    """Pattern of an alias; Russian plurals also stand for their other cases."""
    if re.fullmatch("[а-яё]{6,}", alias) and alias[-1] in "ыи":
        return re.escape(alias[:-1]) + "[а-яё]*"
    return re.escape(alias)


class Mentions:
    """Finds the concepts of one text. Longest aliases win where matches overlap, but a versioned concept (JAVA_17)
    leaves its parent (JAVA) in place."""

    def __init__(self, taxonomy: Taxonomy):
        pairs = sorted(((a, c.name) for c in taxonomy.concepts for a in c.aliases), key=lambda p: (-len(p[0]), p))
        self.order = [c.name for c in taxonomy.concepts]
        self.by_alias = {a: n for a, n in reversed(pairs)}
        self.stems = [(re.compile(_stem(a)), n) for a, n in pairs if _stem(a) != re.escape(a)]
        self.each = [(_borders(_stem(a)), n) for a, n in pairs]
        self.alias = _borders("|".join(_stem(a) for a, _ in pairs))
        self.parents = {n: [(a, p) for a, p in pairs if n != p and re.fullmatch(re.escape(p) + r"_\d+", n)] for _, n in pairs}
        self.modifier_of = {p: (name, value) for name, value, ps in reversed(taxonomy.modifiers) for p in ps}
        listed = sorted(self.modifier_of, key=len, reverse=True)
        self.modifier = _borders("|".join(map(re.escape, listed))) if listed else None
        self.years = [re.compile(p) for p in taxonomy.year_patterns]
        self.numbers = taxonomy.year_words
        words = "|".join(map(re.escape, self.numbers))
        self.number = re.compile(rf"(?:от|не менее|минимум|at least)\s+({words})\s+(?:лет|года|год|years?)") if words else None

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Longest first over all matches, then earliest, then by name: what overlaps a match that stays goes."""
        queue = []
        for m in self.alias.finditer(text):
            words = m[1]
            name = self.by_alias.get(words) or next(n for p, n in self.stems if p.fullmatch(words))
            queue.append((-len(words), m.start(1), name))
        heapq.heapify(queue)
        starts: list[int] = []
        kept: list[tuple[int, int, str]] = []
        while queue:
            size, start, name = heapq.heappop(queue)
            end, at = start - size, bisect_left(starts, start)
            if (at == len(kept) or kept[at][0] >= end) and (at == 0 or kept[at - 1][1] <= start):
                starts.insert(at, start)
                kept.insert(at, (start, end, name))
            elif shorter := self.shorter(text, start, -size):
                heapq.heappush(queue, shorter)
        inner = [(s, e, p) for s, e, n in kept for a, p in self.parents[n] if a in text[s:e].split() or text[s:e].startswith(a + " ")]
        return sorted({*kept, *inner})

    def shorter(self, text: str, start: int, size: int) -> tuple[int, int, str] | None:
        """The longest match at start of fewer characters than size."""
        found = [(-len(m[1]), start, n) for p, n in self.each if (m := p.match(text, start)) and len(m[1]) < size]
        return min(found, default=None)

    def contexts(self, text: str, spans: list[tuple[int, int, str]]) -> list[float]:
        """For each mention the multiplier of the nearest modifier around its sentence, 1 without any."""
        if self.modifier is None:
            return [1.0] * len(spans)
        ends = [-1, *(m.start() for m in BREAK.finditer(text)), len(text)]
        modifiers = [(m.start(1), m.end(1), *self.modifier_of[m[1]]) for m in self.modifier.finditer(text)]
        starts = [m[0] for m in modifiers]
        out = []
        for start, end, _ in spans:
            begin = max(0, ends[bisect_left(ends, start) - 1] + 1 - NEAR)
            stop = ends[bisect_left(ends, end)]
            near = []
            for s, e, name, value in modifiers[bisect_left(starts, begin) : bisect_left(starts, stop)]:
                gap = min(abs(start - e), abs(s - end))
                if e <= stop and gap <= NEAR and (name != "NEGATED_OR_DEPRECATED" or 0 <= start - e <= NEGATION_GAP):
                    near.append((gap, s - e, value))
            out.append(min(near, key=lambda n: n[:2])[2] if near else 1.0)
        return out

    def min_years(self, text: str) -> int | None:
        def relevant(m):
            return EXPERIENCE.search(text[max(0, m.start() - YEARS_NEAR) : m.end() + YEARS_NEAR])

        found = [int(m[1]) for p in self.years for m in p.finditer(text) if len(m[1]) < 4 and relevant(m)]
        if self.number:
            found += [self.numbers[m[1]] for m in self.number.finditer(text) if relevant(m)]
        return max(found, default=None)

    def read(self, text: str) -> dict:
        spans = self.spans(text)
        by_name: dict[str, list[float]] = {}
        for (_, _, name), context in zip(spans, self.contexts(text, spans), strict=True):
            by_name.setdefault(name, []).append(context)
        concepts = [{"concept": n, "context": max(by_name[n]), "mentions": len(by_name[n])} for n in self.order if n in by_name]
        return {"concepts": concepts, "years": self.min_years(text)}


def found_in(text: Column, taxonomy: Taxonomy) -> Column:
    """Concepts in the order of the taxonomy with greatest context and number of mentions, and the years of experience asked for."""

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Mentions(taxonomy)
        for texts in batches:
            yield pd.DataFrame([finder.read(t) for t in texts], columns=["concepts", "years"])

    return find(text)


def mention_table(taxonomy: Taxonomy):
    """The mentions of a text as a table function: concept, start (from 0), stop (exclusive) and context, in text order."""

    @F.udtf(returnType="concept string, start long, stop long, context double")
    class MentionRows:
        def __init__(self):
            self.finder = Mentions(taxonomy)

        def eval(self, text: str):
            spans = self.finder.spans(text or "")
            for (start, stop, name), context in zip(spans, self.finder.contexts(text or "", spans), strict=True):
                yield name, start, stop, context

    return MentionRows


def mention_rows(jobs: DataFrame, taxonomy: Taxonomy, keys: tuple[str, ...] = ("source_key", "external_id")) -> DataFrame:
    """Keys and a row for each mention in title and description, without a shuffle; texts without any give no rows.

    ``spark.udtf.register(name, mention_table(taxonomy))`` gives SQL the same rows: ``FROM jobs, LATERAL name(text)``.
    """
    texts = jobs.select(*keys, whole_text().alias("_text"))
    return texts.lateralJoin(mention_table(taxonomy)(F.col("_text").outer())).drop("_text")


def whole_text(title: Column | None = None, body: Column | None = None) -> Column:
    """What features are read from: the title and the description, normalised, on two lines."""
    title = normalize_text(F.col("title")) if title is None else title
    body = normalize_text(F.col("description")) if body is None else body
    return F.trim(F.concat(title, F.lit("\n"), body))


def _concepts(found: Column) -> Column:
    """Concepts as a map from name to what scores need."""
    entry = lambda m: F.struct(F.lit(1.0).alias("match"), m["context"].alias("context"), F.lit(1.0).alias("confidence"), m["mentions"].alias("mentions"))
    return F.map_from_entries(F.transform(found, lambda m: F.struct(m["concept"].alias("key"), entry(m).alias("value"))))


def _role(title: Column, body: Column, concepts: Column, t: Taxonomy) -> Column:
    """First role named in the title, then title hints, then two signals and a fitting description."""
    make = lambda n, m, c: F.struct(F.lit(n).alias("primary"), F.lit(m).alias("match"), F.lit(c).alias("confidence"))
    rules = [(phrase(title, *aliases), make(name, 0.7 if name == "FULLSTACK" else 1.0, 1.0)) for name, aliases in t.roles]
    rules += [(title.rlike(pattern), make(name, value, value)) for name, pattern, value in t.role_hints]
    signals = sum([F.map_contains_key(concepts, s).cast("int") for s in t.role_signals], F.lit(0))
    if t.role_context:
        rules.append(((signals >= 2) & body.rlike(t.role_context), make(t.main_role, 0.75, 0.75)))
    out = make("UNKNOWN", 0.0, 0.4)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def _named_level(text: Column, t: Taxonomy) -> Column:
    """Level of the longest alias in the text, ties to the higher level; null without any."""
    options = [F.when(phrase(text, a), F.struct(F.lit(len(a)).alias("n"), F.lit(rank).alias("r"), F.lit(level).alias("level"))) for level, rank, aliases in t.levels for a in aliases]
    return F.array_max(F.array(*options))["level"] if options else F.lit(None).cast("string")


def _seniority(title: Column, body: Column, years: Column) -> Column:
    """The level named in the title, else in the description, else by years."""
    make = lambda n, c: F.struct(n.alias("level"), F.lit(c).alias("confidence"))
    return (
        F.when(title.isNotNull(), make(title, 1.0)).when(body.isNotNull(), make(body, 0.85))
        .when(years >= 5, make(F.lit("SENIOR"), 0.6)).when(years >= 3, make(F.lit("MIDDLE"), 0.55))
        .otherwise(make(F.lit("UNKNOWN"), 0.35))
    )


def _negatives(title: Column, body: Column, t: Taxonomy) -> Column:
    """Signals of the title, or of a sentence; for role conflicts not of sentences about the company or the team."""
    sentences = F.split(body, "[.!?\n;]+")
    def one(n):
        spoken = F.filter(sentences, lambda s: ~s.rlike(ABOUT_OTHERS)) if n.conflict else sentences
        # Borders of sentences are borders of words, so a text without the phrase has no sentence with it.
        return phrase(title, *n.patterns) | (phrase(body, *n.patterns) & F.exists(spoken, lambda s: phrase(s, *n.patterns)))

    fields = [F.struct(F.lit(n.name).alias("id"), F.lit(float(n.penalty)).alias("penalty"), F.lit(n.conflict).alias("conflict")) for n in t.negatives]
    out = [F.when(one(n), f) for n, f in zip(t.negatives, fields, strict=True)]
    typed = F.array(*out) if out else F.array().cast("array<struct<id:string,penalty:double,conflict:boolean>>")
    return F.filter(typed, lambda s: s.isNotNull())


def extract(jobs: DataFrame, taxonomy: Taxonomy, keys: tuple[str, ...] = ("source_key", "external_id"), normal: bool = False) -> DataFrame:
    """Keys, version, content_hash, role, seniority, years, concepts and negatives of each row's title and description.

    Null texts count as empty; a row without concepts has an empty map. ``normal``: the texts were normalised before.
    """
    plain = F.col if normal else lambda name: normalize_text(F.col(name))
    base = jobs.select(*keys, plain("title").alias("_title"), plain("description").alias("_body"))
    read = base.withColumn("_found", found_in(whole_text(F.col("_title"), F.col("_body")), taxonomy))
    named = read.withColumns({"concepts": _concepts(F.col("_found.concepts")), "years": F.col("_found.years"), "_tl": _named_level(F.col("_title"), taxonomy), "_bl": _named_level(F.col("_body"), taxonomy)})
    title, body = F.col("_title"), F.col("_body")
    return named.select(
        *keys, F.lit(taxonomy.version).alias("version"), F.sha2(F.concat(title, F.lit("\n"), body), 256).alias("content_hash"),
        _role(title, body, F.col("concepts"), taxonomy).alias("role"),
        _seniority(F.col("_tl"), F.col("_bl"), F.col("years")).alias("seniority"),
        "years", "concepts", _negatives(title, body, taxonomy).alias("negatives"),
    )


def outdated(jobs: DataFrame, index: DataFrame, version: str, keys: tuple[str, ...] = ("source_key", "external_id")) -> DataFrame:
    """Jobs whose features are absent, of another version, or of another content."""
    seen = index.filter(F.col("version") == version).select(*keys, F.col("content_hash").alias("_hash"))
    now = jobs.withColumn("_now", content_hash(F.col("title"), F.col("description")))
    return now.join(seen.withColumnRenamed("_hash", "_now"), [*keys, "_now"], "left_anti").select(*jobs.columns)


def upsert(index: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("source_key", "external_id")) -> DataFrame:
    """The index with the fresh rows in place of those with the same key."""
    return index.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def compact(features: DataFrame) -> DataFrame:
    """Features as one JSON text with short keys, concepts sorted by name."""
    concepts = F.transform(F.sort_array(F.map_entries("concepts")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("x")))
    body = F.struct(F.col("version").alias("v"), F.col("role").alias("r"), F.col("seniority").alias("s"), F.col("years").alias("e"), concepts.alias("c"), F.col("negatives").alias("n"))
    return features.withColumn("wire", F.to_json(body)).drop("version", "role", "seniority", "years", "concepts", "negatives")


def inflate(wire: DataFrame, version: str) -> DataFrame:
    """compact() undone; rows of another version or with broken JSON go."""
    schema = (
        "v string, r struct<primary:string,match:double,confidence:double>, s struct<level:string,confidence:double>, e int, "
        "c array<struct<k:string,x:struct<match:double,context:double,confidence:double,mentions:int>>>, n array<struct<id:string,penalty:double,conflict:boolean>>"
    )
    parsed = wire.withColumn("_w", F.from_json("wire", schema)).filter(F.col("_w.v") == version)
    return parsed.withColumns(
        {
            "version": F.col("_w.v"), "role": F.col("_w.r"), "seniority": F.col("_w.s"), "years": F.col("_w.e"),
            "concepts": F.map_from_entries(F.transform("_w.c", lambda e: F.struct(e["k"], e["x"]))), "negatives": F.col("_w.n"),
        }
    ).drop("_w", "wire")
