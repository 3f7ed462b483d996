"""Observed pages resolved to vacancies: the same canonical url wins, else the best weighted likeness of title, company and host.

The weights bound what titles must have in common: without 163/300 of the words no company and host can lift a pair to the
threshold. So pairs of titles come from a prefix-filtered join of distinct word sets (rarest words first, words of very
many titles dealt over a grid of cells), however many pages or vacancies say the same title. Company and host then only
choose among vacancies that are aggregated by title, company and host, so no copies are paired.
"""

from __future__ import annotations

import math
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, token_set
from ..sources.settle import settled
from .placed import placed

#: Words that don't count, weights of title, company and host, what an equal host counts, least score.
STOP = ("the", "for", "and", "или", "для")
TITLE, COMPANY, HOST, SAME_HOST, LEAST = 0.75, 0.2, 0.05, 0.25, 0.62
#: The least share of common words a pair of titles can do with, (LEAST - COMPANY - HOST * SAME_HOST) / TITLE, as a fraction.
NEED, OF = 163, 300
#: The same where company and host don't agree, or one of them: (LEAST - COMPANY - HOST * SAME_HOST) / TITLE without what is missing.
SHARES = {(False, False): (62, 75), (False, True): (81, 100), (True, False): (14, 25), (True, True): (NEED, OF)}
_PLACES, _IDS = Decimal(10**20), Decimal(1 << 63)
#: Sizes fall into classes of this ratio, more than OF / NEED, so that pairs are of one class or neighbours.
RATIO = 1.9
#: Titles of one word that meet in a task, on either side; words of more are dealt over more cells.
CELL = 4000


def _sides(rows: DataFrame, key: str) -> DataFrame:
    c = F.col
    text = lambda n: F.coalesce(c(n), F.lit(""))
    url = canonical_url(F.trim(text("url")))
    words = F.sort_array(token_set(c("title"), STOP))
    host = F.regexp_extract(url, "^[a-z]+://(.*?)(/|$)", 1)
    return rows.select(key, url.alias("url"), host.alias("host"), F.array_join(words, " ").alias("said"), F.lower(text("company")).alias("company"))


def _titles(*sides: DataFrame) -> DataFrame:
    """said, t, w: the distinct titles of all sides by number, and their words as (place, n), rarest first: n titles of the sides
    have the word, and place numbers words in this order."""
    sets = [s.filter("said <> ''").select("said").distinct() for s in sides]
    spread = reduce(DataFrame.unionByName, sets).select("said", F.explode(F.split("said", " ")).alias("word"))
    words = placed(spread.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "n", "word")
    ranked = spread.distinct().join(words, "word").groupBy("said").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("w"))
    return settled(ranked.withColumn("t", F.monotonically_increasing_id()))


def _met(left: DataFrame, right: DataFrame, on: list[str], cell: int, need: int, of: int) -> DataFrame:
    """a, share, the columns ``on`` and those that ``right`` has besides: pairs of a title of ``left`` and one of ``right`` (columns
    t and w, as ``_titles`` gives them) that agree in ``on`` and have at least need / of of all their words in common. Each pair
    comes once, found at the rarest word that both have."""
    c = F.col

    def prefixes(rows: DataFrame, name: str) -> DataFrame:
        size = F.size("w")
        take = size - F.floor((need * size + of - 1) / of).cast("int") + 1
        level = F.floor(F.log(size) / math.log(RATIO)).cast("int")
        kept = [n for n in rows.columns if n not in ("t", "w")]
        out = rows.select(c("t").alias(name), c("w.place").alias(name + "w"), *kept, level.alias("level"), F.explode(F.slice("w", F.lit(1), take)).alias("x"))
        cells = F.ceil(c("x.n") / cell).cast("int")
        return out.select(name, name + "w", *kept, "level", c("x.place").alias("word"), cells.alias("cells"), F.pmod(F.xxhash64(name), cells).cast("int").alias(name + "c"))

    other = lambda name: F.explode(F.sequence(F.lit(0), c("cells") - 1)).alias(name)
    a = prefixes(left, "a")
    a = a.select("a", "aw", *on, "word", "ac", "cells", F.explode(F.array(*[c("level") + i for i in (-1, 0, 1)])).alias("level"))
    a = a.select("*", other("bc")).drop("cells")
    b = prefixes(right, "b").select("*", other("ac")).drop("cells")
    an, bn = F.size("aw"), F.size("bw")
    met = a.join(b, ["word", "level", "ac", "bc", *on]).filter((an * need <= bn * of) & (bn * need <= an * of))
    both = met.withColumn("both", F.array_intersect("aw", "bw")).filter(c("both")[0] == c("word"))
    common = F.size("both")
    union = an + bn - common
    return both.filter(common * of >= union * need).withColumn("share", common / union).drop("aw", "bw", "ac", "bc", "word", "level", "both")


def title_pairs(left: DataFrame, right: DataFrame, cell: int = CELL) -> DataFrame:
    """a, b, share: pairs of a title of ``left`` and one of ``right`` (column ``said``: sorted distinct words) with at least
    NEED / OF of all their words in common, each once. There may be very many: ``resolve`` writes none of them."""
    titles = _titles(left, right)
    sides = [titles.join(s.select("said").distinct(), "said", "left_semi") for s in (left, right)]
    met = _met(sides[0].drop("said"), sides[1].withColumnRenamed("said", "b_said"), [], cell, NEED, OF)
    named = titles.select(F.col("t").alias("a"), F.col("said").alias("a_said"))
    return met.join(named, "a").select(F.col("a_said").alias("a"), F.col("b_said").alias("b"), "share")


def containing(needles: DataFrame, names: DataFrame) -> DataFrame:
    """needle, name: which of the distinct ``names.name`` contain which ``needles.needle``, found at the needle's rarest three letters."""
    c = F.col

    def grams(text: Column, n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    held = names.filter("name <> ''").distinct().select("name", F.explode(F.array_distinct(F.concat(*[grams(c("name"), n) for n in (1, 2, 3)]))).alias("gram"))
    asked = needles.filter("needle <> ''").distinct()
    asked = asked.select("needle", F.explode(F.when(F.length("needle") < 3, F.array("needle")).otherwise(F.array_distinct(grams(c("needle"), 3)))).alias("gram"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("x")).select("needle", c("x.gram").alias("gram"))
    return rarest.join(held, "gram").filter(F.contains("name", "needle")).select("needle", "name")


def _packed(share: Column, first: Column) -> Column:
    """A share of at least a half (a whole number of 2^-53) and an id as one number: higher shares, then smaller ids, are more.
    A decimal is summed up in place, a struct only after a sort."""
    return F.floor(share * float(1 << 53)).cast("decimal(16,0)") * F.lit(_PLACES) + (F.lit(_IDS) - first.cast("decimal(19,0)"))


def _unpacked(packed: Column) -> tuple[Column, Column]:
    rest = packed % F.lit(_PLACES)
    return ((packed - rest) / F.lit(_PLACES)).cast("long") / F.lit(float(1 << 53)), (F.lit(_IDS) - rest).cast("long")


def resolve(pages: DataFrame, vacancies: DataFrame, cell: int = CELL) -> DataFrame:
    """page_id, vacancy_id, how, score: the vacancy of each page.

    pages: page_id, url, title, company; vacancies: vacancy_id (a number that gives their order), url, title, company. Equal
    canonical urls win (how: url, no score), the first vacancy of several; else the highest score of LEAST and more (how:
    title), the first of equal ones; else no vacancy (how: empty). Nulls count as empty; an empty title, url, company or host
    equals nothing.
    """
    c = F.col
    p, v = _sides(pages, "page_id"), _sides(vacancies, "vacancy_id")
    known = v.filter("url <> ''").groupBy("url").agg(F.min("vacancy_id").alias("by_url"))
    p = p.join(known, "url", "left")
    kinds = settled(p.filter("by_url is null and said <> ''").select("said", "company", "host").distinct())
    jobs = settled(v.filter("said <> ''").groupBy("said", "company", "host").agg(F.min("vacancy_id").alias("vacancy_id")))
    titles = _titles(kinds, jobs)
    words, number = titles.select("t", "w"), titles.select("said", "t")
    asking = settled(kinds.join(number, "said"))
    offered = settled(jobs.join(number, "said").select("t", c("company").alias("held"), "host", "vacancy_id"))
    names = settled(containing(kinds.select(c("company").alias("needle")), jobs.select(c("company").alias("name"))))
    names = names.select(c("needle").alias("company"), c("name").alias("held"))

    def best(company: bool, host: bool) -> tuple[DataFrame, list[str]]:
        """The best vacancy of each page title (and company, and host) if these are known to agree. It counts no more than a
        vacancy's score, and one of the four ways counts all of it. Where company and host are given, the order is that of
        shares, so each task sends its highest share with the first vacancy only."""
        by = ["t"] + ["company"] * company + ["host"] * host
        on = ["held"] * company + ["host"] * host
        asked = asking.filter("company <> ''" if company else "true").filter("host <> ''" if host else "true").select(by).distinct()
        left = asked.join(names, "company").select("t", *on).distinct() if company else asked
        right = offered.groupBy("t", *on).agg(F.min("vacancy_id").alias("first"))
        met = _met(left.join(words, "t"), right.join(words, "t"), on, cell, *SHARES[company, host])
        score = lambda share: share * TITLE + F.lit(float(company)) * COMPANY + F.lit(SAME_HOST if host else 0.0) * HOST
        found = met.filter(score(c("share")) >= LEAST).groupBy(c("a").alias("t"), *on).agg(F.max(_packed(c("share"), c("first"))).alias("x"))
        if company:
            found = asked.join(names, "company").join(found, ["t", *on]).groupBy(by).agg(F.max("x").alias("x"))
        share, first = _unpacked(c("x"))
        return found.select(*by, F.struct(score(share).alias("score"), (-first).alias("last")).alias(f"x{company:d}{host:d}")), by

    ways = [(x, y) for x in (False, True) for y in (False, True)]
    told = asking
    for way in ways:
        found, by = best(*way)
        told = told.join(found, by, "left")
    told = told.select("said", "company", "host", F.greatest(*[f"x{x:d}{y:d}" for x, y in ways]).alias("x")).filter("x is not null")
    out = p.join(told, ["said", "company", "host"], "left")
    by_url = c("by_url").isNotNull()
    return out.select(
        "page_id", F.when(by_url, c("by_url")).otherwise(-c("x.last")).alias("vacancy_id"),
        F.when(by_url, "url").when(c("x").isNotNull(), "title").otherwise("").alias("how"), F.when(~by_url, c("x.score")).alias("score"),
    )
