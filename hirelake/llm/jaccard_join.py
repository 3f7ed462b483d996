"""Exact n-gram Jaccard join by set-relation skipping, as classes and connected components.

1. Every text becomes the set of 64-bit hashes of its distinct shingles; equal sets are one class from here on.
2. Tokens are ordered by the level of their hash bucket's count over the whole corpus (2 ** BUCKETS_LOG2 buckets, whatever
   the corpus; STEPS levels for each doubling of the count), rare first; the order decides only how long lists are. A class enters index lists with its first
   n - ceil(t n) + 2 tokens and their positions. Two different sets that reach t (over a half) share two tokens in both
   prefixes, at which min(n1 - i, n2 - j) + 1 still reaches the overlap they need; list entries that can't satisfy this
   with each other are skipped by position and size.
3. Set relations: each list has a pivot. A class is compared exactly with one pivot (which it meets most often), and the
   tokens it has more and less than a linked pivot are kept. Links found so give first components.
4. Only entries of a list that are in different components are paired further. A list is cut into blocks of set sizes;
   an entry's position tells the largest set it can still link with, so it meets only the blocks it may reach. A pair's
   answer is derived from the pivot's answers where both have one: with the symmetric differences d to a common pivot,
   d1 + d2 within the bound is a link and |d1 - d2| beyond it is none, and from the kept differences of two sets linked
   with it the overlap is |pivot| - |less1 u less2| + |more1 n more2| exactly. Only the rest is computed from texts.
5. Components over all links.

Groups of near copies thus cost a comparison each, not one for every pair, and no link that joins components is lost.

Defined cases: a null text and a text without words have an empty set, linked with nothing, their own component; fewer
words than a shingle: the whole sequence is the one shingle; repeated rows and equal texts share a class; component_id is
the smallest doc_id reachable, null if none of them has an id; rows that share an id are texts of their own, each with
its links; texts of any length are used whole; an empty table gives an empty table; other columns pass by.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, cut, discard, ids_clash, lower_ascii, row_numbers, words

BUCKETS_LOG2 = 22
#: Buckets a row of counts on the way to the driver.
CHUNK = 1 << 13
#: Levels of a count for each doubling: one byte holds the level of any count.
STEPS = 4


def shingle_set(text: Column, k: int) -> Column:
    """Distinct 64-bit hashes of a text's k-word shingles."""

    def shingles(w):
        many = F.transform(
            F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        )
        one = F.array(F.xxhash64(w, F.size(w)))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= k, F.array_distinct(many)).when(F.size(w) > 0, one).otherwise(none)

    return bind(words(lower_ascii(text)), shingles)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def bucket_levels(sets: DataFrame) -> np.ndarray:
    """How many set members fall in each hash bucket, over all rows, as levels of one byte: a table of fixed size.

    A task sends its counts in rows of CHUNK buckets, small enough for all tasks' rows of one chunk to fit in a task; counts
    are added up in tasks, and only their levels come to the driver.
    """

    def run(batches):
        held = np.zeros(1 << BUCKETS_LOG2, np.int64)
        for b in batches:
            if len(b):
                held += np.bincount(_bucket(np.concatenate(list(b["h"]))), minlength=len(held))
        at = [k for k in range(0, len(held), CHUNK) if held[k : k + CHUNK].any()]
        yield pd.DataFrame({"chunk": np.array(at, np.int64), "counts": [held[k : k + CHUNK].astype(np.int32).tobytes() for k in at]})

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b["chunk"], b["counts"]):
                held[k] = held.get(k, np.zeros(CHUNK, np.int64)) + np.frombuffer(counts, np.int32)
        levels = [(STEPS * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in held.values()]
        yield pd.DataFrame({"chunk": list(held), "levels": levels}).astype({"chunk": "int64"})

    told = sets.select("h").mapInPandas(run, "chunk long, counts binary").repartition("chunk")
    out = np.zeros(1 << BUCKETS_LOG2, np.uint8)
    for r in told.mapInPandas(summed, "chunk long, levels binary").toLocalIterator():
        out[r.chunk : r.chunk + CHUNK] = np.frombuffer(r.levels, np.uint8)
    return out


def _prefixes(shared, num: int, den: int):
    def run(batches):
        rank = shared.value
        for b in batches:
            keys, prefixes = [], []
            for h in b["h"]:
                n = len(h)
                h = np.sort(h)
                keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest())
                p = n - (num * n + den - 1) // den + 2
                prefixes.append(h[np.argsort(rank[_bucket(h)], kind="stable")[:p]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": b["h"].map(len).astype("int64"), "key": keys, "prefix": prefixes})

    return run


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b), by large and small stars."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small_low.select("a", F.col("m").alias("b")).union(small).distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if tuple(now) == mark:
            break
        mark = tuple(now)
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct())


def _overlaps(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int, differences: bool = False) -> DataFrame:
    """pairs (a, b, ids of classes) with their exact overlap, and with what b has more and less than a if they link; only
    texts that occur in a pair are shingled again.

    Pairs and texts grow with the corpus, so all three joins are sort-merge joins at every size.
    """
    c = F.col
    needed = pairs.select(c("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = docs.join(needed.hint("merge"), "doc_id", "left_semi").select("doc_id", shingle_set(c("text"), k).alias("h"))
    sets = cut(sets, "jj-sets")
    left = pairs.join(sets.select(c("doc_id").alias("a"), c("h").alias("ha")).hint("merge"), "a")
    both = left.join(sets.select(c("doc_id").alias("b"), c("h").alias("hb")).hint("merge"), "b")
    both = both.withColumn("overlap", F.size(F.array_intersect("ha", "hb")).cast("long"))
    linked = (num + den) * c("overlap") >= num * (F.size("ha") + F.size("hb"))
    more = [F.when(linked, F.array_except("hb", "ha")).alias("more"), F.when(linked, F.array_except("ha", "hb")).alias("less")]
    return both.select("a", "b", "overlap", *(more if differences else []))


def jaccard_join(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text), linking sets with overlap / union >= num / den."""
    if 2 * num <= den:
        raise ValueError("the share must be over a half")
    docs = docs.select("doc_id", "text")
    if not ids_clash(docs):
        return _join(docs, k, num, den)
    docs = row_numbers(docs)
    found = cut(_join(docs.select(F.col("row").alias("doc_id"), "text"), k, num, den), "jj-rows")
    named = docs.select("row", F.col("doc_id").alias("name")).join(found.withColumnRenamed("doc_id", "row"), "row")
    least = named.groupBy("component_id").agg(F.min("name").alias("least"))
    return named.join(least, "component_id").select(F.col("name").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def _join(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The same for docs whose doc_id is there and names a row."""
    c = F.col
    sets = docs.select("doc_id", shingle_set(c("text"), k).alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(bucket_levels(sets))
    members = cut(sets.mapInPandas(_prefixes(shared, num, den), "doc_id long, n long, key string, prefix array<bigint>"), "jj-members")
    shared.destroy()

    classes = members.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix")
    )
    classes = cut(classes, "jj-classes")
    posts = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = (
        posts.groupBy("token")
        .agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(c("pos"), -c("n"), c("rep"), c("n"))).alias("p"))
        .filter("m > 1")
        .select("token", c("p.rep").alias("p_rep"), c("p.n").alias("p_n"), c("p.pos").alias("p_pos"))
    )
    pivots = cut(lists, "jj-lists")
    lists = cut(posts.join(pivots, "token"), "jj-entries")
    discard(pivots)

    def may(n1, i, n2, j):
        return (num + den) * (F.least(n1 - i, n2 - j) + 1) >= num * (n1 + n2)

    to_pivot = (
        lists.filter((c("rep") != c("p_rep")) & may(c("n"), c("pos"), c("p_n"), c("p_pos")))
        .groupBy("rep", "p_rep", "n", "p_n")
        .agg(F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .groupBy("rep")
        .agg(F.max(F.struct("m", -c("p_rep"), "n", "p_n")).alias("x"))
        .select(c("rep").alias("b"), (-c("x.col2")).alias("a"), c("x.n").alias("nb"), c("x.p_n").alias("na"))
    )
    to_pivot = cut(to_pivot, "jj-pivots")
    answers = to_pivot.join(_overlaps(to_pivot.select("a", "b"), docs, k, num, den, True), ["a", "b"])
    answers = cut(answers.select("a", "b", "na", (c("na") + c("nb") - 2 * c("overlap")).alias("d"), "more", "less"), "jj-answers")
    discard(to_pivot)
    links = answers.filter("more is not null").select("a", "b")
    first = cut(components(links, "jj-first"), "jj-first-done")

    nothing = F.array().cast("array<bigint>")
    known = answers.select(c("b").alias("rep"), c("a").alias("q"), c("na").alias("nq"), "d", "more", "less").union(
        answers.select(c("a").alias("rep"), c("a").alias("q"), c("na").alias("nq"), F.lit(0).cast("long").alias("d"), nothing, nothing).distinct()
    )
    known = cut(known.groupBy("rep").agg(F.min(F.struct("d", "q", "nq", "more", "less")).alias("z")).select("rep", "z.*"), "jj-known")
    comp = first.select(c("id").alias("rep"), "component")
    p_comp = first.select(c("id").alias("p_rep"), c("component").alias("p_component"))
    told = known.select("rep", "q", "d", c("more").isNotNull().alias("near"))
    entries = (
        lists.join(comp, "rep", "left").join(p_comp, "p_rep", "left").join(told, "rep", "left")
        .select("token", "rep", "n", "pos", "q", "d", "near", F.coalesce("component", "rep").alias("comp"), F.coalesce("p_component", "p_rep").alias("major"))
    )
    entries = cut(entries.withColumn("minor", c("comp") != c("major")), "jj-relations")
    discard(lists)

    def size_block(n):
        return F.floor(2 * F.log(n.cast("double")) / float(np.log(den / num))).cast("int")

    reach = F.least(F.floor((num + den) * (c("n") - c("pos") + 1) / num) - c("n"), F.floor(c("n") * den / num))
    lowest = F.ceil(c("n") * num / den)
    blocks = F.when(reach >= lowest, F.sequence(size_block(lowest), size_block(reach)))
    columns = ("rep", "n", "pos", "q", "d", "near", "comp")
    x = entries.select("token", size_block(c("n")).alias("block"), c("minor").alias("x_minor"), *[c(n).alias(f"x_{n}") for n in columns])
    y = entries.filter("minor").select("token", F.explode(blocks).alias("block"), *[c(n).alias(f"y_{n}") for n in columns])
    bound = num * (c("x_n") + c("y_n"))
    same = F.coalesce(c("x_q") == c("y_q"), F.lit(False))
    sure = same & ((num + den) * (c("x_n") + c("y_n") - c("x_d") - c("y_d")) >= 2 * bound)
    never = same & ((num + den) * (c("x_n") + c("y_n") - F.abs(c("x_d") - c("y_d"))) < 2 * bound)
    how = F.when(sure, "sure").when(same & c("x_near") & c("y_near"), "derive").otherwise("texts")
    open_ = (
        x.join(y, ["token", "block"])
        .filter((c("x_comp") != c("y_comp")) & (~c("x_minor") | (c("x_rep") < c("y_rep"))))
        .filter(may(c("x_n"), c("x_pos"), c("y_n"), c("y_pos")) & ~never)
        .select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"), (c("x_n") + c("y_n")).alias("ns"), how.alias("how"))
        .groupBy("a", "b", "ns", "how")
        .agg(F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .select("a", "b", "ns", "how")
    )
    open_ = cut(open_, "jj-open")
    discard(entries)
    linked = (num + den) * c("overlap") >= num * c("ns")
    asked = open_.filter("how = 'texts'")
    got = asked.join(_overlaps(asked.select("a", "b"), docs, k, num, den), ["a", "b"]).filter(linked)
    side = lambda i: known.select(c("rep").alias(i), "nq", c("more").alias(f"more_{i}"), c("less").alias(f"less_{i}")).hint("merge")
    overlap = c("nq") - F.size(F.array_union("less_a", "less_b")) + F.size(F.array_intersect("more_a", "more_b"))
    derived = open_.filter("how = 'derive'").join(side("a"), "a").join(side("b").drop("nq"), "b").withColumn("overlap", overlap).filter(linked)
    rest = open_.filter("how = 'sure'").select("a", "b").union(got.select("a", "b")).union(derived.select("a", "b"))
    rest = cut(rest, "jj-late-links")
    final = first
    if rest.limit(1).count():
        final = components(links.union(rest), "jj-final")

    reps = classes.select("key", "rep").join(final.select(c("id").alias("rep"), "component"), "rep", "left")
    reps = reps.select("key", F.coalesce("component", "rep").alias("component"))
    return members.select("doc_id", "n", "key").join(reps, "key", "left").select(
        "doc_id",
        c("n").alias("n_shingles"),
        F.when(c("n") > 0, F.coalesce("component", "doc_id")).otherwise(c("doc_id")).alias("component_id"),
    )
