"""Benchmark decontamination: BM25 over test items, asked with every training passage.

Each test item is a BM25 document; each window of a training text is a query, and all items that reach a share THETA of
their own full score are retrieved. Windows follow the item: items of up to MIN_WINDOW words, of up to twice as many, and so
on are classes with lists of their own, and a text is cut anew for each class that occurs, so that what is said of an item
never depends on how long others are. Scores are divided by the item's full score, so one threshold serves all. An item's
terms of least weight that can't reach THETA together have no postings: an item is worth looking at only when the others
bring what those leave open, so a posting's weight is its part of that need and the threshold of all items is 1.

Retrieval is block-max WAND: cursors of a passage's lists in order of their next item; the pivot is the first item whose
lists' greatest weights reach 1; it is scored only if the greatest weights of the blocks around it reach 1 too, else all
cursors jump past the nearest block's end. No item at or above THETA can be lost. Retrieved items are verified: both the
question part (up to the first question mark, else the first half) and the answer part must share enough word trigrams
with the passage. A part of one or two words must occur as a word sequence; so must an item of two or three words without
a question mark, as a whole, since its halves would be single words. An item of one word is held by every passage with
that word.

Document frequencies, the number of items and their mean length are counted by Spark over all items. The
index is built in tasks, in shards of about SHARD_WORDS words by a hash of the item's number, so weights don't depend on
the shard. Each shard is one pass over the documents and the only one in memory at a time.

Defined cases: a null or empty text has no passage and is clean; null or empty items match nothing; an item
without an id is reported as -1; repeated items each count, and are reported once; texts of any length are read whole in
windows that overlap by the class's length, of which n_passages counts those of the first class; rows without an id and repeated rows are judged one by one; an empty table gives
an empty table; other columns pass through.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard

K1, B = 1.2, 0.75
THETA = 0.6
MIN_OVERLAP = 0.5
BLOCK = 64
MIN_WINDOW = 64
SHARD_WORDS = 2_000_000
NEVER = 1 << 60
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _grams(tokens: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def _part(tokens: list[str]) -> tuple[int, set[tuple[str, ...]]]:
    """Words a gram, 3 or all of a shorter part, and the part's grams."""
    n = min(3, len(tokens))
    return n, _grams(tokens, n)


def window(size: int) -> int:
    """Words a step of the passages in which an item of this size is looked for; a passage has twice as many."""
    step = MIN_WINDOW
    while step < size:
        step *= 2
    return step


def _passages(words: int, step: int) -> int:
    return max(1, -(-(words - step) // step))


class Index:
    """Items (id, text) of one shard with their postings; statistics of all items, or of these where none are given."""

    def __init__(self, items: list[tuple[object, str | None]], stats: dict | None = None):
        kept = [(i, t, terms(t)) for i, t in items]
        kept = [x for x in kept if x[2]]
        self.ids = [-1 if x[0] is None else int(x[0]) for x in kept]
        if stats is None:
            sizes = [len(x[2]) for x in kept]
            stats = {"n": len(kept), "mean": sum(sizes) / max(1, len(kept))}
            stats["df"] = Counter(w for x in kept for w in set(x[2]))
        n, df = stats["n"], stats["df"]
        self.weights: list[dict[str, float]] = []
        self.parts: list[list[tuple[int, set]]] = []
        #: Window: term: items and weights.
        classes: dict[int, dict[str, tuple[list[int], list[float]]]] = {}
        for k, (_, text, words) in enumerate(kept):
            tf = Counter(words)
            norm = K1 * (1 - B + B * len(words) / stats["mean"])
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in tf.items()}
            full = sum(w.values())
            w = {t: x / full for t, x in w.items()}
            self.weights.append(w)
            ranked = sorted(w.items(), key=lambda p: (p[1], p[0]))
            easy = at = 0
            while at < len(ranked) and easy + ranked[at][1] < THETA - 1e-9:
                easy += ranked[at][1]
                at += 1
            posts = classes.setdefault(window(len(words)), {})
            for t, x in ranked[at:]:
                items_of, weights_of = posts.setdefault(t, ([], []))
                items_of.append(k)
                weights_of.append(x / (THETA - easy))
            q = terms(text[: text.find("?") + 1]) if "?" in text else words[: len(words) // 2 if len(words) > 3 else 0]
            self.parts.append([_part(q), _part(words[len(q) :])])
        #: Window: term: greatest weight, items, weights, and greatest weight of each block.
        self.classes = {
            size: {t: (max(x), k, x, [max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]) for t, (k, x) in posts.items()}
            for size, posts in sorted(classes.items())
        }

    def retrieve(self, posts: dict, present: set[str], hits: set[str]) -> list[tuple[int, float]]:
        """Items of a class at or above THETA for a passage; present: its terms, hits: those with postings."""
        enough = 1 - 1e-7
        lists = [posts[t] for t in hits]
        if sum(x[0] for x in lists) < enough:
            return []
        #: Next item, position, list: the number only keeps the order total.
        cursors = sorted([x[1][0], 0, n, x] for n, x in enumerate(lists))
        out = []
        while cursors:
            bound, last = 0.0, -1
            for j, c in enumerate(cursors):
                bound += c[3][0]
                if bound >= enough:
                    last = j
                    break
            if last < 0:
                break
            pivot = cursors[last][0]
            while last + 1 < len(cursors) and cursors[last + 1][0] == pivot:
                last += 1
            ahead = cursors[: last + 1]
            bound, end = 0.0, cursors[last + 1][0] if last + 1 < len(cursors) else NEVER
            for _, at, _, (_, items, _, tops) in ahead:
                at = bisect_left(items, pivot, at)
                if at < len(items):
                    block = at // BLOCK
                    bound += tops[block]
                    end = min(end, items[min((block + 1) * BLOCK, len(items)) - 1] + 1)
            if bound < enough:
                goal = end
            elif cursors[0][0] == pivot:
                if sum(c[3][2][c[1]] for c in ahead) >= enough:
                    score = sum(w for t, w in self.weights[pivot].items() if t in present)
                    if score >= THETA - 1e-9:
                        out.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            for c in ahead:
                if c[0] < goal:
                    c[1] = at = bisect_left(c[3][1], goal, c[1])
                    c[0] = c[3][1][at] if at < len(c[3][1]) else NEVER
            cursors = sorted(c for c in cursors if c[0] < NEVER)
        return out

    def leaks(self, text: str | None) -> tuple[int, list[tuple[object, float]]]:
        """Number of passages, and (item id, best score) of the items verified in one of them."""
        words = terms(text)
        if not words:
            return 0, []
        found: dict[object, float] = {}
        for step, posts in self.classes.items():
            self._leaks(words, step, posts, found)
        return _passages(len(words), MIN_WINDOW), sorted(found.items())

    def _leaks(self, words: list[str], step: int, posts: dict, found: dict) -> None:
        passages = _passages(len(words), step)
        seen: dict[int, set[str]] = {}
        for i in [i for i, w in enumerate(words) if w in posts]:
            k = i // step
            seen.setdefault(min(k, passages - 1), set()).add(words[i])
            if k:
                seen.setdefault(k - 1, set()).add(words[i])
        for k, hits in seen.items():
            part = words[k * step : (k + 2) * step]
            got = self.retrieve(posts, set(part), hits)
            if not got:
                continue
            here = {n: _grams(part, n) for n in {n for item, _ in got for n, _ in self.parts[item]}}
            for item, score in got:
                if all(not g or len(g & here[n]) >= MIN_OVERLAP * len(g) for n, g in self.parts[item]):
                    i = self.ids[item]
                    found[i] = max(found.get(i, 0.0), score)


def shards(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """The index in shards (shard, index: a pickled Index), built in tasks and written, and the number of shards."""
    c = F.col
    items = benchmark.select(c(key).cast("long").alias("id"), c(text).alias("text")).filter("text is not null")

    def tokenised(batches):
        for b in batches:
            yield b.assign(words=[terms(t) for t in b["text"]])

    items = items.mapInPandas(tokenised, "id long, text string, words array<string>").filter(F.size("words") > 0)
    items = cut(items.withColumn("number", F.monotonically_increasing_id()), "bm-items")
    size = F.size("words").cast("long")
    said = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("words")).first()
    count = max(1, -(-said.words // SHARD_WORDS))
    stats = {"n": said.n, "mean": said.words / max(1, said.n)}
    held = items.select("number", F.explode(F.array_distinct("words")).alias("term"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    told = held.join(df, "term").groupBy("number").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    dealt = items.join(told, "number").select(F.pmod(F.xxhash64("number"), F.lit(count)).alias("shard"), "number", "id", "text", "terms")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        frequencies = {x["term"]: x["df"] for row in pdf["terms"] for x in row}
        ids = [None if pd.isna(i) else int(i) for i in pdf["id"]]
        index = Index(list(zip(ids, pdf["text"])), {**stats, "df": frequencies})
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "index": [pickle.dumps(index)]})

    out = cut(dealt.groupBy("shard").applyInPandas(build, "shard long, index binary"), "bm-shards")
    discard(items)
    return out, count


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Add n_passages, leaked_items (sorted ids) and contaminated to docs, whose text is in ``text``."""
    added = [("n_passages", T.LongType()), ("leaked_items", T.ArrayType(T.LongType())), ("contaminated", T.BooleanType())]
    sc = docs.sparkSession.sparkContext
    names = [f.name for f in docs.schema.fields if f.name not in {n for n, _ in added}]
    schema = T.StructType([*(docs.schema[n] for n in names), *(T.StructField(n, t) for n, t in added)])
    built, count = shards(benchmark, key, text)
    out, shared = docs, None
    for number in range(count):
        if number:
            out = cut(out, "bm-judged")
            shared.unpersist()
        row = built.filter(F.col("shard") == number).select("index").first()
        shared = sc.broadcast(row["index"] if row else pickle.dumps(Index([])))

        def run(batches, shared=shared, again=bool(number)):
            index = pickle.loads(shared.value)
            for whole in batches:
                for at in range(0, max(1, len(whole)), 1024):
                    b = whole.iloc[at : at + 1024]
                    said = [index.leaks(t) for t in b["text"]]
                    passages = [x[0] for x in said]
                    ids = [[int(i) for i, _ in x[1]] for x in said]
                    if again:
                        passages = [max(p, q) for p, q in zip(passages, b["n_passages"])]
                        ids = [sorted({*i, *j}) for i, j in zip(ids, b["leaked_items"])]
                    yield b[names].assign(
                        n_passages=pd.Series(passages, index=b.index, dtype="int64"),
                        leaked_items=pd.Series(ids, index=b.index, dtype=object),
                        contaminated=pd.Series([bool(i) for i in ids], index=b.index, dtype=bool),
                    )

        out = out.mapInPandas(run, schema)
    return out


def op3_columns(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "n_passages", F.array_join("leaked_items", ",").alias("leaked_items"), "contaminated")
