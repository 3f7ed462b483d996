"""Ranked lexical search: every item's best documents, by branch and bound over document FP-trees.

1. Documents are reduced to the terms that items hold: a vector of (term, occurrences) and the number of all terms.
2. Terms are ordered by how many documents hold them, most frequent first. The vectors of a block of documents, sorted in that
   order, share their beginnings: an FP-tree, whose nodes are stretches of the sorted block. A stretch of at most LEAF
   documents isn't parted further, and small neighbours under one node share a leaf.
3. Every node knows, for each term of its subtree, the greatest occurrence, and the least m. What a term adds grows with its
   occurrences and falls with m, in whole numbers too, so these give a bound of all scores in the subtree.
4. An item goes down the tree depth first, most promising child first, and leaves out subtrees whose bound is below its
   50th score so far (a bound equal to it is followed, as ties go to the smaller id). Documents of leaves that are reached are
   scored exactly. A block's best documents of each item are merged over all blocks.

Each task cuts the rows it reads into blocks of BLOCK documents, or WIDE vector entries, so its memory doesn't depend on the
table. Items are dealt into shards of about TERMS terms; each shard is broadcast and is one more pass over the documents, but
document frequencies, the number of documents and of terms are always those of all documents.

Defined cases: null and empty texts have no term, count as no document and are found by nothing; an item without terms finds
nothing; a repeated item is an item of its own; rows that share an id are documents of their own; a row without an id comes before others of equal
score; texts are read whole; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

TERMS = 500_000
BLOCK, WIDE = 8_192, 2_000_000
LEAF = 16
NO_ID = -(1 << 63)
#: ASCII letters and digits, and all bytes above, are parts of terms; A-Z lower-cased.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


def vectors(docs: DataFrame, shared) -> DataFrame:
    """Documents with terms: id, n, and the numbers (shared: those of the items' terms) and occurrences of their terms."""

    def run(batches):
        number = {t: k for k, t in enumerate(shared.value)}
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = terms(t.as_py())
                if words:
                    held = np.fromiter((k for k in map(number.get, words) if k is not None), np.int64)
                    at, tf = np.unique(held, return_counts=True)
                    rows.append((i, len(words), at.astype(np.int32).tobytes(), tf.astype(np.int64).tobytes()))
            i, n, at, tf = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], ["id", "n", "at", "tf"]
            )

    return docs.mapInArrow(run, "id long, n long, at binary, tf binary")


def frequencies(vecs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term number."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                n[np.frombuffer(x.as_buffer(), np.int32)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["k", "n"])

    out = np.zeros(size, np.int64)
    for r in vecs.select("at").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.k] = r.n
    return out


def gained(weight, tf, m):
    """What terms add to a score, in whole numbers."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Tree:
    """The FP-tree of a block: terms are numbers in order of frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, at: list[np.ndarray], tf: list[np.ndarray]):
        ordered = [np.argsort(a, kind="stable") for a in at]
        at, tf = [a[o] for a, o in zip(at, ordered)], [x[o] for x, o in zip(tf, ordered)]
        keys = [a.astype(">u4").tobytes() for a in at]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.ids, self.m = ids[order], m[order]
        self.size = np.array([len(at[k]) for k in order], np.int64)
        self.start = np.append(0, np.cumsum(self.size))
        self.at = np.concatenate([at[k] for k in order]) if order else np.zeros(0, np.int64)
        self.tf = np.concatenate([tf[k] for k in order]) if order else np.zeros(0, np.int64)
        self._grow()
        self._maxima()

    def _shared(self, lo: int, hi: int, depth: int) -> int:
        """How many terms the first and the last, and so all vectors of a stretch have in common."""
        a, b = (self.at[self.start[k] : self.start[k + 1]] for k in (lo, hi - 1))
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:n] != b[depth:n])
        return depth + int(differ[0]) if len(differ) else n

    def _grow(self) -> None:
        self.lo, self.hi, self.below = [0], [len(self.ids)], [[]]
        open_ = [(0, 0)]
        while open_:
            node, depth = open_.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF:
                continue
            depth = self._shared(lo, hi, depth)
            where = np.arange(lo, hi)
            ends = self.size[lo:hi] <= depth
            if ends.all():
                continue
            term = np.where(ends, -1, self.at[np.minimum(self.start[where] + depth, len(self.at) - 1)])
            edges = np.append(np.flatnonzero(np.diff(term, prepend=-2)), hi - lo)
            left = edges[0]
            for a, b in zip(edges[:-1], edges[1:]):
                if b - left > LEAF and a > left:
                    self._child(node, lo + left, lo + a)
                    left = a
                if b - a > LEAF:
                    self._child(node, lo + a, lo + b)
                    open_.append((self.below[node][-1], depth))
                    left = b
            if left < hi - lo:
                self._child(node, lo + left, hi)

    def _child(self, node: int, lo: int, hi: int) -> None:
        self.below[node].append(len(self.lo))
        self.lo.append(int(lo))
        self.hi.append(int(hi))
        self.below.append([])

    def _maxima(self) -> None:
        """Least m of each node, and by term the nodes that hold it with its greatest occurrence there."""
        self.least = np.array([self.m[a:b].min(initial=1 << 40) for a, b in zip(self.lo, self.hi)], np.int64)
        found = [None] * len(self.lo)
        for node in range(len(self.lo) - 1, -1, -1):
            if self.below[node]:
                at, tf = (np.concatenate([found[k][i] for k in self.below[node]]) for i in (0, 1))
            else:
                a, b = self.start[self.lo[node]], self.start[self.hi[node]]
                at, tf = self.at[a:b], self.tf[a:b]
            order = np.argsort(at, kind="stable")
            at, tf = at[order], tf[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            found[node] = (at[first], np.maximum.reduceat(tf, first) if len(first) else tf)
        term = np.concatenate([x[0] for x in found])
        node = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        top = np.concatenate([x[1] for x in found])
        order = np.argsort(term, kind="stable")
        self.term, self.node, self.top = term[order], node[order], top[order]

    def bounds(self, item: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each node the greatest score its documents can have."""
        out = np.zeros(len(self.lo), np.int64)
        lo, hi = np.searchsorted(self.term, item), np.searchsorted(self.term, item, "right")
        for a, b, w in zip(lo, hi, weight):
            node = self.node[a:b]
            out[node] += gained(w, self.top[a:b], self.least[node])
        return out

    def scores(self, lo: int, hi: int, item: np.ndarray, weight: np.ndarray) -> np.ndarray:
        a, b = self.start[lo], self.start[hi]
        at, tf = self.at[a:b], self.tf[a:b]
        k = np.minimum(np.searchsorted(item, at), len(item) - 1)
        has = np.flatnonzero(item[k] == at)
        doc = np.searchsorted(self.start[lo : hi + 1] - a, has, "right") - 1
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, doc, gained(weight[k[has]], tf[has], self.m[lo + doc]))
        return out

    def best(self, item: np.ndarray, weight: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first documents of an item (sorted term numbers), by score and id."""
        if not len(item) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = self.bounds(item, weight)
        ids, scores, least, pending = [], [], 1, 0
        open_ = [0]
        while open_:
            node = open_.pop()
            if bound[node] < least:
                continue
            if self.below[node]:
                open_.extend(sorted(self.below[node], key=bound.__getitem__))
                continue
            lo, hi = self.lo[node], self.hi[node]
            said = self.scores(lo, hi, item, weight)
            has = said >= least
            ids.append(self.ids[lo:hi][has])
            scores.append(said[has])
            pending += len(ids[-1])
            if pending >= top:
                i, s = np.concatenate(ids), np.concatenate(scores)
                first = np.lexsort((i, -s))[:top]
                ids, scores, pending = [i[first]], [s[first]], 0
                if len(first) == top:
                    least = int(scores[0][-1])
        i, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, scores))
        first = np.lexsort((i, -s))[:top]
        return i[first], s[first]


def _blocks(batches):
    """Rows of vectors in blocks: ids, n, term numbers, occurrences."""
    rows, wide = [], 0
    for b in batches:
        for i, n, at, tf in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
            rows.append((NO_ID if i is None else i, n, np.frombuffer(at.as_py(), np.int32), np.frombuffer(tf.as_py(), np.int64)))
            wide += len(rows[-1][2])
            if len(rows) >= BLOCK or wide >= WIDE:
                yield zip(*rows)
                rows, wide = [], 0
    if rows:
        yield zip(*rows)


def _searched(shared, top: int):
    def run(batches):
        said = shared.value
        for ids, n, at, tf in _blocks(batches):
            m = 50 + 50 * np.array(n, np.int64) * said["docs"] // said["terms"]
            tree = Tree(np.array(ids, np.int64), m, [said["order"][a] for a in at], list(tf))
            items, docs, scores = [], [], []
            for number, item, weight in said["items"]:
                i, s = tree.best(item, weight, top)
                items.append(np.full(len(i), number))
                docs.append(i)
                scores.append(s)
            item, doc, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, docs, scores))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(score, pa.int64())], ["number", "doc_id", "score"])

    return run


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: for each of items (item_id, text) the first documents of docs (doc_id, text)."""
    c = F.col
    sc = docs.sparkSession.sparkContext
    docs = docs.select(c("doc_id").cast("long").alias("id"), c("text").cast("binary").alias("text"))

    def asked(batches):
        for b in batches:
            words = [sorted(set(terms(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.binary()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", c("text").cast("binary").alias("text")).mapInArrow(asked, f"item_id {kind}, terms array<binary>")
    items = cut(items.withColumn("number", F.monotonically_increasing_id()), "rs-items")
    size = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    shards = max(1, -(-size // TERMS))
    found = None
    for shard in range(shards):
        mine = items.filter(F.pmod(F.xxhash64("number"), F.lit(shards)) == shard)
        rows = [(r.number, [bytes(t) for t in r.terms]) for r in mine.select("number", "terms").toLocalIterator()]
        vocabulary = sorted({t for _, words in rows for t in words})
        shared = sc.broadcast(vocabulary)
        vecs = cut(vectors(docs, shared), "rs-vectors")
        shared.destroy()
        total = vecs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = frequencies(vecs, len(vocabulary))
        order = np.empty(len(vocabulary), np.int64)
        order[np.lexsort((np.arange(len(vocabulary)), -df))] = np.arange(len(vocabulary))
        number = {t: k for k, t in enumerate(vocabulary)}
        weights = np.array([weight(total.docs, int(d)) for d in df], np.int64)
        asked_for = []
        for i, words in sorted(rows):
            k = np.array([number[t] for t in words], np.int64)
            k = k[np.argsort(order[k])] if len(k) else k
            asked_for.append((i, order[k], weights[k]))
        shared = sc.broadcast({"items": asked_for, "order": order, "docs": total.docs, "terms": max(1, total.terms)})
        here = cut(vecs.mapInArrow(_searched(shared, top), "number long, doc_id long, score long"), "rs-found")
        shared.destroy()
        discard(vecs)
        found = here if found is None else found.union(here)
    place = Window.partitionBy("number").orderBy(c("score").desc(), c("doc_id").asc_nulls_first())
    best = found.withColumn("rank", F.row_number().over(place)).filter(c("rank") <= top)
    return best.join(items.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
