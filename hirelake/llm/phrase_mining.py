"""Phrase collocation mining: level-wise counts by broadcast double-array tries, and cut scores.

1. Words are counted a language (one shuffle of each task's counts). Texts become sequences of the numbers of frequent words;
   a break or a word that isn't frequent is 0, runs of 0 are one.
2. At each level the sequence holds the frequent phrases of k words that start at each place. A phrase of k + 1 words is
   Apriori-safe where two neighbours are both there, so a candidate is a pair of numbers: the phrase it extends and the one
   that starts a word later, which stands for the word added. Pairs are first counted in 2 ** BUCKETS_LOG2 hash buckets (a
   byte a bucket, counts end at the least count); only pairs of a bucket that reaches it are candidates.
3. Candidates become double arrays: from the node of the shorter phrase, base plus the label's code is the slot of the
   longer one, if check names that node. A trie of at most TRIE candidates is built in a task and broadcast; every task moves
   the states of all places of its texts one level at once, bincounts the slots reached, and the tasks' counts are summed.
4. A last look-up per level writes the sequence of the longer phrases, which is shorter at every level.

A corpus of more than PAIRS places is counted in several rounds, each with the candidates of one part of the hashes; more
candidates than TRIE are several tries. Either costs further passes over the written sequences (4 bytes a word), never more
memory, so the number of passes grows with the corpus while nothing broadcast does. Words are sent to the tasks in shards of
WORDS likewise.

Defined cases: a null language is ``und``; null and empty texts have no words; texts are read whole; repeated rows count as
often as they occur; rows without an id count like others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

BUCKETS_LOG2 = 24
#: Buckets a row of counts on the way between tasks.
CHUNK = 1 << 16
#: Neighbouring places that one round of buckets counts: 18 a bucket, so that only buckets with a frequent pair reach 100.
PAIRS = 300_000_000
TRIE = 2_000_000
WORDS = 500_000
#: Numbers that a task works on at a time, and a row of a written sequence: readers hold some thousands of rows at once, so rows of
#: 4 kB bound them at 16 MB. Places a task (128 MB), as every task sends its own counts of all candidates.
STEP = 1 << 18
ROW = 1 << 10
TASK = 1 << 25
SALT = 32
BREAK = b"\n"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" ")


def pieces(text: bytes | None) -> list[bytes]:
    """A text's words, and BREAK between and after pieces."""
    told = ((text or b"") + BREAK).translate(_LOWER).replace(BREAK, b" " + BREAK + b" ")
    return [w for w in told.split(b" ") if w]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of docs (lang, text: binary)."""

    def run(batches):
        held: dict = {}

        def told():
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items() if w != BREAK]
            held.clear()
            columns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "f"])

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(lang, Counter()).update(pieces(t.as_py()))
                if sum(map(len, held.values())) > 250_000:
                    yield told()
        yield told()

    return docs.mapInArrow(run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df written with an id for each row, from 1 and without gaps: a row's place in its part after the parts before."""
    placed = cut(df.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    if sum(r[1] for r in sizes) >= 1 << 32:
        raise ValueError("more than 2 ** 32 frequent phrases of one length")
    starts, at = [], 1
    for r in sizes:
        starts.append((r[0], at))
        at += r[1]
    first = df.sparkSession.createDataFrame(starts, "_part long, _first long")
    out = placed.join(F.broadcast(first), part == F.col("_part")).withColumn("id", F.col("_place").bitwiseAND((1 << 33) - 1) + F.col("_first"))
    return out.drop("_place", "_part", "_first")


def encoded(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Texts as sequences (numbers: 32-bit, binary) of the ids in words (lang, word, id)."""
    sc = docs.sparkSession.sparkContext
    shards = max(1, -(-words.count() // WORDS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for lang, word, i in zip(pdf["lang"], pdf["word"], pdf["id"]):
            held.setdefault(lang, {})[bytes(word)] = int(i)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "data": [pickle.dumps(held)]})

    dealt = words.withColumn("shard", F.pmod(F.xxhash64("lang", "word"), F.lit(shards)))
    built = cut(dealt.groupBy("shard").applyInPandas(build, "shard long, data binary"), "pm-words")
    out = docs
    for shard in range(shards):
        row = built.filter(F.col("shard") == shard).select("data").first()
        shared, last = sc.broadcast(row["data"] if row else pickle.dumps({})), shard + 1 == shards

        def numbers(batches, shared=shared, more=bool(shard)):
            of = pickle.loads(shared.value)
            for b in batches:
                olds = b.column(2) if more else [None] * b.num_rows
                for lang, t, old in zip(b.column(0).to_pylist(), b.column(1), olds):
                    known = of.get(lang, {})
                    x = np.fromiter((known.get(w, 0) for w in pieces(t.as_py())), np.uint32)
                    yield lang, t, x if old is None else x | np.frombuffer(old.as_py(), np.uint32)

        def kept(batches, numbers=numbers):
            for lang, t, x in numbers(batches):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([t.as_py()], pa.binary()), pa.array([x.tobytes()])], ["lang", "text", "numbers"])

        def packed(batches, numbers=numbers):
            yield from _written(x for _, _, x in numbers(batches))

        before = out
        out = cut(out.mapInArrow(packed, "numbers binary") if last else out.mapInArrow(kept, "lang string, text binary, numbers binary"), "pm-texts")
        if shard:
            discard(before)
        shared.destroy()
    discard(built)
    return out


def _written(sequences):
    """Sequences that end in 0 as rows of about ROW numbers, cut at a 0 and sent STEP numbers at a time, runs of 0 cut to one."""
    held, size = [], 0

    def told():
        x = np.concatenate(held) if held else np.zeros(0, np.uint32)
        stays = x != 0
        stays[1:] |= x[:-1] != 0
        x = x[stays]
        cuts = np.flatnonzero(x == 0) + 1
        ends = np.unique(np.append(0, cuts[np.searchsorted(cuts, np.arange(ROW, len(x) + ROW, ROW)).clip(max=len(cuts) - 1)])) if len(cuts) else [0]
        return _batch(numbers=_rows(x, np.asarray(ends, np.int64) * 4))

    for x in sequences:
        held.append(x)
        size += len(x)
        if size > STEP:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def _rows(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers as a column of rows that end at these bytes, the first of which is 0."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _steps(batches):
    """Parts of batches of sequences, each of about STEP numbers."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(0)).to_numpy() // 4)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _numbers(column: pa.Array) -> np.ndarray:
    """The sequences of a column one after the other, as each ends in 0."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint32, (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.uint32)


def _sequences(batches):
    for b in _steps(batches):
        yield _numbers(b.column(0))


def _pairs(x: np.ndarray) -> np.ndarray:
    """Neighbours that are both there, as one number each."""
    at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
    return x[at].astype(np.uint64) << np.uint64(32) | x[at + 1]


def _hashes(pairs: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and round of each pair."""
    h = (pairs ^ pairs >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), h % np.uint64(rounds)


def full_buckets(texts: DataFrame, least: int, this: int, rounds: int) -> np.ndarray:
    """A bit for each bucket of this round: whether its pairs reach the least count together."""
    kind = np.min_scalar_type(least)

    def run(batches):
        held = np.zeros(1 << BUCKETS_LOG2, kind)
        for x in _sequences(batches):
            bucket, r = _hashes(_pairs(x), rounds)
            at, n = np.unique(bucket[r == this], return_counts=True)
            held[at] = np.minimum(held[at] + n, least)
        at = [k for k in range(0, len(held), CHUNK) if held[k : k + CHUNK].any()]
        yield _batch(chunk=pa.array(at, pa.int64()), data=pa.array([held[k : k + CHUNK].tobytes() for k in at], pa.binary()))

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1)):
                held[k] = held.get(k, 0) + np.frombuffer(counts.as_buffer(), kind).astype(np.int64)
        yield _batch(chunk=pa.array(held, pa.int64()), data=pa.array([np.packbits(x >= least).tobytes() for x in held.values()], pa.binary()))

    told = texts.mapInArrow(run, "chunk long, data binary").repartition("chunk").mapInArrow(summed, "chunk long, data binary")
    out = np.zeros(1 << BUCKETS_LOG2, bool)
    for r in told.toLocalIterator():
        out[r.chunk : r.chunk + CHUNK] = np.unpackbits(np.frombuffer(r.data, np.uint8))
    return np.packbits(out)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def candidates(texts: DataFrame, least: int, this: int, rounds: int) -> DataFrame:
    """s, t: the Apriori-safe pairs of this round whose bucket is full."""
    shared = texts.sparkSession.sparkContext.broadcast(full_buckets(texts, least, this, rounds))

    def run(batches):
        bits = shared.value
        held, loose, size = np.zeros(0, np.uint64), [], 0
        for x in _sequences(batches):
            pairs = _pairs(x)
            bucket, r = _hashes(pairs, rounds)
            loose.append(np.unique(pairs[(r == this) & (bits[bucket >> 3] >> (7 - (bucket & 7)) & 1).astype(bool)]))
            size += len(loose[-1])
            if size > 2_000_000:
                held, loose, size = np.unique(np.concatenate([held, *loose])), [], 0
        held = np.unique(np.concatenate([held, *loose]))
        for lo in range(0, len(held), 1 << 16):
            x = held[lo : lo + (1 << 16)]
            yield _batch(s=pa.array((x >> np.uint64(32)).astype(np.int64)), t=pa.array((x & np.uint64(0xFFFFFFFF)).astype(np.int64)))

    return texts.mapInArrow(run, "s long, t long").distinct()


class Trie:
    """A level of a double-array trie: nodes s, edges labelled t; codes number the labels that this trie knows."""

    def __init__(self, s: np.ndarray, t: np.ndarray, ids: np.ndarray | None = None):
        self.nodes, node = np.unique(s, return_inverse=True)
        self.labels, code = np.unique(t, return_inverse=True)
        order = np.lexsort((code, node))
        node, code = node[order], code[order]
        first = np.searchsorted(node, np.arange(len(self.nodes) + 1))
        fan = np.diff(first)
        self.base = np.zeros(len(self.nodes), np.int64)
        self.check = np.full(len(self.labels) + 2 * len(s) + 1, -1, np.int64)
        low = 0
        for n in np.argsort(-fan, kind="stable")[: np.count_nonzero(fan > 1)]:
            codes = code[first[n] : first[n + 1]]
            self.base[n], low = self._room(codes, low)
            self.check[self.base[n] + codes] = n
        one = np.flatnonzero(fan == 1)
        free = np.flatnonzero(self.check < 0)
        if len(free) < len(one):
            grown = np.arange(len(self.check), len(self.check) + len(one))
            self.check, free = np.append(self.check, np.full(len(one), -1)), np.append(free, grown)
        slots = free[: len(one)]
        self.base[one], self.check[slots] = slots - code[first[one]], one
        self.check = self.check[: np.flatnonzero(self.check >= 0).max(initial=-1) + 1]
        self.ids = np.zeros(len(self.check), np.uint32)
        self.ids[self.base[node] + code] = 0 if ids is None else ids[order]

    def _room(self, codes: np.ndarray, low: int) -> tuple[int, int]:
        """A base at which all codes' slots are free, and where the next search starts: a stretch that failed is left."""
        step = max(64, 65_536 // len(codes))
        while True:
            if low + step + codes[-1] >= len(self.check):
                self.check = np.append(self.check, np.full(len(self.check) + step + int(codes[-1]), -1, np.int64))
            bases = low + np.flatnonzero(self.check[low + codes[0] : low + codes[0] + step] < 0)
            fits = (self.check[bases[:, None] + codes[None, :]] < 0).all(axis=1) if len(bases) else np.zeros(0, bool)
            if fits.any():
                return int(bases[np.argmax(fits)]), low
            low += step

    def reached(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a sequence from which a step exists, and the slots it leads to: all states move at once."""
        if not len(self.check):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
        node = np.minimum(np.searchsorted(self.nodes, x[at]), len(self.nodes) - 1)
        has = self.nodes[node] == x[at]
        at, node = at[has], node[has]
        code = np.minimum(np.searchsorted(self.labels, x[at + 1]), len(self.labels) - 1)
        has = self.labels[code] == x[at + 1]
        at, node, code = at[has], node[has], code[has]
        slot = self.base[node] + code
        has = (slot >= 0) & (slot < len(self.check))
        has[has] = self.check[slot[has]] == node[has]
        return at[has], slot[has]


def tries(pairs: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """Tries (shard, data) of a written table with s, t (and id), each of about TRIE pairs dealt by their node, hot nodes
    by their labels too."""
    count = max(1, -(-pairs.count() // TRIE))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy() if "id" in pdf else None
        data = pickle.dumps(Trie(pdf["s"].to_numpy().astype(np.uint32), pdf["t"].to_numpy().astype(np.uint32), ids))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "data": [data]})

    dealt = pairs.select(*columns, F.pmod(F.xxhash64("s", "t"), F.lit(count)).alias("shard"))
    return cut(dealt.groupBy("shard").applyInPandas(build, "shard long, data binary"), "pm-tries"), count


def _each(built: DataFrame, count: int):
    """Each trie broadcast in turn."""
    sc = built.sparkSession.sparkContext
    for shard in range(count):
        row = built.filter(F.col("shard") == shard).select("data").first()
        if row:
            shared = sc.broadcast(row["data"])
            yield shared
            shared.destroy()


def counted(texts: DataFrame, found: DataFrame, least: int) -> list[DataFrame]:
    """s, t, f of those candidates that reach the least count; a table for each trie."""
    built, count = tries(found, ["s", "t"])
    out = []
    for shared in _each(built, count):

        def run(batches, shared=shared):
            trie = pickle.loads(shared.value)
            n = np.zeros(len(trie.check), np.int64)
            for x in _sequences(batches):
                slots = trie.reached(x)[1]
                n += np.bincount(slots, minlength=len(n)) if len(slots) else 0
            slot = np.flatnonzero(n)
            node = trie.check[slot]
            columns = trie.nodes[node], trie.labels[slot - trie.base[node]], n[slot]
            for lo in range(0, len(slot), 1 << 16):
                s, t, f = (pa.array(c[lo : lo + (1 << 16)].astype(np.int64)) for c in columns)
                yield _batch(s=s, t=t, f=f)

        sums = texts.mapInArrow(run, "s long, t long, f long").groupBy("s", "t").agg(F.sum("f").alias("f"))
        out.append(cut(sums.filter(F.col("f") >= least), "pm-counts"))
    discard(built)
    return out


def advanced(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """The sequence of the longer phrases (s, t, id): the id of the phrase that starts at each place, else 0."""
    built, count = tries(phrases, ["s", "t", "id"])
    out, first = None, True
    for shared in _each(built, count):

        def run(batches, shared=shared, first=first):
            trie = pickle.loads(shared.value)
            for b in _steps(batches):
                x = _numbers(b.column(0))
                y = np.zeros(len(x), np.uint32) if first else _numbers(b.column(1)).copy()
                at, slot = trie.reached(x)
                y[at] = trie.ids[slot]
                yield _batch(numbers=b.column(0), longer=_rows(y, np.append(0, np.cumsum(pc.binary_length(b.column(0)).to_numpy()))))

        before, out = out, cut((texts if out is None else out).mapInArrow(run, "numbers binary, longer binary"), "pm-longer")
        if before is not None:
            discard(before)
        first = False
    discard(built)
    if out is None:
        return cut(texts.limit(0), "pm-texts")
    short = cut(out.select("longer").mapInArrow(lambda batches: _written(_sequences(batches)), "numbers binary"), "pm-texts")
    discard(out)
    return short


def longer_phrases(texts: DataFrame, least: int) -> DataFrame | None:
    """s, t, f, id of the frequent pairs of neighbours, written; None where there is none."""
    held = texts.agg(F.coalesce(F.sum(F.length("numbers")), F.lit(0))).first()[0] // 4
    rounds = max(1, -(-held // PAIRS))
    texts = texts.coalesce(max(1, -(-held // TASK)))
    found = []
    for this in range(rounds):
        here = cut(candidates(texts, least, this, rounds), "pm-candidates")
        found += counted(texts, here, least)
        discard(here)
    if not found:
        return None
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    out = cut(numbered(every, "pm-numbered"), "pm-phrases")
    discard(*found)
    return out


def mined(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Word totals (lang, n), and for each length a table of frequent phrases: id, lang, phrase, last (word), f, and from two
    words on the counts of the phrases without the last (fs) and the first word (ft) with their ids (s, t)."""
    c = F.col
    docs = docs.select(F.coalesce(c("lang").cast("string"), F.lit("und")).alias("lang"), c("text").cast("binary").alias("text"))
    counts = cut(word_counts(docs), "pm-word-counts")
    totals = cut(counts.groupBy("lang").agg(F.sum("f").alias("n")), "pm-totals")
    words = cut(numbered(counts.filter(c("f") >= least), "pm-numbered"), "pm-frequent")
    texts = encoded(docs, words)
    levels = [words.select("id", "lang", c("word").cast("string").alias("phrase"), c("word").cast("string").alias("last"), "f")]
    for _ in range(2, longest + 1):
        found = longer_phrases(texts, least)
        if found is None or not found.limit(1).count():
            break
        before, texts = texts, advanced(texts, found)
        discard(before)
        up = levels[-1]
        left = up.select(c("id").alias("s"), "lang", c("phrase").alias("start"), c("f").alias("fs"))
        right = up.select(c("id").alias("t"), "last", c("f").alias("ft"))
        named = found.join(left, "s").join(right, "t").withColumn("phrase", F.concat_ws(" ", "start", "last"))
        levels.append(cut(named.select("id", "lang", "phrase", "last", "f", "s", "t", "fs", "ft"), "pm-level"))
    discard(counts)
    return totals, levels[0], levels[1:]


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) in decimals of 38 digits; the quotient fits 64 bits, as left and right reach a."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    top = (wide(1000 * a, 19) * wide(n, 18)).alias("top")
    return F.call_function("div", top, wide(left, 19) * wide(right, 18))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of docs (lang, text): each language's first phrases by cut score."""
    c = F.col
    totals, words, levels = mined(docs, least, longest)
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if not levels:
        return docs.sparkSession.createDataFrame([], schema)
    every = words.select("lang", "phrase", "f")
    for level in levels:
        every = every.union(level.select("lang", "phrase", "f"))
    kept = None
    for k, level in enumerate(levels):
        mine = level.select("id", "lang", "phrase", "f")
        if k + 1 < len(levels):
            # A longer candidate as frequent holds one that is a word longer and as frequent, so that one is enough.
            up = levels[k + 1]
            same = up.filter("f >= fs").select(c("s").alias("id")).union(up.filter("f >= ft").select(c("t").alias("id"))).distinct()
            mine = mine.join(same, "id", "left_anti")
        mine = mine.select("lang", "phrase", c("f").alias("a"), F.lit(k + 2).alias("words"))
        kept = mine if kept is None else kept.union(mine)
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), c("words") - 1))).withColumn("w", F.split("phrase", " "))
    cuts = cuts.withColumn("first", F.array_join(F.slice("w", 1, c("k")), " ")).withColumn("rest", F.array_join(F.slice("w", c("k") + 1, c("words")), " "))
    cuts = cuts.join(every.select("lang", c("phrase").alias("first"), c("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(every.select("lang", c("phrase").alias("rest"), c("f").alias("r")), ["lang", "rest"])
    scored = cuts.join(totals, "lang").withColumn("score", cut_score(c("a"), c("n"), c("l"), c("r")))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    worst = worst.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [c("score").desc(), c("a").desc(), c("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*order)
    best = worst.withColumn("rank", F.row_number().over(some)).filter(c("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(c("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
