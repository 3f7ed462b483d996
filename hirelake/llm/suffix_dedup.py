"""Suffix-array dedup: remove every byte covered by a WIDTH-byte string that also starts earlier in the corpus.

The suffix array is only needed where a string may repeat and it isn't settled otherwise. So:

1. Every WIDTH-byte window has a key, the least hash of the k-byte strings in it: a function of its bytes alone, so equal
   windows have equal keys. Runs of neighbouring windows with one key are one row: key, hash of the run's bytes, place.
2. Keys that occur once, with their string once in the run, can't hold repeated windows and go. Of equal runs all but the
   earliest are removed whole. What is left are the first places of different runs under one key.
3. A key whose runs would outgrow a block (a passage that very many documents share) is dealt out by longer strings: its
   runs go through 1 and 2 again with the next k of LENGTHS. With the longest, a run has two windows and a key at most
   256 * 256 different runs of 101 bytes, so every key ends in a block of bounded size whatever the corpus.
4. Runs are dealt to blocks by key, and each block is suffix-sorted by the difference-cover algorithm: sampled triples are
   sorted and named, names sorted in recursion, the remaining suffixes merged; neighbours in order whose first WIDTH
   bytes are equal are one class, of which all but the earliest are repeats.

Hashes of runs are 64-bit under a 64-bit key.

Defined cases: null texts are empty; texts under WIDTH bytes lose nothing; a null id counts as smaller than all others;
rows that share an id are documents of their own, ordered by the SHA-256 of their texts, null first; of rows that share
both one, any, is the earlier; a text of any length is used whole, in pieces; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, ids_clash, row_numbers
from .suffix_array import suffix_array

WIDTH = 100
#: Lengths of the strings that make keys; each length is for keys that the one before leaves too crowded.
LENGTHS = (40, 70, 88, 96, 99)
PIECE = 1 << 19
#: Low bits of a key's hash that make room for its place in a buffer of at most two pieces.
PLACE_BITS = 21
BLOCK_BYTES = 1 << 20
#: Bytes of different runs of one key that fill a block of their own; more are dealt out by longer strings.
CROWD_BYTES = BLOCK_BYTES
#: Odd multipliers of the string hashes.
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _M[5]
    return x ^ x >> np.uint64(29)


def _hashes(b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-byte and of all WIDTH-byte strings, from strings of twice the length at each step."""
    h = {1: (b.astype(np.uint64) + np.uint64(1)) * _M[0]}
    for step, size in enumerate((1, 2, 4, 8, 16, 32)):
        x = h[size]
        y = x[:-size] * _M[step + 1] + x[size:]
        h[2 * size] = y ^ y >> np.uint64(32)

    def joined(length: int) -> np.ndarray:
        n, at, out = len(b) - length + 1, 0, None
        for number, size in enumerate((64, 32, 16, 8, 4, 2, 1)):
            if length & size:
                part = h[size][at : at + n]
                out = part if out is None else out * _M[2 + number % 3] + part
                at += size
        return _mix(out)

    return joined(k), joined(WIDTH)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _bytes(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def _pieces(ids, starts, texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about PIECE bytes: the bytes, and for every byte its document, place in the document, and piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        n = np.array([len(x) for _, _, x in held])
        doc = np.repeat(np.array([d for d, _, _ in held], np.int64), n)
        shift = np.repeat(np.array([a for _, a, _ in held], np.int64) - (np.cumsum(n) - n), n)
        part = np.repeat(np.arange(len(held)), n)
        return data, doc, np.arange(len(data)) + shift, part

    for d, start, t in zip(ids, starts, texts):
        data = t if isinstance(t, bytes) else _bytes(t)
        for at in range(0, max(len(data) - WIDTH + 1, 0), PIECE):
            piece = data[at : at + PIECE + WIDTH - 1]
            held.append((d, start + at, piece))
            size += len(piece)
            if size >= PIECE:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _runs(k: int, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for data, doc, place, part in _pieces(*columns):
                yield _runs_of(data, doc, place, part, k, carry)

    return run


def _runs_of(data: np.ndarray, doc: np.ndarray, place: np.ndarray, part: np.ndarray, k: int, carry: bool) -> pa.RecordBatch:
    key, whole = _hashes(data, k)
    key = key >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(key), dtype=np.uint64)
    least = _least(key, WIDTH - k + 1)
    v, where = least >> np.uint64(PLACE_BITS), least & np.uint64((1 << PLACE_BITS) - 1)
    n = len(data) - WIDTH + 1
    valid = part[:n] == part[WIDTH - 1 :]
    new = np.ones(n, bool)
    new[1:] = (v[1:] != v[:-1]) | (part[1:n] != part[: n - 1])
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= since % WIDTH == 0
    start = np.flatnonzero(new & valid)
    ends = np.flatnonzero(new | ~valid)
    end = np.append(ends, n)[np.searchsorted(ends, start) + 1]
    size = end - start
    told = _mix(whole[start] * _M[1] + whole[end - 1] * _M[6] + size.astype(np.uint64))
    columns = {
        "key": v[start].view(np.int64),
        "told": told.view(np.int64),
        "d": doc[start],
        "start": place[start],
        "n": size.astype(np.int32),
        "inner": (where[start] != where[end - 1]).astype(np.int32),
    }
    if carry:
        held = data.tobytes()
        columns["data"] = [held[i : j + WIDTH - 1] for i, j in zip(start.tolist(), end.tolist())]
    return pa.RecordBatch.from_pydict(columns)


def window_runs(texts: DataFrame, k: int, carry: bool = False) -> DataFrame:
    """key, told (hash of the run's bytes), d, start, n (windows in the run), inner (1 if the key's string occurs in the
    run twice, so that windows may repeat inside it) and, to carry, data (the run's bytes) for texts (d, at, data): data,
    text or bytes, stands at ``at`` of d."""
    schema = "key long, told long, d long, start long, n int, inner int"
    return texts.mapInArrow(_runs(k, carry), f"{schema}, data binary" if carry else schema)


def _slices(batches):
    """The bytes of each wanted run: rows of d, text, wanted (start, n, block, crowded)."""
    for whole in batches:
        for lo in range(0, len(whole), 500):
            out = []
            for d, text, wanted in whole.iloc[lo : lo + 500].itertuples(index=False, name=None):
                data = _bytes(text)
                out += [(w["block"], bool(w["crowded"]), d, w["start"], data[w["start"] : w["start"] + w["n"] + WIDTH - 1]) for w in wanted]
            yield pd.DataFrame(out, columns=["block", "crowded", "d", "start", "data"])


def repeated_windows(d: np.ndarray, start: np.ndarray, data: list[bytes]) -> pd.DataFrame:
    """Byte spans (d, s, e) of the windows of these runs that equal a window at an earlier place among them."""
    size = np.array([len(x) for x in data])
    buf = np.frombuffer(b"".join(x + b"\0" for x in data), np.uint8)
    offset = np.cumsum(size + 1) - (size + 1)
    run = np.repeat(np.arange(len(data)), size + 1)
    inside = np.arange(len(buf)) - offset[run]
    symbol = buf.astype(np.int64) + 1
    symbol[inside == size[run]] = 0
    begins = inside <= size[run] - WIDTH
    order = suffix_array(symbol)
    order = order[begins[order]]
    view = np.lib.stride_tricks.sliding_window_view(buf, WIDTH)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 15):
        i = order[at : at + (1 << 15)]
        same[at : at + len(i)] = (view[i] == view[order[at - 1 : at - 1 + len(i)]]).all(axis=1)
    group = np.flatnonzero(~same)
    place = start[run[order]] + inside[order]
    by_place = np.empty(len(order), np.int64)
    by_place[np.lexsort((place, d[run[order]]))] = np.arange(len(order))
    least = np.repeat(np.minimum.reduceat(by_place, group), np.diff(np.append(group, len(order))))
    late = np.zeros(len(buf) + 1, bool)
    late[order[by_place > least]] = True
    edges = np.flatnonzero(late[1:] != late[:-1]) + 1
    lo, hi = (np.insert(edges, 0, 0) if late[0] else edges)[0::2], (edges[0::2] if late[0] else edges[1::2])
    r = run[lo]
    return pd.DataFrame({"d": d[r], "s": start[r] + inside[lo], "e": start[r] + inside[hi - 1] + WIDTH})


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    return repeated_windows(pdf["d"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64), list(pdf["data"]))


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        e = min(e, size)
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cleaned(batches):
    for whole in batches:
        for lo in range(0, len(whole), 500):
            b = whole.iloc[lo : lo + 500]
            rows = []
            for doc, text, spans in b[["doc_id", "text", "spans"]].itertuples(index=False, name=None):
                data = _bytes(text)
                gone = merged([(x["s"], x["e"]) for x in spans], len(data)) if spans is not None else []
                at, kept = 0, []
                for s, e in gone:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                rows.append((doc, len(data), [{"start": s, "end": e} for s, e in gone], b"".join(kept)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "removed", "kept"])
            yield out.astype({"doc_id": "Int64"})


def _settle(texts: DataFrame, k: int, carry: bool, last: bool) -> tuple[DataFrame, DataFrame]:
    """Windows of texts (d, at, data) by keys of k bytes: spans (d, s, e) of the runs that equal an earlier one, and the
    first places of different runs under one key (d, start, n, key, crowded, data if carried)."""
    c = F.col
    runs = window_runs(texts, k, carry)
    often = cut(runs.groupBy("key").agg(F.sum(1 + c("inner")).alias("m")).filter("m > 1").select("key"), "sa-keys")
    runs = cut(runs.join(often, "key", "left_semi"), "sa-runs")
    discard(often)
    same = [F.first("n").alias("n"), F.max("inner").alias("inner"), *([F.first("data").alias("data")] if carry else [])]
    kinds = cut(runs.groupBy("key", "told").agg(F.min(F.struct("d", "start")).alias("first"), *same), "sa-kinds")
    whole = (
        runs.join(kinds.select("key", "told", "first"), ["key", "told"])
        .filter((c("d") != c("first.d")) | (c("start") != c("first.start")))
        .select("d", c("start").alias("s"), (c("start") + c("n") + WIDTH - 1).alias("e"))
    )
    whole = cut(whole, "sa-whole")
    discard(runs)
    crowd = kinds.groupBy("key").agg(F.sum(1 + c("inner")).alias("m"), F.sum(c("n") + WIDTH).alias("bytes")).filter("m > 1").select("key", "bytes")
    crowded = F.lit(False) if last else c("bytes") > CROWD_BYTES
    columns = ["first.d", "first.start", "n", "key", crowded.alias("crowded"), *(["data"] if carry else [])]
    open_ = cut(kinds.join(crowd, "key").select(*columns), "sa-open")
    discard(kinds)
    return whole, open_


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (start, end of maximal removed runs), kept (the bytes left) for docs (doc_id, text)."""
    c = F.col
    docs = docs.select("doc_id", "text")
    docs = row_numbers(docs, row="d") if ids_clash(docs) else docs.withColumn("d", c("doc_id").cast("long"))
    texts, spans = docs.select("d", F.lit(0).cast("long").alias("at"), "text"), []
    for number, k in enumerate(LENGTHS):
        whole, open_ = _settle(texts, k, number > 0, number + 1 == len(LENGTHS))
        total = open_.filter("not crowded").agg(F.coalesce(F.sum(c("n") + WIDTH), F.lit(0))).collect()[0][0]
        block = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // BLOCK_BYTES))))
        if number:
            contents = open_.select(block.alias("block"), "crowded", "d", "start", "data")
        else:
            wanted = open_.groupBy("d").agg(F.collect_list(F.struct("start", "n", "crowded", block.alias("block"))).alias("wanted"))
            contents = docs.select("d", "text").join(wanted, "d").mapInPandas(_slices, "block long, crowded boolean, d long, start long, data binary")
        contents = cut(contents, "sa-bytes")
        discard(open_)
        blocks = contents.filter("not crowded").select("block", "d", "start", "data").groupBy("block")
        spans += [whole, cut(blocks.applyInPandas(_block, "d long, s long, e long"), "sa-sorted")]
        texts = contents.filter("crowded").select("d", c("start").alias("at"), "data")
        if not texts.limit(1).count():
            break
    everywhere = reduce(DataFrame.union, spans)
    held = cut(everywhere.groupBy("d").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "sa-spans")
    discard(*spans)
    return docs.join(held, "d", "left").select("doc_id", "text", "spans").mapInPandas(
        _cleaned, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    )
