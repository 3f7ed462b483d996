"""Quality classifier: supervised subword embeddings.

A text's features are its words, pairs of neighbouring words (a word said twice in a row is one feature for all words) and the
byte 3- and 4-grams of its words with their borders, upper case kept; each is hashed into 2 ** BUCKETS_LOG2 vectors of DIM
numbers. The text's vector is their mean, and a softmax layer over it tells the labels.

Both are learnt by numpy stochastic gradient descent on at most SAMPLE labelled documents, those with the least hashes of
their ids. The sample's features are computed in tasks and written, a row for each of at most PARTS groups; in each epoch every
group descends from the same model, and the models are averaged. The model has a fixed size, so it is what goes to the tasks and back.

As the layer is linear in the mean, a feature's vector times the layer is one number: scoring a text is the mean of these
numbers over all its features, from a table of 2 ** BUCKETS_LOG2 numbers.

Defined cases: null and empty texts have no features and get the share that the bias alone gives; rows without a label or an
id teach nothing; an id with several labels teaches the one that most of them have, 1 if they are even; rows that share a
labelled id teach one by one, equal ones once; without labelled rows every score is 0.5; texts are read whole, a
piece at a time; repeated rows and rows without an id are scored one by one; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

BUCKETS_LOG2, DIM = 17, 8
SAMPLE, PARTS, PART_ROWS = 5_000, 4, 1_000
EPOCHS, RATE = 8, 2.0
PIECE = 1 << 20
_SPACES = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
#: Odd multipliers of the hashes.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SAME = np.uint64(0x5851F42D4C957F2D)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _ODD[kind]
    return (h ^ h >> np.uint64(29)) * _ODD[3] >> np.uint64(64 - BUCKETS_LOG2)


def _pieces(data: bytes):
    """The text in pieces that end at a blank where there is one."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            end = data.rfind(b" ", at + 1, end) + 1 or end
        yield data[at:end]
        at = end


def features(text: str | None):
    """Arrays of the buckets of all features of a text."""
    data = text.encode("utf-8", "replace").translate(_SPACES) if text else b""
    before = None
    for piece in _pieces(data):
        b = np.frombuffer(b" " + piece + b" ", np.uint8).astype(np.uint64)
        word = b != 32
        for n in (3, 4):
            if len(b) >= n:
                inner = np.logical_and.reduce([word[k : len(b) - n + 1 + k] for k in range(1, n - 1)])
                h = sum(b[k : len(b) - n + 1 + k] << np.uint64(8 * k) for k in range(n))[inner]
                yield _bucket(h + np.uint64(n << 40), 0)
        start = np.flatnonzero(word & ~np.append(False, word[:-1]))
        if not len(start):
            continue
        place = np.arange(len(b), dtype=np.uint64) - np.repeat(np.append(0, start), np.diff(np.append(np.append(0, start), len(b)))).astype(np.uint64)
        h = np.add.reduceat(np.where(word, (b + np.uint64(1)) * (place * _ODD[0] + _ODD[1] ^ place >> np.uint64(3)), np.uint64(0)), start)
        yield _bucket(h, 1)
        chain = h if before is None else np.append(before, h)
        before = h[-1]
        pair = np.where(chain[:-1] == chain[1:], _SAME, chain[:-1] * _ODD[2] + chain[1:])
        yield _bucket(pair, 2)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their shares of its features."""
    found = [*features(text)]
    at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    return at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def start() -> dict:
    rng = np.random.default_rng(11)
    return {"vectors": np.zeros((1 << BUCKETS_LOG2, DIM), np.float32), "layer": rng.normal(size=(2, DIM)).astype(np.float32), "bias": np.zeros(2, np.float32)}


def descend(model: dict, rows: list[tuple[np.ndarray, np.ndarray, int]], rate: float, seed: int) -> dict:
    """One pass of stochastic gradient descent over rows of (buckets, shares, label)."""
    vectors, layer, bias = (model[k].copy() for k in ("vectors", "layer", "bias"))
    for k in np.random.default_rng(seed).permutation(len(rows)):
        at, share, label = rows[k]
        mean = share @ vectors[at]
        z = layer @ mean + bias
        p = np.exp(z - z.max())
        miss = p / p.sum()
        miss[label] -= 1
        back = layer.T @ miss
        layer -= np.float32(rate / DIM) * np.outer(miss, mean)
        bias -= np.float32(rate / 10) * miss
        vectors[at] -= np.float32(rate) * (share * np.float32(len(at) ** 0.5))[:, None] * back
    return {"vectors": vectors, "layer": layer, "bias": bias}


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's rows as one."""
    pdf = pdf.sort_values("h")
    held = [(np.frombuffer(a, np.int32), np.frombuffer(s, np.float32), y) for a, s, y in zip(pdf["at"], pdf["share"], pdf["y"])]
    return pd.DataFrame({"n": [len(held)], "rows": [pickle.dumps(held)]})


def _fitted(shared, rate: float, seed: int):
    def run(batches):
        for b in batches:
            for n, rows in zip(b["n"], b["rows"]):
                yield pd.DataFrame({"n": [n], "model": [pickle.dumps(descend(shared.value, pickle.loads(rows), rate, seed))]})

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict | None:
    """The model learnt from docs (doc_id, text) and labels (doc_id, label); None without a labelled document."""
    c = F.col
    spark = docs.sparkSession
    known = labels.select("doc_id", c(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["h"])

    def run(batches):
        for b in batches:
            held = [counted(t) for t in b["text"]]
            yield pd.DataFrame({"h": b["h"], "y": b["y"], "at": [x.tobytes() for x, _ in held], "share": [x.tobytes() for _, x in held]})

    table = cut(rows.select("h", "y", "text").mapInPandas(run, "h long, y int, at binary, share binary"), "qc-sample")
    # Rows that share an id can make the sample longer than its ids; the least hashes stay.
    said = table.select("h").orderBy("h").limit(SAMPLE).agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h")).first()
    if not said.n:
        discard(table)
        return None
    parts = min(PARTS, -(-said.n // PART_ROWS))
    dealt = table.filter(c("h") <= said.h).withColumn("part", F.pmod(F.xxhash64(c("h").bitwiseXOR(F.lit(1))), F.lit(parts)))
    fit = cut(dealt.groupBy("part").applyInPandas(_packed, "n long, rows binary"), "qc-groups")
    discard(table)
    model = start()
    for epoch in range(EPOCHS):
        shared = spark.sparkContext.broadcast(model)
        told = fit.mapInPandas(_fitted(shared, RATE * (1 - epoch / EPOCHS), epoch), "n long, model binary").collect()
        shared.destroy()
        models = sorted(((r.n, bytes(r.model)) for r in told), key=lambda x: x[1])
        weights = [n / sum(n for n, _ in models) for n, _ in models]
        held = [pickle.loads(m) for _, m in models]
        model = {k: sum(w * m[k] for w, m in zip(weights, held)).astype(np.float32) for k in model}
    discard(fit)
    return model


def predict(docs: DataFrame, model: dict | None, key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """key, score and predicted of every text; nothing but the text is looked at."""
    table = np.zeros(1 << BUCKETS_LOG2, np.float64)
    bias = 0.0
    if model:
        line = model["layer"][1] - model["layer"][0]
        table, bias = model["vectors"].astype(np.float64) @ line.astype(np.float64), float(model["bias"][1] - model["bias"][0])
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def score(text) -> float:
        total, n = 0.0, 0
        for f in features(text):
            total, n = total + float(shared.value[f].sum()), n + len(f)
        return 1 / (1 + float(np.exp(-np.clip(bias + total / max(1, n), -700, 700))))

    def run(batches):
        for b in batches:
            said = np.array([score(t) for t in b["text"]], np.float64)
            yield pd.DataFrame({key: b[key], "score": said, "predicted": (said >= threshold).astype(np.int32)}, index=b.index)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInPandas(run, f"`{key}` {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of docs; rows where held_out is true teach nothing."""
    model = train(docs.filter(~held_out), labels)
    said = predict(docs.select("doc_id", "text"), model)
    return said.select("doc_id", held_out.alias("held_out"), "score", "predicted")
