"""Language identification by language-bitmask n-gram filters.

Learning: byte 4-grams of lower-cased training texts are counted per language, those above a relative frequency are
kept (which bounds their number whatever the corpus), and enter one bit-sliced Bloom filter: every slot holds a bitmask
of languages, so one look-up of an n-gram's slots, ANDed, gives all languages that hold it. The filter's size is fixed.
Prediction: hits per language over the whole text (popcounts of each bit), corrected for that bit's false-positive rate;
the language with most corrected hits wins, ties by training share and then name.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text with letters but no hit gets the
most frequent training language with score 0; rows without text or language teach nothing; without any training row
everything is ``und``; null ids count as the text ''; repeated rows count as often as they occur; texts of any length
are read whole, piece by piece; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS_LOG2 = 20
HASHES = 4
#: An n-gram enters a language's filter above this share of the language's n-grams: at most 1 / share of them can.
MIN_SHARE = 1e-5
PIECE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Odd multipliers of the slot hashes.
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)


def grams(text: str):
    """Arrays of the text's byte 4-grams as 32-bit numbers, a bounded piece at a time."""
    data = f" {text} ".lower().encode("utf-8", "replace").translate(_KEEP)
    data = re.sub(rb" {2,}", b" ", data)
    for at in range(0, max(len(data) - 3, 0), PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE + 3, len(data) - at), at).astype(np.uint32)
        yield b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24


def slots(g: np.ndarray, k: int) -> np.ndarray:
    h = g * np.uint32(_ODD[k])
    return (h ^ h >> np.uint32(15)) * np.uint32(_ODD[(k + 1) % len(_ODD)]) >> np.uint32(32 - SLOTS_LOG2)


def _count(batches):
    """Counts per language of one partition's n-grams, merged as they grow."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    loose: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def merge(lang):
        g, c = np.unique(np.concatenate(loose.pop(lang)), return_counts=True)
        if lang in held:
            g, at = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
            c = np.bincount(at, np.concatenate([held[lang][1], c])).astype(np.int64)
        held[lang], size[lang] = (g, c.astype(np.int64)), 0

    for b in batches:
        for text, lang in zip(b["text"], b["lang"]):
            for g in grams(text):
                loose.setdefault(lang, []).append(g)
                size[lang] = size.get(lang, 0) + len(g)
                if size[lang] > 4_000_000:
                    merge(lang)
    for lang in [*loose]:
        merge(lang)
    for lang, (g, c) in held.items():
        yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": c})


def train(docs: DataFrame) -> dict:
    """The filter: languages by training share, slots (a row of bitmasks for every 64 languages), and bit fill rates.

    Reads text and lang. What reaches the driver is a fixed number of slots and one row a language.
    """
    usable = docs.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = usable.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    langs = sorted(totals, key=lambda x: (-totals[x], x))
    planes = max(1, -(-len(langs) // 64))
    filled = np.zeros((planes, 1 << SLOTS_LOG2), np.uint64)
    if langs:
        total = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(float(totals[k])))])
        number = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
        share = counts.select("gram", number[F.col("lang")].alias("i"), (F.col("n") / total[F.col("lang")]).alias("p"))
        bits = share.filter(F.col("p") >= MIN_SHARE).select("gram", "i")

        def place(batches):
            for b in batches:
                g = b["gram"].to_numpy().astype(np.uint32)
                for k in range(HASHES):
                    yield pd.DataFrame({"plane": b["i"] // 64, "slot": slots(g, k).astype(np.int64), "mask": np.left_shift(np.uint64(1), (b["i"] % 64).to_numpy().astype(np.uint64)).astype(np.int64)})

        rows = bits.mapInPandas(place, "plane int, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        filled[rows["plane"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
    counts.unpersist()
    rates = np.array([np.mean(filled[i // 64] >> np.uint64(i % 64) & np.uint64(1)) ** HASHES for i in range(len(langs))])
    return {"langs": langs, "slots": filled, "rates": rates}


def judge(text: str | None, model: dict) -> tuple[str, float]:
    langs = model["langs"]
    if text is None or not langs or not _LETTER.search(text):
        return "und", 0.0
    hits, n = np.zeros(len(langs)), 0
    for g in grams(text):
        n += len(g)
        where = [slots(g, k) for k in range(HASHES)]
        for plane, table in enumerate(model["slots"]):
            masks = table[where[0]]
            for w in where[1:]:
                masks &= table[w]
            masks = masks[masks != 0]
            for bit in range(min(64, len(langs) - 64 * plane)):
                hits[64 * plane + bit] += np.count_nonzero(masks & np.uint64(1 << bit))
    if not n:
        return langs[0], 0.0
    true = np.clip((hits - n * model["rates"]) / (1 - np.minimum(model["rates"], 0.999)), 0, n)
    best = int(np.argmax(true))
    return langs[best], float(true[best] / n)


def predict(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of every text; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            said = [judge(t, shared.value) for t in b["text"]]
            yield pd.DataFrame({key: b[key], "lang_pred": [x[0] for x in said], "score": [x[1] for x in said]}, index=b.index)

    return docs.select(key, "text").mapInPandas(run, f"`{key}` {kind}, lang_pred string, score double")
