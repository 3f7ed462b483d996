"""BPE encoding and decoding with forced-boundary splitting.

A pair of byte symbols that no vocabulary token contains side by side can never be merged across, so it marks a certain
cut: the pieces between cuts are encoded on their own and concatenated. Pieces repeat a great deal, so their codes are
kept in a bounded table per worker (it only saves time). The vocabulary file is read on the driver and shipped to
tasks; its size is that of the file, never of the data.

Decoding reads the ids alone: each id's token from the file, put together as the file's decoder says. Normalising follows
the file's list of steps as well. A step or decoder of a kind not known here is an error, never skipped.

Defined cases: a null or empty text has no tokens and decodes to nothing; texts of any length are encoded whole;
repeated rows are encoded one by one; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP = 400_000
LONG_PIECE = 256
NEVER = 1 << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(free)) for b in range(256)]


def _lower(text: str) -> str:
    """Lower case by single characters: sigma has one small form wherever it stands."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def normalizers(spec: dict | None) -> list:
    """The file's normalising steps as functions of a text."""
    if spec is None:
        return []
    kind = spec["type"]
    if kind == "Sequence":
        return [f for s in spec["normalizers"] for f in normalizers(s)]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [lambda t: t if t.isascii() else unicodedata.normalize(kind, t)]
    if kind == "Lowercase":
        return [_lower]
    if kind == "Replace":
        which = spec["pattern"]
        find = regex.compile(which["Regex"] if "Regex" in which else regex.escape(which["String"]))
        return [lambda t: find.sub(lambda _: spec["content"], t)]
    raise ValueError(f"unknown normalizer: {kind}")


def white_space_only(spec: dict, split: str) -> bool:
    """Whether a step only turns white space into blanks, all of which the split pattern drops."""
    return spec["type"] == "Replace" and spec["pattern"].get("Regex") == r"\s+" and spec["content"] == " " and not regex.compile(split).search(" \t\n\x85\xa0\u3000")


def load_model(path: str) -> dict:
    """What coding needs from a tokenizer file: vocabulary, merges, word end, split pattern, special tokens, and how
    it normalises and decodes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    steps = spec["normalizer"]
    if steps and steps["type"] == "Sequence":
        pattern = split["pattern"]["Regex"]
        steps = {"type": "Sequence", "normalizers": [n for n in steps["normalizers"] if not white_space_only(n, pattern)]}
    return {
        "normalizer": steps,
        "decoder": spec["decoder"],
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "end": model.get("end_of_word_suffix") or "",
        "pattern": split["pattern"]["Regex"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]},
    }


class Decoder:
    """Texts from ids (little-endian unsigned 32-bit)."""

    def __init__(self, model: dict):
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in model["special"].items()}
        self.names = np.array([names.get(i, "") for i in range(max(names, default=-1) + 1)], dtype=object)
        kind = (model["decoder"] or {"type": None})["type"]
        if kind not in (None, "ByteLevel", "BPEDecoder"):
            raise ValueError(f"unknown decoder: {kind}")
        self.kind, self.suffix = kind, (model["decoder"] or {}).get("suffix", "")
        self.bytes = {ord(s): b for b, s in enumerate(byte_symbols())}

    def decode(self, ids: bytes) -> str:
        tokens = self.names[np.frombuffer(ids, "<u4")].tolist()
        if self.kind == "ByteLevel":
            return "".join(tokens).translate(self.bytes).encode("latin-1", "replace").decode("utf-8", "replace")
        if self.kind == "BPEDecoder":
            tokens = [t.replace(self.suffix, "" if n + 1 == len(tokens) else " ") for n, t in enumerate(tokens)]
            return "".join(tokens)
        return " ".join(tokens)


class Encoder:
    def __init__(self, model: dict):
        self.vocab, self.end = model["vocab"], model["end"]
        self.normalize = normalizers(model["normalizer"])
        self.special = model["special"]
        v = self.vocab
        self.rank = {(v[a], v[b]): k for k, (a, b) in enumerate(model["merges"])}
        self.new = [v[a + b] for a, b in model["merges"]]
        self.symbols = byte_symbols()
        self.pairs = set()
        for token in v:
            body = token.removesuffix(self.end) if self.end else token
            self.pairs.update(zip(body, body[1:]))
        self.split = regex.compile(model["pattern"])
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.table = str.maketrans({i: s for i, s in enumerate(self.symbols)})
        self.pieces: dict[tuple[str, bool], list[int]] = {}
        self.words: dict[str, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """A word of byte symbols, cut wherever no token could span the cut."""
        pairs, out, start = self.pairs, [], 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in pairs:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def merge(self, piece: str, last: bool) -> list[int]:
        """Merge one fragment, the best-ranked and leftmost pair first; last: it ends its word."""
        ids = [self.vocab[c] for c in piece]
        if last and self.end:
            ids[-1] = self.vocab[piece[-1] + self.end]
        if len(ids) > LONG_PIECE:
            return self.merge_long(ids)
        get, new = self.rank.get, self.new
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [new[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same for fragments of any length: a heap of pairs over a linked list, n log n."""
        get, new, n = self.rank.get, self.new, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new[r], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0 and (q := get((ids[x], ids[right[x]]), NEVER)) != NEVER:
                    heapq.heappush(heap, (q, x, ids[x], ids[right[x]]))
        return [x for x in ids if x >= 0]

    def word(self, text: str) -> bytes:
        """Codes of one word as little-endian bytes."""
        ids: list[int] = []
        parts = self.fragments(text.encode("utf-8", "replace").decode("latin-1").translate(self.table))
        for k, p in enumerate(parts):
            key = (p, k == len(parts) - 1)
            if (code := self.pieces.get(key)) is None:
                code = self.merge(*key)
                if len(parts) > 1:
                    if len(self.pieces) >= KEEP:
                        self.pieces.clear()
                    self.pieces[key] = code
            ids += code
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= KEEP:
            self.words.clear()
        if len(text) <= 64:
            self.words[text] = got
        return got

    def plain(self, text: str) -> list[bytes]:
        for step in self.normalize:
            text = step(text)
        get, word = self.words.get, self.word
        return [get(w) or word(w) for w in self.split.findall(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit bytes."""
        parts, at = [], 0
        for m in self.cut.finditer(text) if self.cut and any(s in text for s in self.special) else ():
            parts += self.plain(text[at : m.start()])
            parts.append(self.special[m[0]].to_bytes(4, "little"))
            at = m.end()
        parts += self.plain(text[at:] if at else text)
        return b"".join(parts)


_READY: dict[str, tuple[Encoder, Decoder]] = {}


def bpe_encode(docs: DataFrame, path: str, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ids (little-endian unsigned 32-bit bytes), decoded (the ids read back), and n_tokens, each after prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(path))
    added = [(f"{prefix}ids", T.BinaryType()), (f"{prefix}decoded", T.StringType()), (f"{prefix}n_tokens", T.LongType())]
    kept = [f for f in docs.schema.fields if f.name not in {n for n, _ in added}]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in added)])

    def run(batches):
        coder, reader = _READY.get(path) or _READY.setdefault(path, (Encoder(shared.value), Decoder(shared.value)))
        for whole in batches:
            for at in range(0, max(1, len(whole)), 512):
                b = whole.iloc[at : at + 512]
                ids = [coder.encode("" if t is None else t) for t in b[text]]
                codes = [(i, reader.decode(i), len(i) // 4) for i in ids]
                yield b[[f.name for f in kept]].assign(**{n: pd.Series([c[k] for c in codes], index=b.index, dtype=object) for k, (n, _) in enumerate(added)})

    return docs.mapInPandas(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""
    coded = bpe_encode(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def bpe_decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that a column of ids (little-endian unsigned 32-bit; null: null) stands for."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(path))
    kept = [f for f in docs.schema.fields if f.name != decoded]

    def run(batches):
        _, reader = _READY.get(path) or _READY.setdefault(path, (Encoder(shared.value), Decoder(shared.value)))
        for b in batches:
            texts = [None if i is None else reader.decode(bytes(i)) for i in b[ids]]
            yield b[[f.name for f in kept]].assign(**{decoded: pd.Series(texts, index=b.index, dtype=object)})

    return docs.mapInPandas(run, T.StructType([*kept, T.StructField(decoded, T.StringType())]))
