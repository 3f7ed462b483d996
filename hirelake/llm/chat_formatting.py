"""Chat formatting: conversations rendered by a compiled template, with the characters that carry loss.

Turns go to their conversation's partition and are sorted there; rendering and reading back are streams, so neither a
conversation nor a partition is ever held in memory. Texts are escaped so that no text can hold a control string:
``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``; dropping each such backslash gives the text back.

Defined cases: null roles and texts are empty; turns of one number are ordered by role and text, and repeated turns all
count; null conversation ids form one conversation; a null turn number comes first; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import compile_template

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
TEMPLATE = (
    "{% for m in messages %}{{ '<|turn|>' }}{{ m.role | esc }}{{ '<|says|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | esc }}{% endgeneration %}"
    "{% else %}{{ m.text | esc }}{% endif %}{{ '<|end|>' ~ '\\n' }}{% endfor %}"
)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of rows with one conversation id, across batches, one row at a time."""
    from itertools import groupby

    rows = (r for b in batches for r in b.itertuples(index=False, name=None))
    return groupby(rows, key=lambda r: None if pd.isna(r[0]) else int(r[0]))


def _pieces(template: str):
    def run(batches):
        render = compile_template(template, {"esc": escape})
        out: list[tuple] = []
        held = 0
        for conv, rows in _grouped(batches):
            messages = ({"role": r[2], "text": r[3]} for r in rows)
            for at, (text, loss) in enumerate(render({"messages": messages})):
                out.append((conv, at, text, loss))
                held += len(text)
                if held > 4_000_000 or len(out) >= 20_000:
                    yield _frame(out)
                    out, held = [], 0
        if out:
            yield _frame(out)

    return run


def _frame(rows):
    df = pd.DataFrame(rows, columns=["conv_id", "piece", "text", "loss"])
    return df.astype({"conv_id": "Int64"})


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted conversations as pieces in order: conv_id, piece (its number), text, loss (under the mask or not).

    Joining a conversation's pieces by number gives its formatted text.
    """
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(_pieces(template), "conv_id long, piece long, text string, loss boolean")


def _read_back(batches):
    out = []
    for conv, rows in _grouped(batches):
        turns, loss_hash = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        buffer = ""
        for _, _, text, loss in rows:
            chars += len(text)
            if loss:
                plain = unescape(text)
                loss_hash.update(plain.encode("utf-8", "surrogatepass"))
                loss_chars += len(plain)
            buffer += text
            while (end := buffer.find(END)) >= 0:
                head, buffer = buffer[:end], buffer[end + len(END) :].removeprefix("\n")
                role, _, said = head.removeprefix(TURN).partition(SAYS)
                turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
                n += 1
        out.append((conv, n, turns.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
        if len(out) >= 20_000:
            yield _digests(out)
            out = []
    if out:
        yield _digests(out)


def _digests(rows):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def read_back(pieces: DataFrame) -> DataFrame:
    """Parse formatted pieces (as format_chats gives them, in order) into one digest row a conversation."""
    return pieces.mapInPandas(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
