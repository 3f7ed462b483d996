"""Quality rules, line first: drop failing lines, then reject documents that lose too much text.

Everything is one projection of built-in functions: no shuffle, no Python, one pass over each text.

Defined cases: a null or empty text has no words, so it fails the base rules and is rejected; its cleaned text
is empty. A text of any length is judged whole. Null ids pass through; repeated rows are judged one by one; an
empty table gives an empty table; other columns of the input are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, unused, words

#: Phrases of page furniture, looked for in lower-cased lines of at most BOILERPLATE_WORDS words.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
BOILERPLATE_WORDS = 30
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when its failing lines hold more than this share of its characters.
MAX_LOST_PERCENT = 40


def _count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a three-word window found twice or more. Windows are compared by 64-bit hash and sorted, so
    the work is n log n in the length of the text."""

    def windows(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    def repeated(s):
        return F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
                ),
            ),
            lambda p: p.isNotNull(),
        )

    def covered(p):
        steps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = bind(F.sort_array(bind(placed, repeated)), covered)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(F.lit(0).cast("long"))

    def count(w):
        return bind(windows(w), places)

    return F.when(F.size(tokens) >= 3, bind(tokens, count)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column) -> Column:
    """True for a line that is navigation, symbol noise, shouting, stuttering or boilerplate."""

    def judged(w):
        n = F.size(w)
        pipes = F.when(line.contains("|"), _count_of(line, "|")).otherwise(0)
        symbols = _count_of(line, SYMBOLS)
        shouts = F.when(line.contains("!"), _count_of(line, "!")).otherwise(0)
        phrase = F.lower(line).rlike("|".join(BOILERPLATE))
        bare = ~F.substring(F.rtrim(line), -1, 1).isin(*".!?:;,)]}\"'»”…")
        return (
            ((pipes >= 2) & (pipes * 4 >= n))
            | ((symbols >= 3) & (symbols >= n))
            | ((shouts >= 3) & (shouts >= n) & (line == F.upper(line)))
            | ((n >= 8) & (F.size(F.array_distinct(w)) * 3 <= n))
            | ((n <= BOILERPLATE_WORDS) & phrase)
            | ((n <= 3) & bare)
        )

    return bind(words(line), judged)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned_text, lost_chars, kept."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, l = unused(docs, "tokens"), unused(docs, "lines")
    df = docs.withColumn(w, words(F.col(text))).withColumn(l, F.split(t, "\n"))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    dup_lines = bind(F.filter(F.col(l), has_word), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": _count_of(t, SYMBOLS).cast("long"),
            "n_dup_lines": dup_lines.cast("long"),
            "n_repeat_words": repeat_words(F.col(w)),
            "cleaned_text": F.array_join(F.filter(F.col(l), lambda x: ~has_word(x) | ~line_fails(x)), "\n"),
        }
    ).drop(w, l)
    lost = (F.length(t) - F.length("cleaned_text")).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    df = df.withColumns({"lost_chars": lost, "base_failed": failed})
    return df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.length(t)))
