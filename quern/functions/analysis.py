"""Text analysis as column expressions, with twins in plain Python (for query strings) and SQL (for checks).

Letters A-Z are lowered and every other character separates words; stop words go; the rest is stemmed by the first
ending that applies. Positions count the kept words of a value.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words and the endings that the stemmer removes.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did "
    "will would could should may might shall can this that these those it its i my we our you your he his she her "
    "they their not no so if as up out about into than then there when where which who how all any each both more"
).split()
# (ending, least length of the word), the first that fits is removed; words of up to three letters stay.
ENDINGS = (("ing", 5), ("tion", 6), ("ness", 6), ("ment", 6), ("ers", 5), ("es", 4), ("ed", 4), ("ly", 4), ("er", 4), ("s", 4))


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    cases = None
    for ending, least in ENDINGS:
        test, rest = word.endswith(ending) & (F.length(word) >= least), F.substring(word, F.lit(1), F.length(word) - len(ending))
        cases = F.when(test, rest) if cases is None else cases.when(test, rest)
    return cases.otherwise(word)


def kept_words(text: Column) -> Column:
    """Array of the words of a text without stop words, not yet stemmed; empty for NULL."""
    split = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", " ")), " +")
    return F.filter(split, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def analyse(text: Column) -> Column:
    """Array of the terms of a text."""
    return F.transform(kept_words(text), stem)


def stem_word(word: str) -> str:
    for ending, least in ENDINGS:
        if word.endswith(ending) and len(word) >= least:
            return word[: -len(ending)]
    return word


def analyse_text(text: str) -> list[str]:
    """``analyse`` for a Python string."""
    return [stem_word(w) for w in re.sub("[^A-Za-z]", " ", text).lower().split() if w not in STOP_WORDS]


def sql_stem(word: str) -> str:
    cases = " ".join(f"WHEN {word} LIKE '%{e}' AND length({word}) >= {n} THEN left({word}, length({word}) - {len(e)})" for e, n in ENDINGS)
    return f"CASE {cases} ELSE {word} END"


def sql_kept_words(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(string_split_regex(lower(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', ' ', 'g')), ' +'), lambda w: w <> '' AND w NOT IN ({stops}))"


def token_offsets(words: Column) -> Column:
    """Start of each word where words are one separator apart; approximate when separators repeat. NULL for NULL."""

    def starts(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else np.cumsum([0, *(len(w) + 1 for w in ws)])[:-1].astype(np.int32))

    return F.pandas_udf(starts, "array<int>")(words)


def highlight(text: Column, terms: list[str], before: str = "[", after: str = "]") -> Column:
    """The text with every word whose term is among ``terms`` between two marks; all else unchanged."""
    parts = F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1)
    hit = lambda p: stem(F.lower(p)).isin(terms) & ~F.lower(p).isin(STOP_WORDS) & p.rlike("^[A-Za-z]")
    return F.array_join(F.transform(parts, lambda p: F.when(hit(p), F.concat(F.lit(before), p, F.lit(after))).otherwise(p)), "")


def display_values(stored: Column) -> Column:
    """A stored multi-value field for reading: its parts joined by `` | ``."""
    return F.array_join(F.split(stored, "\x1f"), " | ")
