"""Tokenizers and word functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words that the word view leaves out.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was were will with this these those which who we our you your they "
    "their them not no can may also been being have had but or if than then so such into over under more most some any all"
).split()
# Endings that the crude stem takes off, the first that fits.
CRUDE_ENDINGS = ("ization", "ational", "tion", "ment", "ness", "ing", "ed", "es", "ly", "s")


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def content_words(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Runs that begin with a letter, longer than two signs, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(F.array(*map(F.lit, stop)), w))


def trigrams(word: Column) -> Column:
    """Runs of three signs of the word between its two end marks."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3)))


def stem(word: Column) -> Column:
    """Inflections only, of words of more than four signs: first the plural, then ing or ed of what is left, with undoubling."""
    cut = lambda w, k: F.left(w, F.length(w) - k)
    n = F.length(word)
    single = (
        F.when((n > 5) & word.endswith("ies"), F.concat(cut(word, 3), F.lit("y")))
        .when(word.rlike("(sses|shes|ches|xes|zes)$"), cut(word, 2))
        .when(word.endswith("s") & ~word.rlike("(ss|us|is|ics)$"), cut(word, 1))
        .otherwise(word)
    )
    m = F.length(single)
    bare = F.when((m > 5) & single.endswith("ing"), cut(single, 3)).when((m > 4) & single.endswith("ed"), cut(single, 2))
    doubled = (F.length(bare) > 2) & (F.right(bare, F.lit(1)) == F.left(F.right(bare, F.lit(2)), F.lit(1)))
    return F.when(n <= 4, word).otherwise(F.coalesce(F.when(doubled, cut(bare, 1)).otherwise(bare), single))


def crude_stem(word: Column) -> Column:
    """The word without the first of the crude endings that it has, if more than three signs are left."""
    out = F.lit(None).cast("string")
    for e in CRUDE_ENDINGS:
        out = F.coalesce(out, F.when((F.length(word) > len(e) + 3) & word.endswith(e), F.left(word, F.length(word) - len(e))))
    return F.coalesce(out, word)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC; nulls stay. Spark has no such function, so Arrow batches carry the texts."""
    return text.str.normalize("NFKC")
