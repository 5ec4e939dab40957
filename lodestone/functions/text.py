"""Text functions as column expressions; Python only for the stemmer and the longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed token patterns.
EN_TOKEN = "[a-z0-9']+"
UNICODE_WORD = "(?U)\\w+"
SENTENCE = "[^.!?\\n]+[.!?]*"
HAN_SENTENCE = "[^\u3002\uff01\uff1f\\n]*[\u3002\uff01\uff1f]|[^\u3002\uff01\uff1f\\n]+"
HAN = "[\\u4e00-\\u9fff]"
HAN_NARROW = "[\\u4e00-\\u9fa5]"

#: Short English stop list that the registered queries use on both sides; pass another where needed.
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its "
    "just may more most my no not of on one or other our out she so some such than that the their them then there these they this to up was we were what "
    "when which who will with would you your"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, stop: list[str] | None = None) -> Column:
    """Lower-case tokens of letters, digits and apostrophes, without stop words; null: empty."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(EN_TOKEN), F.lit(0))
    if stop:
        words = F.array(*[F.lit(w) for w in stop])
        return F.filter(found, lambda t: ~F.array_contains(words, t))
    return found


def plain_tokens(text: Column | str) -> Column:
    """Pieces between single blanks, case kept, empty ones too."""
    return F.split(_col(text), " ")


def unicode_words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(UNICODE_WORD), F.lit(0))


def han_grams(text: Column | str) -> Column:
    """Single characters and pairs of neighbouring ones of each run of Han characters, in place of a segmenter."""
    runs = F.regexp_extract_all(_col(text), F.lit(HAN + "+"), F.lit(0))
    # characters by one pass over a run, pairs by places in an array: substring() would count from the start each time
    chars = F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(HAN), F.lit(0)))
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))
    return F.flatten(F.transform(chars, lambda c: F.concat(c, pairs(c))))


def language_tokens(text: Column | str, language: Column | str, stop: list[str] | None = None) -> Column:
    return F.when(_col(language).startswith("zh"), han_grams(text)).otherwise(tokens(text, stop))


def sentences(text: Column | str) -> Column:
    """Trimmed sentences, by closing marks and line breaks; blanks dropped."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def han_sentences(text: Column | str) -> Column:
    """Trimmed sentences, each with its closing mark; by line breaks too; blanks dropped."""
    found = F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(HAN_SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def count_words(text: Column | str, language: Column | str = "") -> Column:
    """Characters for zh, else pieces between white space."""
    plain = F.size(F.filter(F.split(_col(text), "\\s+"), lambda w: w != ""))
    if isinstance(language, str) and not language:
        return plain
    return F.when(_col(language).startswith("zh"), F.length(_col(text))).otherwise(plain)


def has_han(text: Column | str, narrow: bool = False) -> Column:
    return _col(text).rlike(HAN_NARROW if narrow else HAN)


def keywords(text: Column | str, stop: list[str] | None = None, least: int = 3) -> Column:
    """Distinct tokens of `least` characters or more that are no stop words, sorted."""
    kept = F.filter(tokens(text, STOP_WORDS if stop is None else stop), lambda t: F.length(t) >= least)
    return F.array_sort(F.array_distinct(kept))


def ngrams(words: Column | str, most: int = 4, least_chars: int = 1, joiner: str = " ") -> Column:
    """Distinct word n-grams, n from 1 to `most`."""
    w = _col(words)

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), joiner))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.filter(F.array_distinct(F.concat(*[of(n) for n in range(1, most + 1)])), lambda g: F.length(g) >= least_chars)


def keyword_overlap(text: Column | str, words: Column | str, fold: bool = True) -> Column:
    """How many of the distinct words stand in the text as substrings."""
    t = F.lower(_col(text)) if fold else _col(text)
    return F.size(F.filter(_col(words), lambda k: F.contains(t, F.lower(k) if fold else k)))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Longest common subsequence of two token arrays."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None or not len(p) or not len(q):
                out.append(0)
                continue
            where = {}
            for j, t in enumerate(q):
                where.setdefault(t, np.zeros(len(q), bool))[j] = True
            row = np.zeros(len(q) + 1, np.int32)
            for t in p:  # a row of the table at once: gains, then running maxima
                hit = where.get(t)
                if hit is not None:
                    row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(hit, row[:-1] + 1, 0)))
            out.append(int(row[-1]))
        return pd.Series(out)

    return run(_col(a), _col(b))


def porter_stem(word: Column | str) -> Column:
    """Porter's stemmer (1980). Apply it to a vocabulary and join back."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        from lodestone.functions.porter import stem

        known = {w: stem(w) for w in x.dropna().unique()}
        return x.map(known)

    return run(_col(word))
