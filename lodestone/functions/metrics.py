"""Retrieval and generation metrics as column expressions over arrays; all row-local."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def _ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def without_prefix(reference: Column) -> Column:
    """A retrieved text without a leading bracketed note, by the bracket it starts with."""
    return F.when(reference.startswith("（"), F.regexp_replace(reference, "^（[^）]*）", "")).when(reference.startswith("("), F.regexp_replace(reference, r"^\([^)]*\)", "")).otherwise(reference)


def joined(texts: Column) -> Column:
    return F.concat_ws(" ", F.transform(texts, without_prefix))


def _distinct_words(texts: Column, zh: bool) -> Column:
    joined_texts = F.concat_ws(" ", texts)
    return F.array_distinct(T.han_grams(joined_texts) if zh else T.tokens(joined_texts))


def words_precision(found: Column, truth: Column, most: int = 5, zh: bool = False) -> Column:
    """Distinct words of the first `most` retrieved texts that the truth has too, as a share of them;
    for zh, Han characters and pairs."""
    r, g = _distinct_words(F.slice(found, 1, most), zh), _distinct_words(truth, zh)
    return _ratio(F.size(F.array_intersect(r, g)), F.size(r))


def words_recall(found: Column, truth: Column, zh: bool = False) -> Column:
    r, g = _distinct_words(found, zh), _distinct_words(truth, zh)
    return _ratio(F.size(F.array_intersect(r, g)), F.size(g))


def _matched_words(found: Column, truth: Column, zh: bool = False) -> Column:
    """Words (for zh, characters) of the truth's sentences that stand in the retrieved texts; repeats count."""
    held = joined(found)
    hits = F.filter(F.flatten(F.transform(truth, T.han_sentences if zh else T.sentences)), lambda s: F.contains(held, s))
    return F.aggregate(hits, F.lit(0), lambda n, s: n + (F.length(s) if zh else T.count_words(s)))


def sentence_precision(found: Column, truth: Column, zh: bool = False) -> Column:
    return _ratio(_matched_words(found, truth, zh), F.length(joined(found)) if zh else T.count_words(joined(found)))


def sentence_recall(found: Column, truth: Column, zh: bool = False) -> Column:
    whole = F.concat_ws(" ", truth)
    return _ratio(_matched_words(found, truth, zh), F.length(whole) if zh else T.count_words(whole))


def exists_match(query: Column, references: Column) -> Column:
    """Whether each sentence stands in some reference; no sentence at all is no match."""
    s = T.sentences(query)
    return (F.size(s) > 0) & F.forall(s, lambda x: F.exists(references, lambda r: F.contains(r, x)))


def match_precision(found: Column, truth: Column, most: int = 5) -> Column:
    first = F.slice(found, 1, most)
    return _ratio(F.size(F.filter(first, lambda r: exists_match(r, truth))), F.size(first))


def match_recall(found: Column, truth: Column) -> Column:
    return _ratio(F.size(F.filter(truth, lambda g: exists_match(g, found))), F.size(truth))


def snr(found: Column, truth: Column) -> Column:
    """10 log10 of matched over unmatched words; 0 where either is none."""
    match = _matched_words(found, truth)
    rest = T.count_words(joined(found)) - match
    return F.when((match > 0) & (rest > 0), 10 * F.log10(match / rest)).otherwise(0.0)


def rouge_l(lcs: Column, hypothesis: Column, reference: Column) -> Column:
    """F of sentence-level ROUGE-L from the length of the common subsequence and both token arrays."""
    p, r = _ratio(lcs, F.size(hypothesis)), _ratio(lcs, F.size(reference))
    return _ratio(2 * p * r, p + r)


def _clipped(hypothesis: Column, reference: Column, most: int) -> Column:
    """For each n up to `most`, n-grams of the hypothesis that the reference has too, each counted as
    often as in both; linear in the tokens, by Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(h: pd.Series, r: pd.Series) -> pd.Series:
        grams = lambda words, n: Counter(zip(*(words[i:] for i in range(n)), strict=False))
        return pd.Series([[(grams(list(x), n) & grams(list(y), n)).total() for n in range(1, most + 1)] for x, y in zip(h, r, strict=True)])

    return run(F.coalesce(hypothesis, F.array().cast("array<string>")), F.coalesce(reference, F.array().cast("array<string>")))


def bleu(hypothesis: Column, reference: Column, most: int = 4) -> Column:
    """Sentence BLEU with clipped counts and brevity penalty; 0 where some order has no match."""
    hits = _clipped(hypothesis, reference, most)
    logs = F.aggregate(F.transform(hits, lambda x, i: F.log(F.greatest(x, F.lit(1)) / F.greatest(F.size(hypothesis) - i, F.lit(1)))), F.lit(0.0), lambda s, x: s + x) / most
    positive = F.array_min(hits) > 0
    brevity = F.when(F.size(hypothesis) > F.size(reference), 1.0).otherwise(F.exp(1 - F.size(reference) / F.greatest(F.size(hypothesis), F.lit(1))))
    return F.when(positive, brevity * F.exp(logs)).otherwise(0.0)


# key points


def label_of(answer: Column) -> Column:
    """First judge label of an answer."""
    return F.when(F.contains(answer, F.lit("[[[Relevant]]]")), "Relevant").when(F.contains(answer, F.lit("[[[Irrelevant]]]")), "Irrelevant").when(F.contains(answer, F.lit("[[[Wrong]]]")), "Wrong").otherwise("UNKNOWN")


def labels_in_order(answer: Column, most: Column) -> Column:
    """Labels by order of appearance, misspellings taken as Irrelevant, the first `most`."""
    found = F.slice(F.regexp_extract_all(answer, F.lit("(?i)(irrelevant|irrelavant|irrelvant|relevant|wrong)"), F.lit(1)), F.lit(1), most)
    return F.transform(found, lambda x: F.when(F.lower(x).startswith("irrel"), "Irrelevant").otherwise(F.initcap(x)))


def ids_from_json(answer: Column) -> Column:
    """Struct of id lists from the object between the first and last brace; null if there is none."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "complete_ids array<int>, irrelevant_ids array<int>, wrong_ids array<int>, reasons string")


def ratios_by_label(labels: Column) -> Column:
    """hallucination, completeness and irrelevance of one label for each key point (unknown: irrelevant)."""
    n = F.size(labels)
    share = lambda c: _ratio(c, n)
    wrong, good = F.size(F.filter(labels, lambda x: x == "Wrong")), F.size(F.filter(labels, lambda x: x == "Relevant"))
    return F.struct(share(good).alias("completeness"), share(wrong).alias("hallucination"), share(n - wrong - good).alias("irrelevance"))


def ratios_of_found(labels: Column) -> Column:
    """The same over the labels that were found, a null or unknown one being none; null where none was."""
    known = F.filter(labels, lambda x: x.isin("Relevant", "Irrelevant", "Wrong"))
    share = lambda name: F.size(F.filter(known, lambda x: x == name)) / F.when(F.size(known) > 0, F.size(known))
    return F.struct(share("Relevant").alias("completeness"), share("Wrong").alias("hallucination"), share("Irrelevant").alias("irrelevance"))


def ratios_by_ids(complete: Column, irrelevant: Column, total: Column) -> Column:
    """The same from id lists, each capped at the total; hallucination is what is left, maybe below 0."""
    c, i = F.least(F.size(complete), total), F.least(F.size(irrelevant), total)
    return F.struct(_ratio(c, total).alias("completeness"), F.when(total > 0, (total - c - i) / total).otherwise(0.0).alias("hallucination"), _ratio(i, total).alias("irrelevance"))


def format_key_points(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda k, i: F.when(k.rlike(r"^\s*\d+[.、]\s*"), F.trim(k)).otherwise(F.concat((i + 1).cast("string"), F.lit(". "), F.trim(k)))), "\n")


def parse_key_points(text: Column) -> Column:
    """Key points from numbered lines."""
    return F.filter(F.transform(F.split(F.concat(F.lit("\n"), text), r"\n\s*\d+[.、]\s*"), lambda x: F.trim(x)), lambda x: x != "")


#: Metric name: factory of a column from (found, truth) arrays. Extend with register().
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {
    "Words_Precision": words_precision,
    "Words_Recall": words_recall,
    "Sentences_Precision": sentence_precision,
    "Sentences_Recall": sentence_recall,
    "precision": match_precision,
    "recall": match_recall,
    "eir": sentence_precision,
    "snr": snr,
}


def register(name: str, factory: Callable[[Column, Column], Column]) -> None:
    REGISTRY[name] = factory


def get_metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in REGISTRY:
        raise KeyError(f"unknown metric {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


#: Metric sets of the full and of the plain evaluation.
PROFILES = {"full": ("Words_Precision", "Words_Recall", "Sentences_Precision", "Sentences_Recall", "eir", "snr"), "baseline": ("precision", "recall", "eir")}
