"""Context blocks, labels, previews and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata_label(domain=None, company=None, court=None, patient=None, doc_id=None) -> Column:
    """` [domain=... | company=... | id=...]` of what is there; empty if nothing is."""
    part = lambda name, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(name + "="), c.cast("string"))) if c is not None else F.lit(None).cast("string")
    tags = F.concat_ws(" | ", part("domain", domain), part("company", company), part("court", court), part("patient", patient), part("id", doc_id))
    return F.when(tags == "", "").otherwise(F.concat(F.lit(" ["), tags, F.lit("]")))


def preview(text: Column, n: int = 200, dots: bool = False) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, n), "\\n", " ")
    return F.when(F.length(text) > n, F.concat(cut, F.lit("..."))).otherwise(cut) if dots else cut


def context_blocks(chunks: DataFrame, keys: list[str], text: str = "text", label: str = "label", rank: str = "rank") -> DataFrame:
    """One context for each query: headed texts by rank, blanks skipped but counted, so numbers may have gaps."""
    block = F.when(F.trim(text) != "", F.concat(F.lit("### Source "), F.col(rank).cast("string"), F.col(label), F.lit("\n"), F.trim(text)))
    sections = F.sort_array(F.collect_list(F.when(block.isNotNull(), F.struct(F.col(rank).alias("r"), block.alias("b")))))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(sections, lambda s: s["b"]), "\n\n").alias("context"))


def hint_block(hints: Column, most: int = 2) -> Column:
    usable = F.slice(F.filter(hints, lambda h: F.trim(h) != ""), 1, most)
    return F.when(F.size(usable) > 0, F.concat(F.lit("Hints (not evidence):\n"), F.array_join(usable, "\n"))).otherwise("")


def answer_prompt(query: Column, context: Column, hint: Column | None = None, language: Column | None = None) -> Column:
    en = F.concat(F.lit("Answer from the sources alone. If they do not hold the answer, say so.\n\n"), context, F.lit("\n\n"), hint if hint is not None else F.lit(""), F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))
    zh = F.concat(F.lit("只根据资料回答。资料中没有答案时请说明。\n\n"), context, F.lit("\n\n"), hint if hint is not None else F.lit(""), F.lit("\n\n问题："), query, F.lit("\n回答："))
    return F.when(language.startswith("zh"), zh).otherwise(en) if language is not None else en


def judge_prompt(query: Column, answer: Column, points: Column, version: str = "v1") -> Column:
    ask = {"v0": "Say [[[Relevant]]], [[[Irrelevant]]] or [[[Wrong]]].", "v1": "Give a JSON object with complete_ids, irrelevant_ids and wrong_ids.", "v2": "Give one label for each point, in order."}[version]
    return F.concat(F.lit("Judge how the answer treats each point.\nQuestion: "), query, F.lit("\nAnswer: "), answer, F.lit("\nPoints:\n"), points, F.lit("\n" + ask))


def relevance_prompt(query: Column, text: Column) -> Column:
    return F.concat(F.lit("Does the passage help to answer the question? A: yes, B: partly, C: no.\nQuestion: "), query, F.lit("\nPassage: "), F.substring(text, 1, 700))


def passage_input(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def path_lines(head: Column, relation: Column, tail: Column) -> Column:
    return F.format_string("%s --[%s]--> %s", head, relation, tail)


def lost_in_middle(n: Column, rank: Column) -> Column:
    """Place of a rank when odd ranks come first, ascending, and even ones last, descending."""
    return F.when(rank % 2 == 1, F.floor((rank + 1) / 2)).otherwise(n - F.floor(rank / 2) + 1).cast("int")
