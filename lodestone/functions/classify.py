"""Query types by patterns, their labels and chunk policies, and the multi-hop trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types in order of precedence, patterns, labels, boosts and policies.
TYPES = ("FACTUAL", "MULTI_DOC_INTEGRATION", "MULTI_DOC_COMPARISON", "MULTI_DOC_TIMESEQ", "MULTIHOP", "SUMMARY", "IRRELEVANT_UNSOLVABLE")
PATTERNS_EN = {
    "FACTUAL": r"\b(who|what|when|how many|how much|age|established|founded|date of)\b",
    "MULTI_DOC_INTEGRATION": r"\b(according to .* and .*|respectively|both .* and .*|in \d{4} and \d{4})\b",
    "MULTI_DOC_COMPARISON": r"\b(compare|comparison|difference|vs\.?|versus|which .* (more|higher|larger|older|longer))\b",
    "MULTI_DOC_TIMESEQ": r"\b(earlier|later|before|after|time sequence|timeline)\b",
    "MULTIHOP": r"\b(how did .* lead to|how did .* result in|how .* help(ed)?|because|therefore|thus)\b",
    "SUMMARY": r"\b(summarize|summary|summarise)\b",
    "IRRELEVANT_UNSOLVABLE": r"\b(airspeed velocity of an unladen swallow|favorite color of .* chief physician)\b",
}
PATTERNS_ZH = {
    "FACTUAL": "(是谁|是什么|多少|几|何时|哪天|日期|时间|地点|职业|年龄|成立|设立|金额|比例|总资产|净利润)",
    "MULTI_DOC_INTEGRATION": r"(分别|根据.*(和|及).*|结合.*(和|及).*|在\d{4}年.*(和|及).*\d{4}年)",
    "MULTI_DOC_COMPARISON": "(比较|对比|差异|不同|哪家|哪个.*更|谁.*更)",
    "MULTI_DOC_TIMESEQ": "(更早|更晚|先于|晚于|先后顺序|先发生|后发生|时间序列)",
    "MULTIHOP": "(如何通过|如何.*来|导致|因此|从而|进而|使得|帮助.*(提升|增加|改善)|影响.*(原因|机制|路径))",
    "SUMMARY": "(总结|概括|归纳|整理|综述|提炼|简述)",
    "IRRELEVANT_UNSOLVABLE": "(最喜欢的颜色|空气速度|unladen swallow|不相关)",
}
BOOSTS = {"MULTI_DOC_TIMESEQ": 0.2, "MULTI_DOC_COMPARISON": 0.15, "MULTI_DOC_INTEGRATION": 0.1, "SUMMARY": 0.1, "MULTIHOP": 0.1}
LABELS_EN = {
    "FACTUAL": "Factual Question",
    "MULTI_DOC_INTEGRATION": "Multi-document Information Integration Question",
    "MULTI_DOC_COMPARISON": "Multi-document Comparison Question",
    "MULTI_DOC_TIMESEQ": "Multi-document Time Sequence Question",
    "MULTIHOP": "Multi-hop Reasoning Question",
    "SUMMARY": "Summary Question",
    "IRRELEVANT_UNSOLVABLE": "Irrelevant Unsolvable Question",
    "UNKNOWN": "Irrelevant Unsolvable Question",
}
LABELS_ZH = {
    "FACTUAL": "事实性问题",
    "MULTI_DOC_INTEGRATION": "多文档信息整合问题",
    "MULTI_DOC_COMPARISON": "多文档对比问题",
    "MULTI_DOC_TIMESEQ": "多文档时间序列问题",
    "MULTIHOP": "多跳推理问题",
    "SUMMARY": "总结性问题",
    "IRRELEVANT_UNSOLVABLE": "无关无解问",
    "UNKNOWN": "无关无解问",
}
POLICY_EN = {"FACTUAL": (90, 18), "MULTI_DOC_TIMESEQ": (110, 22), "MULTI_DOC_COMPARISON": (170, 34), "MULTI_DOC_INTEGRATION": (190, 38), "MULTIHOP": (230, 46), "SUMMARY": (240, 48)}
POLICY_EN_ELSE = (140, 28)
HOP_MARKERS_EN = ("before and after", "over time", "timeline", "sequence of events", "first", "then", "after that", "afterwards", "between", "from", "until", "up to", "change in", "changes in", "evolution of", "history of")
HOP_MARKERS_ZH = ("前后", "之前", "之後", "之后", "期間", "期间", "历程", "過程", "过程", "多次", "先後", "先后", "從", "从", "一直到")
HOP_EVENTS = ("resignation", "appointment", "merger", "acquisition", "default", "restructuring", "lawsuit", "investigation")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def classify(rows: DataFrame, query: str = "query", language: str = "language", context: str | None = None) -> DataFrame:
    """Adds scores (map), canonical_type and dataset_label. Null texts count as empty, null language as en."""
    q = F.trim(F.coalesce(F.col(query), F.lit("")))
    text = F.trim(F.concat(q, F.lit("\n"), F.trim(F.coalesce(F.col(context), F.lit(""))))) if context else q
    zh = F.coalesce(F.col(language), F.lit("en")).startswith("zh")
    low = F.lower(q)
    cue = {
        "MULTI_DOC_INTEGRATION": F.when(zh, F.when((F.contains(q, F.lit("根据")) & _any(q, "和及")) | F.contains(q, F.lit("分别")), 0.6)).otherwise(F.when(low.rlike("according to .* and .*") | low.rlike(r"\brespectively\b"), 0.6)),
        "MULTI_DOC_COMPARISON": F.when(zh, F.when(_any(q, ("比较", "对比")) & _any(q, ("更", "哪家", "谁")), 0.6)).otherwise(F.when(low.rlike(r"\bcompare\b") & low.rlike(r"\bwhich\b"), 0.6)),
        "MULTI_DOC_TIMESEQ": F.when(zh, F.when(_any(q, ("更早", "更晚", "先于", "晚于")), 0.8)).otherwise(F.when(low.rlike(r"\b(earlier|later)\b"), 0.8)),
    }
    scores = {}
    for t in TYPES:
        n = F.when(zh, F.regexp_count(text, F.lit(PATTERNS_ZH[t]))).otherwise(F.regexp_count(text, F.lit("(?i)" + PATTERNS_EN[t])))
        s = F.when(n > 0, F.least(F.lit(3.0), 1.0 + 0.5 * (n - 1))).otherwise(0.0)
        scores[t] = s + F.coalesce(cue[t], F.lit(0.0)) if t in cue else s
    out = rows.withColumns({f"_s_{t}": s for t, s in scores.items()})
    final = {t: F.when(F.col(f"_s_{t}") > 0, F.round(F.col(f"_s_{t}") + BOOSTS.get(t, 0.0), 6)).otherwise(0.0) for t in TYPES}
    out = out.withColumns({f"_f_{t}": s for t, s in final.items()})
    top = F.greatest(*[F.col(f"_f_{t}") for t in TYPES])
    best = F.lit("UNKNOWN")
    for t in reversed(TYPES):
        best = F.when(F.col(f"_f_{t}") == top, t).otherwise(best)
    out = out.withColumn("score", top).withColumn("canonical_type", F.when(top == 0, "UNKNOWN").otherwise(best))
    label = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("canonical_type")]
    out = out.withColumn("dataset_label", F.when(zh, label(LABELS_ZH)).otherwise(label(LABELS_EN)))
    out = out.withColumn("scores", F.map_from_arrays(F.array(*[F.lit(t) for t in TYPES]), F.array(*[F.col(f"_f_{t}") for t in TYPES])))
    return out.drop(*[f"_s_{t}" for t in TYPES], *[f"_f_{t}" for t in TYPES])


def chunk_policy(rows: DataFrame, language: str = "language", size: int = 128, overlap: int = 64) -> DataFrame:
    """Adds chunk_size and chunk_overlap for the canonical type; size and overlap are the zh base."""
    zh_policy = {
        "FACTUAL": (max(220, size - 140), max(32, overlap - 24)),
        "MULTI_DOC_TIMESEQ": (max(260, size - 100), max(48, overlap - 8)),
        "MULTI_DOC_COMPARISON": (size + 96, overlap + 32),
        "MULTI_DOC_INTEGRATION": (size + 160, overlap + 48),
        "MULTIHOP": (size + 256, overlap + 64),
        "SUMMARY": (size + 256, overlap + 64),
    }
    zh = F.coalesce(F.col(language), F.lit("en")).startswith("zh")
    pick = lambda table, i, other: F.coalesce(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])])[F.col("canonical_type")], F.lit(other))
    return rows.withColumns(
        {
            "chunk_size": F.when(zh, pick(zh_policy, 0, size)).otherwise(pick(POLICY_EN, 0, POLICY_EN_ELSE[0])).cast("int"),
            "chunk_overlap": F.when(zh, pick(zh_policy, 1, overlap)).otherwise(pick(POLICY_EN, 1, POLICY_EN_ELSE[1])).cast("int"),
        }
    )


def is_multi_hop(query: Column | str) -> Column:
    q = F.coalesce(F.col(query) if isinstance(query, str) else query, F.lit(""))
    low = F.lower(q)
    events = sum((F.contains(low, F.lit(w)).cast("int") for w in HOP_EVENTS), F.lit(0))
    return _any(low, HOP_MARKERS_EN) | _any(q, HOP_MARKERS_ZH) | (_any(low, (" and ", " & ")) & (events >= 2))


def asks_sub_question(canonical: Column, n_results: Column, top_k: int) -> Column:
    return F.lower(canonical).rlike("multi|hop|compare|caus|reason") | (n_results < top_k)
