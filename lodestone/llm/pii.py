"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Matches and the gaps between them come from the same pattern, so the
running sum of their lengths gives each span's place in code points. The patterns are written so
that every scan is linear: a match starts at the start of a run or where the last match ended
(\\G), and runs are possessive, which finds the same leftmost non-overlapping matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, with a character that a text must hold for a match.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?+[0-9]){12,}+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", None),
}
BASE = ("email", "ip", "card", "phone")
#: Words that raise the score of a span that follows them.
CONTEXT = {
    "email": "mail|contact|e-mail|write",
    "ip": r"\bip\b|address|host|server|login",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
#: Score of a pattern, what a passed checksum adds, what context adds; added kinds stay from LEAST on.
PROPOSED = {"email": 0.8, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.3}
CHECKED, NEARBY, LEAST, REACH = {"card": 0.5, "iban": 0.5}, 0.2, 0.5, 48

_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"""(aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + case when i % 2 = 1
  then cast(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1) as int)
  else cast(substring({_DIGITS}, length({_DIGITS}) - i + 1, 1) as int) * 2
    - case when substring({_DIGITS}, length({_DIGITS}) - i + 1, 1) >= '5' then 9 else 0 end end) % 10 = 0)"""
_PLAIN = "replace(x.m, ' ', '')"
_TURNED = f"concat(substring({_PLAIN}, 5), substring({_PLAIN}, 1, 4))"
_MOD97 = f"""(aggregate(sequence(1, length({_PLAIN})), 0, (s, i) -> case when substring({_TURNED}, i, 1) between '0' and '9'
  then (s * 10 + cast(substring({_TURNED}, i, 1) as int)) % 97
  else (s * 100 + ascii(substring({_TURNED}, i, 1)) - 55) % 97 end) = 1)"""
#: Conditions on a match x.m.
VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', substring(ltrim('0', p), 1, 3)) as int) <= 255)",
    "card": f"case when length({_DIGITS}) between 13 and 19 then {_LUHN} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "iban": f"case when length({_PLAIN}) between 15 and 34 then {_MOD97} else false end",
}
_SPAN = "array<struct<start:int,end:int,m:string,near:string>>"


def _spans(kind: str) -> Column:
    """Valid spans of a kind, from the arrays of its matches and of the gaps before them."""
    placed = f"""aggregate(zip_with(_m_{kind}, slice(_g_{kind}, 1, size(_m_{kind})), (a, b) -> named_struct('m', a, 'n', b.n, 'near', b.near)),
      named_struct('pos', 0, 'out', cast(array() as {_SPAN})),
      (s, x) -> named_struct('pos', s.pos + x.n + length(x.m), 'out', concat(s.out, array(named_struct('start', s.pos + x.n, 'end', s.pos + x.n + length(x.m), 'm', x.m, 'near', x.near)))),
      s -> s.out)"""
    score = f"cast({PROPOSED[kind]} as double) + {CHECKED.get(kind, 0.0)} + case when rlike(x.near, '{CONTEXT[kind]}') then {NEARBY} else 0.0 end"
    scored = f"transform(filter({placed}, x -> {VALID[kind]}), x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'score', least(1.0D, cast({score} as double))))"
    kept = scored if kind in BASE else f"filter({scored}, x -> x.score >= {LEAST})"
    return F.expr(f"case when size(_m_{kind}) = 0 then cast(array() as array<struct<kind:string,start:int,end:int,score:double>>) else {kept} end")


def find(docs: DataFrame) -> DataFrame:
    """All columns of docs, then pii: array of (kind, start, end, score), by kind as in PATTERNS, then start.

    In: text; columns named pii or _m_*, _g_* are replaced. A null or empty text has an empty array.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found, gaps = {}, {}
    for kind, (pattern, needs) in PATTERNS.items():
        all_of = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gate = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9][0-9\\x20-]{12}") if kind == "card" else text.rlike("[A-Z]{2}[0-9]{2}")
        found[f"_m_{kind}"] = F.when(gate, all_of).otherwise(F.array().cast("array<string>"))
        between = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.lower(F.substring(p, -REACH, REACH)).alias("near")))
        gaps[f"_g_{kind}"] = F.when(F.size(f"_m_{kind}") > 0, between)
    docs = docs.drop("pii", *found, *gaps)
    out = docs.withColumns(found).withColumns(gaps)
    return out.withColumn("pii", F.concat(*[_spans(k) for k in PATTERNS])).drop(*found, *gaps)


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text, by document."""
    base = "filter(pii, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.expr(f"sha2({_joined(base)}, 256)").alias("base_sha256"), F.expr(_joined("pii")).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """Text with each span replaced by its kind in angle brackets; overlapping spans count as one."""
    cover = """aggregate(array_sort(pii, (a, b) -> case when a.start <> b.start then a.start - b.start else b.end - a.end end),
      named_struct('pos', 0, 'out', ''),
      (s, x) -> named_struct('pos', greatest(s.pos, x.end), 'out', case when x.start >= s.pos
        then concat(s.out, substring(text, s.pos + 1, x.start - s.pos), '<', upper(x.kind), '>') else s.out end),
      s -> concat(s.out, substring(text, s.pos + 1)))"""
    return found.withColumn("text", F.expr(f"case when size(pii) = 0 then text else {cover} end"))
