"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All on DataFrame functions. A pattern's matches are marked in one pass (a control
character on each side), and the lengths of the pieces between give the offsets
in code points. Patterns use lookbehinds and possessive loops, so that they take
time linear in the text and no stack, and match what the plain forms beside them do.

Kinds, in this order: email, ip, card (Luhn), phone, iban (mod 97), ssn (ranges
that are never issued), phone_local. The first four are the base: every match that
passes its check is returned. The others are returned from SCORE_LEAST on.

Score: the kind's prior, more where a checksum confirms the match, more where a
context word of the kind stands within BEFORE characters before or AFTER behind.

Defined cases: a null or empty text has no spans; a null doc_id and repeated rows
pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, AFTER, SCORE_LEAST = 48, 24, 0.5
_MARK, _INSTEAD = "\u0001", "\u0002"
_BYTE = "(?:0++|0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))"

#: kind: (pattern, prior, gain of a checksum, context words)
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.8, 0.0, "mail|contact|write to|reach",
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, 0.0, r"\bip\b|address|server|host|login|ping"),
    # [0-9]([ -]?[0-9])+, 13 to 19 digits passing Luhn
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", 0.3, 0.4, "card|visa|master|amex|payment|credit|debit|pay"),
    # \+[0-9][ ().0-9-]+[0-9], 9 to 15 digits
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", 0.7, 0.0, r"phone|\btel|call|mobile|cell|fax|whatsapp|sms"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.3, 0.5, r"iban|bank|account|transfer|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, 0.1, r"\bssn\b|social security|tax id"),
    "phone_local": (
        r"(?<![0-9+).-])(?<![0-9+).-] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
        0.4, 0.0, r"phone|\btel|call|mobile|cell|fax|whatsapp|sms",
    ),
}
BASE = ("email", "ip", "card", "phone")


def proposals(text: Column, pattern: str) -> Column:
    """array<struct<s int, e int, m string>>: the pattern's matches with their offsets in code points."""
    # a mark in the text itself would mislead; none of the patterns takes it or its stand-in
    clean = F.translate(text, _MARK, _INSTEAD)
    pieces = F.split(F.regexp_replace(clean, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")

    def step(acc, x):
        n = acc["pos"] + F.length(x["p"])
        span = F.struct(acc["pos"].alias("s"), n.alias("e"), x["p"].alias("m"))
        return F.struct(n.alias("pos"), F.when(x["i"] % 2 == 1, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(numbered, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    n = F.length(digits)

    def step(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, the first four characters read last, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(acc, c):
        v = F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def confirmed(kind: str, m: Column) -> Column:
    """The check that a proposal of the kind must pass."""
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(m, " ", ""))
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def spans(text: Column) -> dict[str, Column]:
    """For each kind, array<struct<s int, e int, m string, score double>>."""
    return {kind: _spans_of(text, kind) for kind in KINDS}


def _spans_of(text: Column, kind: str) -> Column:
    pattern, prior, gain, context = KINDS[kind]

    def scored(x):
        first = F.greatest(F.lit(1), x["s"] + 1 - BEFORE)
        near = F.lower(F.concat_ws(" ", F.substring(text, first, x["s"] + 1 - first), F.substring(text, x["e"] + 1, F.lit(AFTER))))
        score = F.lit(prior + gain) + F.when(near.rlike(context), 0.2).otherwise(0.0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.round(F.least(F.lit(1.0), score), 2).alias("score"))

    found = F.transform(F.filter(proposals(text, pattern), lambda x: confirmed(kind, x["m"])), scored)
    return found if kind in BASE else F.filter(found, lambda x: x["score"] >= SCORE_LEAST)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and an array of spans for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", *(c.alias(k) for k, c in spans(F.col("text")).items()))


def _said(kinds, score: bool = False) -> Column:
    def one(kind):
        parts = lambda x: [F.lit(kind), x["s"].cast("string"), x["e"].cast("string"), *([x["score"].cast("string")] if score else [])]
        return F.transform(F.col(kind), lambda x: F.concat_ws(":", *parts(x)))

    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of each document."""
    found = find_pii(docs).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        _said(BASE).alias("base"),
        _said(KINDS).alias("spans"),
        _said(KINDS, score=True).alias("scores"),
    )
    return found.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2("base", 256).alias("base_sha256"), "spans", "scores")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the base and of the other kinds replaced by its kind in brackets."""
    for kind in KINDS:  # one projection each: nested, the text's expression would multiply
        docs = docs.withColumn("text", _masked(F.col("text"), kind))
    return docs


def _masked(text: Column, kind: str) -> Column:
    def cut(acc, x):
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(f"[{kind}]"))
        return F.struct(kept.alias("out"), x["e"].alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))
    return F.aggregate(_spans_of(text, kind), start, cut, rest)
