"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for bank
accounts, number ranges for addresses, digit counts for phones), and words near a span adjust its
score. Possessive quantifiers and look-behinds keep every pattern linear in the text without
changing what it matches: each quantified class excludes the character that has to follow.

Defined cases: a null text is empty and has no spans; an empty table gives an empty result; rows are
handled one by one, so repeated rows repeat their result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 256          # spans per block of the running sums
NEAR = 40           # code points searched for context words on either side


@dataclass(frozen=True)
class Kind:
    """``maybe`` is a cheap condition that every text with a match meets."""
    name: str
    pattern: str
    maybe: str
    score: float
    context: str
    least: float = 0.0      # spans scoring less are dropped; 0 keeps all


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.8,
         r"\b((?:e-?)?mail|contact|write|correo|courriel)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\b(ip|host|server|address|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, r"\b(card|visa|credit|debit|mastercard|karte|tarjeta|carte)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"\b(phone|tel|call|mobile|fax|telefon|telefono)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]{4}", 0.8, r"\b(iban|bank|account|konto|cuenta|compte)\b"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"\b(ssn|social security|tax id)\b", 0.5),
)
BASE = ("email", "ip", "card", "phone")


def _mod97(text: Column) -> Column:
    compact = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(step(rest, char)))


def _confirmed(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        # Leading zeros do not count; the substring keeps the cast in range however long a part is.
        value = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(text, r"\."), lambda p: (F.length(value(p)) <= 3)
                        & (F.concat(F.lit("0"), F.substring(value(p), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return _mod97(text) == 1
    return F.lit(True)


def _placed(gaps_and_matches: Column) -> Column:
    """(start, end, text) of each match, from (gap, len, text) in order; running sums in blocks."""
    seg = gaps_and_matches
    last = F.floor((F.size(seg) - 1) / STEP).cast("int")
    blocks = F.sequence(F.lit(0), last)
    part = lambda b: F.slice(seg, b * STEP + 1, F.lit(STEP))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])
    sums = F.transform(blocks, lambda b: total(part(b)))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, text: STRING>>)")

    def block(b: Column) -> Column:
        base = F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.aggregate(
            part(b), F.struct(base.alias("at"), none.alias("out")),
            lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["out"], F.array(F.struct(
                (a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["len"]).alias("end"),
                x["text"].alias("text")))).alias("out")),
            lambda a: a["out"])

    return F.when(F.size(seg) == 0, none).otherwise(F.flatten(F.transform(blocks, block)))


def _near(text: Column, span: Column, words: str) -> Column:
    first = F.greatest(span["start"] - NEAR, F.lit(0).cast("long"))
    around = F.lower(F.substr(text, (first + 1).cast("int"), (span["end"] + NEAR - first).cast("int")))
    return F.rlike(around, F.lit(words))


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: id and ``spans``, an array of (start, kind_no, kind, end, text, score).

    Positions are code points, ends exclusive. Spans are ordered by start, then by kind as in
    ``KINDS``. Spans of one kind never overlap; spans of two kinds may.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # One projection per step, so that each regular expression runs once per text.
    found = rows.select("*", *[
        F.when(F.rlike(F.col("text"), F.lit(k.maybe)), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).alias(f"m_{k.name}")
        for k in KINDS])
    cut = found.select("*", *[
        F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern)).alias(f"p_{k.name}") for k in KINDS])

    def spans(no: int, kind: Kind) -> Column:
        pieces, matches = F.col(f"p_{kind.name}"), F.col(f"m_{kind.name}")
        segments = F.transform(matches, lambda m, i: F.struct(
            F.length(F.element_at(pieces, i + 1)).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("text")))
        valid = F.filter(_placed(segments), lambda s: _confirmed(kind.name, s["text"]))
        scored = F.transform(valid, lambda s: F.struct(
            s["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), s["text"].alias("text"),
            F.when(_near(F.col("text"), s, kind.context), F.lit(min(1.0, kind.score + 0.3))).otherwise(F.lit(kind.score)).alias("score")))
        none = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, kind_no: INT, kind: STRING, end: BIGINT, text: STRING, score: DOUBLE>>)")
        return F.when(pieces.isNull(), none).otherwise(F.filter(scored, lambda s: s["score"] >= kind.least))

    each = cut.select("doc_id", *[spans(i, k).alias(f"s_{k.name}") for i, k in enumerate(KINDS)])
    return each.select("doc_id", F.array_sort(F.concat(*[F.col(f"s_{k.name}") for k in KINDS])).alias("spans"))
