"""Personal data, with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97
for bank accounts, value ranges for addresses), and words near a span adjust
its score.  Positions come from splitting the text at the matches and adding
up the lengths, which count code points.  The expressions use possessive
quantifiers, so the engine neither backtracks nor recurses on long texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import free_name, whole

_EMAIL_CHARS = "[A-Za-z0-9._%+-]"
#: Characters looked at before and behind a span for context words.
CONTEXT = 40
#: Spans of the added kinds are reported from this score on.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Confirms a match.
    holds: object
    #: A text without this has no match; null: look anyway.
    needs: str | None
    #: Score before context, and the words that raise it.
    score: float
    words: str


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN, without blanks, leaves 1: four characters to the end, letters as 10 to 35, modulo 97."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    characters = F.filter(F.split(turned, ""), lambda x: x != "")
    values = F.transform(characters, lambda x: F.conv(x, 36, 10).cast("long"))
    return F.aggregate(values, F.lit(0).cast("long"), lambda left, x: (left * F.when(x > 9, 100).otherwise(10) + x) % 97) == 1


def _card(least: int, most: int):
    return lambda m: F.when(F.length(_digits(m)).between(least, most), luhn(_digits(m))).otherwise(False)


#: Characters of an IBAN by country: the register of ISO 13616 and the countries that use the form without being in it.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    33: "RU",
}
#: A known country fixes where the number ends, whatever follows.  Any other number is in one piece or in groups of four
#: with a shorter one last, none of which begins a number itself.
_IBAN = "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:%s|%s)(?![A-Za-z0-9])" % (
    "|".join(
        rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:[\x20]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])"
        for n, codes in _IBAN_LENGTHS.items()
    ),
    r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:[\x20](?![A-Z]{2}[0-9]{2}[\x20])[A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?:[\x20][A-Z0-9]{1,3}(?![A-Za-z0-9]))?+)",
)


def _iban(match: Column) -> Column:
    account = F.regexp_replace(match, "[ ]", "")
    return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(False)


#: Base kinds first, in the order in which spans are listed.
BASE = (
    # A match inside a run of its first characters could begin where the run does, unless the last match ended there.
    Kind(
        "email", rf"(?:(?<!{_EMAIL_CHARS})|\G){_EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), "@", 0.9,
        "mail|contact|write|kontakt|correo|courriel",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda m: m.rlike(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?(?:\.|$)){4}$"), ".", 0.6,
        r"\bip\b|host|server|address|login",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card(16, 19), None, 0.8, "card|visa|credit|payment|karte|tarjeta|carte"),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(8, 15), "+", 0.7,
        r"phone|call|\btel\b|mobile|fax|whatsapp",
    ),
)
ADDED = (
    Kind("iban", _IBAN, _iban, None, 0.8, "iban|account|konto|cuenta|compte"),
    Kind("card15", r"(?<![0-9])3[47](?:[\x20-]?[0-9]){13}(?![\x20-]?[0-9])", _card(15, 15), None, 0.4, "card|amex|american express|credit"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), "-", 0.3, r"\bssn\b|social security"),
    Kind(
        "phone_local", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", lambda m: F.lit(True), None, 0.3,
        r"phone|call|\btel\b|mobile|fax|whatsapp",
    ),
)
KINDS = (*BASE, *ADDED)
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _matches(text: Column, kind: Kind) -> Column:
    """(text, start, end) of every match, leftmost and not overlapping, that the kind's check confirms."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    # There is one gap more than there are matches.
    steps = F.slice(
        F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))), 1, F.size(found)
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int,end:int>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.array(F.struct(x["match"].alias("match"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(kind.holds(x["match"]), F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda state: state["out"])


def _spans(text: Column, kind: Kind, base: bool) -> Column:
    """The kind's spans with scores; added kinds only from LEAST_SCORE on."""

    def scored(x: Column) -> Column:
        before = F.greatest(x["start"] - CONTEXT, F.lit(0))
        near = F.concat_ws("\n", F.substring(text, before + 1, x["start"] - before), F.substring(text, x["end"] + 1, F.lit(CONTEXT)))
        score = F.when(F.lower(near).rlike(kind.words), min(1.0, kind.score + 0.3)).otherwise(kind.score)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    spans = F.transform(_matches(text, kind), scored)
    return spans if base else F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)


def with_spans(df: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """The rows with ``into``: (kind, start, end, score) of all spans by kind and start, in code points.

    Other columns of the rows stay as they are.  Each kind is one column until
    they are joined, so that texts without its mark skip it.
    """
    text = whole(text_col)
    none = F.array().cast(SPAN)
    columns = {}
    for kind in KINDS:
        possible = text.contains(kind.needs) if kind.needs else text.rlike("[0-9]")
        possible = possible & text.rlike(kind.pattern)
        columns[free_name(df, f"_pii_{kind.name}")] = F.when(possible, _spans(text, kind, kind in BASE)).otherwise(none)
    return df.withColumns(columns).withColumn(into, F.concat(*columns)).drop(*columns)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and pii.

    Null and empty texts have none.  Rows are read one by one: repeated rows
    repeat their spans, other columns are not looked at, and an empty table
    gives no rows.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(rows).select("doc_id", "pii")


def pii_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("pii", lambda x: x["kind"].isin([k.name for k in BASE]))
    return found.select(
        "doc_id", *(count(k.name).alias(f"n_{k.name}") for k in BASE), F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("pii")).alias("spans"),
    )


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span replaced by its kind in angle brackets; of overlapping spans the first, then the longest, counts.

    Null and empty texts stay as they are.  Rows are read one by one, so
    repeated rows stay equal, ids and other columns of any name stay, and an
    empty table gives no rows.
    """
    text, spans = F.col(text_col), free_name(df, "pii")

    def step(state: Column, x: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, x["start"] - state["at"])
        return F.when(
            x["start"] >= state["at"],
            F.struct(x["end"].alias("at"), F.concat(state["out"], kept, F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out")),
        ).otherwise(F.struct(F.greatest(state["at"], x["end"]).alias("at"), state["out"].alias("out")))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), x["kind"].alias("kind"), x["end"].alias("end"))))
    rebuilt = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    return (
        with_spans(df, text_col, spans).withColumn(text_col, F.when(F.size(spans) > 0, rebuilt).otherwise(text)).drop(spans)
    )
