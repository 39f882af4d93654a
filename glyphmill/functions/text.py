"""Text functions as column expressions: check letters, amounts in words, machine-readable lines, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights and check letters of the published identity-number scheme.
NRIC_WEIGHTS = (2, 7, 6, 5, 4, 3, 2)
ST_LETTERS, FG_LETTERS = "JZIHGFEDCBA", "XWUTRQPNMLK"
#: Number words.
UNITS = "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN".split()
TENS = "TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()


def nric_letter(prefix: Column, digits: Column) -> Column:
    """Check letter of seven digits behind a prefix S, T, F or G."""
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(NRIC_WEIGHTS)), F.lit(0))
    at = ((total + F.when(prefix.isin("T", "G"), 4).otherwise(0)) % 11 + 1).cast("int")
    return F.when(prefix.isin("S", "T"), F.substring(F.lit(ST_LETTERS), at, F.lit(1))).when(prefix.isin("F", "G"), F.substring(F.lit(FG_LETTERS), at, F.lit(1)))


def nric_valid(number: Column) -> Column:
    ok = number.rlike("^[STFG][0-9]{7}[A-Z]$")
    return F.when(ok, F.substring(number, 9, 1) == nric_letter(F.substring(number, 1, 1), F.when(ok, F.substring(number, 2, 7)))).otherwise(F.lit(False))


def _words(n: Column, words: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), n.cast("int"))


def under_hundred(n: Column) -> Column:
    ten, one = F.floor(n / 10), n % 10
    tens = F.when(n >= 20, _words(F.greatest(ten - 1, F.lit(1)), TENS))
    return F.when(n < 20, _words(F.least(n, F.lit(19)) + 1, UNITS)).when(one == 0, tens).otherwise(F.concat(tens, F.lit(" "), _words(one + 1, UNITS)))


def under_thousand(n: Column) -> Column:
    hundred, rest = F.floor(n / 100), n % 100
    head = F.concat(_words(hundred + 1, UNITS), F.lit(" HUNDRED"))
    return F.when(n < 100, under_hundred(n)).when(rest == 0, head).otherwise(F.concat(head, F.lit(" AND "), under_hundred(rest)))


def amount_in_words(cents: Column) -> Column:
    """An amount below a million, given in cents."""
    whole, left = F.floor(cents / 100), cents % 100
    thousands, rest = F.floor(whole / 1000), whole % 1000
    head = F.when(thousands > 0, F.concat(under_thousand(thousands), F.lit(" THOUSAND")))
    tail = F.when((rest > 0) | (thousands == 0), under_thousand(rest))
    cents_part = F.when(left > 0, F.concat(F.lit(" AND "), under_thousand(left), F.lit(" CENTS"))).otherwise("")
    return F.concat(F.concat_ws(" ", head, tail), F.lit(" DOLLARS"), cents_part, F.lit(" ONLY"))


def money(value: Column) -> Column:
    return F.format_number(value, 2)


def mrz_pad(s: Column, n: int) -> Column:
    return F.rpad(F.regexp_replace(F.upper(s), "[^A-Z0-9]", "<"), n, "<")


def mrz_lines(surname: Column, given: Column, number: Column, birth: Column, expiry: Column, sex: Column, checks: Column) -> tuple[Column, Column]:
    """Two lines of 44 characters. checks: five digits as text, in order."""
    c = lambda i: F.substring(checks, i, 1)
    first = F.concat(F.lit("P<SGP"), mrz_pad(F.concat(surname, F.lit("<<"), given), 39))
    second = F.concat(mrz_pad(number, 9), c(1), F.lit("SGP"), F.date_format(birth, "yyMMdd"), c(2), sex, F.date_format(expiry, "yyMMdd"), c(3), F.lit("<" * 14), c(4), c(5))
    return first, second


def account_number(a: Column, b: Column, c: Column) -> Column:
    return F.format_string("%03d-%06d-%d", a, b, c)


def tokens(text: Column) -> Column:
    """array<struct<word, start>>: words between single spaces and their offsets; spaces keep their place, empty words drop out."""
    parts = F.split(text, " ")
    with_start = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,start:int>>").alias("out")),
        lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), F.when(F.length(w) == 0, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(w.alias("word"), s["at"].alias("start"))))).alias("out")),
        lambda s: s["out"],
    )
    return with_start


def flatten_text(lines: Column) -> Column:
    """Texts of an array of structs that have one, a line each."""
    texts = F.transform(lines, lambda b: b["text"])
    return F.array_join(F.filter(texts, lambda t: F.length(F.trim(F.coalesce(t, F.lit("")))) > 0), "\n")


#: Invented field values.
FAMILY = ("ALDER", "BROOK", "CLAY", "DUNE", "ELM", "FERN", "GLEN", "HEATH", "IVES", "LARK", "MOSS", "NASH")
GIVEN = ("ANNA", "BEN", "CARA", "DAVID", "EVA", "FINN", "GRETA", "HUGO", "INES", "JONAS")
STREETS = ("NORTH ROAD", "HARBOUR STREET", "MILL LANE", "STATION AVENUE", "GARDEN WALK", "HILL RISE 3")


def pick(k: Column, values: tuple[str, ...]) -> Column:
    """The value at k, starting anew behind the last; k is 0 or more."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def person_name(k: Column) -> Column:
    """Family and given name of number k; all combinations occur."""
    return F.concat(pick(k, FAMILY), F.lit(" "), pick(F.floor(k / len(FAMILY)), GIVEN))


def address(k: Column) -> Column:
    """Three lines: block and street, unit, town and a postal code of six digits."""
    unit = F.format_string("#%02d-%03d", (1 + k % 24).cast("int"), (1 + k * 7 % 399).cast("int"))
    return F.array(F.concat(F.lit("BLK "), (1 + k * 3 % 899).cast("string"), F.lit(" "), pick(k, STREETS)), unit, F.concat(F.lit("SINGAPORE "), (100000 + k * 7919 % 729999).cast("string")))


def birth_date(k: Column) -> Column:
    """A day of the 55 years from 1950 on."""
    return F.date_add(F.lit("1950-01-01").cast("date"), (k % (365 * 55)).cast("int"))


def recent_date(k: Column) -> Column:
    """One of 300 days from the start of 2026 on."""
    return F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int"))
