"""Malay number words and number checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, normalize

#: The words for 0 to 11.
UNITS = "kosong satu dua tiga empat lima enam tujuh lapan sembilan sepuluh sebelas".split()


def _unit(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, UNITS)), n.cast("int") + 1)


def _under_100(n: Column) -> Column:
    tens, rest = F.floor(n / 10), n % 10
    tail = F.when(rest > 0, F.concat(F.lit(" "), _unit(rest))).otherwise("")
    return F.when(n < 12, _unit(F.least(n, F.lit(11)))).when(n < 20, F.concat(_unit(rest), F.lit(" belas"))).otherwise(F.concat(_unit(F.least(tens, F.lit(9))), F.lit(" puluh"), tail))


def _under_1000(n: Column) -> Column:
    rest = n % 100
    tail = F.when(rest > 0, F.concat(F.lit(" "), _under_100(rest))).otherwise("")
    return F.when(n < 100, _under_100(n % 100)).otherwise(F.concat(_unit(F.least(F.floor(n / 100), F.lit(9))), F.lit(" ratus"), tail))


def number_words(n: Column) -> Column:
    """Words of 0 to 99,999, else empty. Thousands are read out as numbers of their own."""
    rest = n % 1000
    tail = F.when(rest > 0, F.concat(F.lit(" "), _under_1000(rest))).otherwise("")
    words = F.when(n < 1000, _under_1000(rest)).otherwise(F.concat(_under_100(F.least(F.floor(n / 1000), F.lit(99))), F.lit(" ribu"), tail))
    return F.when(n.between(0, 99_999), words).otherwise("")


def spoken_number(words: Column) -> Column:
    """The number that words say, null if one of them is no number word.

    Tens and hundreds count for the digit before them only, so 250 and 2,050 differ; seratus and seribu are known.
    """
    state = "struct<total:int,group:int,digit:int,ok:boolean>"

    def make(total, group, digit, ok) -> Column:
        return F.struct(total.alias("total"), group.alias("group"), digit.alias("digit"), ok.alias("ok")).cast(state)

    zero, position = F.lit(0), lambda w: F.array_position(F.array(*map(F.lit, UNITS)), w).cast("int")

    def step(s: Column, w: Column) -> Column:
        t, g, d, ok = s["total"], s["group"], s["digit"], s["ok"]
        return (
            F.when(position(w) > 0, make(t, g, d + position(w) - 1, ok))
            .when(w == "belas", make(t, g, d + 10, ok))
            .when(w == "puluh", make(t, g + d * 10, zero, ok))
            .when(w == "ratus", make(t, g + d * 100, zero, ok))
            .when(w == "seratus", make(t, g + 100, zero, ok))
            .when(w == "ribu", make(t + F.greatest(g + d, F.lit(1)) * 1000, zero, zero, ok))
            .when(w == "seribu", make(t + 1000, zero, zero, ok))
            .otherwise(make(t, g, d, F.lit(False)))
        )

    whole = F.split(normalize(words), " ")
    return F.aggregate(whole, make(zero, zero, zero, F.lit(True)), step, lambda s: F.when(s["ok"], s["total"] + s["group"] + s["digit"]))


def number_tokens(text: Column) -> Column:
    """Numbers and amounts as they are written."""
    return F.regexp_extract_all(clean(text), F.lit(r"(?i)(?:RM\s*)?\d[\d,.]*"), F.lit(0))


def no_new_numbers(value: Column, evidence: Column) -> Column:
    """Every number of the value stands in the evidence, in digits or in words. A number without words is no proof."""
    known = normalize(evidence)

    def backed(token: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(token, r"(?i)RM\s*", ""), r",", "")
        whole = F.regexp_extract(plain, r"^(\d{1,9})(?:\.0*)?$", 1)
        words = F.when(whole != "", number_words(F.nullif(whole, F.lit("")).try_cast("int")))
        return F.contains(known, normalize(token)) | (F.coalesce(words, F.lit("")) != "") & F.contains(known, words)

    return F.forall(number_tokens(value), lambda t: F.coalesce(backed(t), F.lit(False)))
