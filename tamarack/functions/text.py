"""Text functions as Column expressions; all of them run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Malay and English words that carry no search meaning.
STOP_WORDS = (
    "apa apakah yang dan di ke dari daripada pada semasa tahun untuk dengan ialah adalah itu ini saya mahu nak ingin tentang dalam telah oleh atau berlaku "
    "the what when in of a an and was during to is"
).split()

SPACE = r"(?U)\s+"


def terms(text: Column) -> Column:
    """Search terms in order, repeats kept: lower-case runs of letters and digits, longer than one, no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits; marks and underscores separate words."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(text: str) -> list[str]:
    """Distinct search terms of a question that the caller has as a string."""
    found = [w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) > 1 and w not in STOP_WORDS]
    return list(dict.fromkeys(found))


def clean(text: Column) -> Column:
    """White-space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def strip(text: Column) -> Column:
    """No white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column) -> Column:
    """Lower case; whatever is no letter or digit separates words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def word_edge(pattern: str) -> str:
    """The pattern between ASCII word boundaries, which accented letters don't count for, in any letter case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def report_voice(text: Column) -> Column:
    """First person becomes the complainant; closing marks go."""
    out = clean(text)
    for word, other in (("Saya", "Pengadu"), ("saya", "pengadu"), ("Kami", "Para pengadu"), ("kami", "para pengadu")):
        out = F.regexp_replace(out, word_edge(word).replace("(?i)", "", 1), other)
    return F.regexp_replace(out, r"[.!;\s]+$", "")


def shorten(text: Column, most: int) -> Column:
    """At most `most` characters and an ellipsis, cut before a word."""
    whole = clean(text)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, most), r"\s+\S*$", ""), F.lit("…")))


def sentences(text: Column) -> Column:
    """Pieces that end in . ! ? or ;"""
    return F.split(text, r"(?<=[.!?;])\s+")


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def tidy(text: Column) -> Column:
    """Runs of blanks and tabs become one space, three and more line ends two, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[\t ]+", " "), r"\n{3,}", "\n\n"))


def model_json(text: Column) -> Column:
    """The JSON part of a model's answer: without its thinking and code fences."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(out, r"^```(?:json)?\s*|\s*```$", ""))


def fixed_chunks(text: Column, size: int = 1400) -> Column:
    """Consecutive pieces of `size` characters."""
    whole = F.coalesce(text, F.lit(""))
    starts = F.when(F.length(whole) > 0, F.sequence(F.lit(0), F.length(whole) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(whole, i + 1, F.lit(size)))


#: Month names.
MONTHS = "Januari Februari Mac April Mei Jun Julai Ogos September Oktober November Disember".split()


def malay_date(date: Column) -> Column:
    """25 September 2026."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(date))
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), name, F.year(date).cast("string"))


def grouped(number: Column) -> Column:
    """3,000"""
    return F.format_number(number, 0)
