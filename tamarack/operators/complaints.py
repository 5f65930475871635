"""Complaint statements into fields with their evidence, a summary and a chronology; one row in, one row out.

Input rows have `transcript` and what a model proposed (all may be null or empty): fields MAP<STRING, STRUCT<value,
evidence ARRAY<STRING>, confidence DOUBLE, literal BOOLEAN>>, themes ARRAY<STRUCT<quote>>, title STRING, items
ARRAY<STRUCT<description, quote>>, events ARRAY<STRUCT<event, quote>>. A proposal only counts with words of the
statement behind it; the rules fill what is then still unknown. Each step is a column expression on the columns of the
step before: v_<field> holds a value and e_<field> the quotes behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import no_new_numbers, spoken_number
from ..functions.text import MONTHS, clean, grouped, normalize, report_voice, shorten, word_edge
from .rules import CAUSE, MANNER, category, supported
from .rules import PERSON as PERSON_WORDS

FIELDS = ["apa", "siapa", "bila", "dimana", "kenapa", "bagaimana", "jumlah"]
PROPOSAL = (
    "fields map<string,struct<value:string,evidence:array<string>,confidence:double,literal:boolean>>, themes array<struct<quote:string>>, title string, "
    "items array<struct<description:string,quote:string>>, events array<struct<event:string,quote:string>>"
)
_QUOTES = "array<string>"

#: Patterns of the statement language.
_MONTH = "|".join(MONTHS)
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
GATES = {
    "apa": r"(?i)meminta|bayaran|rasuah|suapan|rosak|gagal|lewat|lambat|tidak|hilang|aduan",
    "bila": rf"(?i)\d{{1,2}}\s+(?:{_MONTH})|\d{{1,2}}[:.]\d{{2}}|pagi|petang|malam",
    "dimana": r"(?i)jalan|taman|kampung|pejabat|dewan|sekolah|hospital|kaunter|bandar|balai|kedai|perpustakaan|pusat",
}
REQUEST = rf"(?i)^(?:saya|kami|pengadu)\s+(?:ingin|hendak|mahu|nak)\s+(?:membuat|mengemukakan)\s+aduan{_E}"
DATE = rf"(?i){_B}\d{{1,2}}\s+(?:{_MONTH})\s+(?:19|20)\d{{2}}{_E}"
SPOKEN_DATE = rf"(?i){_B}pada\s+((?:\w+\s+){{1,5}}?)(setember|{_MONTH})\s+((?:\w+\s*){{2,6}})"
YEAR_END = rf"(?i){_B}(?:lebih|kurang|jam|perbualan|berlaku){_E}"
TIME = rf"(?i){_B}(?:kira-kira\s+)?jam\s+\d{{1,2}}(?:[.:]\d{{2}})?\s*(?:pagi|petang|malam)?{_E}"
SPOKEN_TIME = rf"(?i){_B}(?:lebih kurang|kira-kira)?\s*jam\s+(satu|dua|tiga|empat|lima|enam|tujuh|lapan|sembilan|sepuluh|sebelas|dua belas)\s*(pagi|petang|malam)?{_E}"
PLACES = (
    rf"(?i){_B}(?:di|berhampiran|dalam)\s+((?:Jalan|Taman|Kampung|Pejabat|Dewan|Sekolah|Hospital|Kaunter|Bandar|Balai|Kedai|Perpustakaan|Pusat)\s+[^,.!?]{{2,100}}?)"
    r"(?=\s+dan\s+(?:meminta|menyebut|memberi|mengambil|membayar)|[,.!?]|$)"
)
SPOKEN_PLACES = rf"(?i){_B}(?:di|berlaku di)\s+(?:sebuah\s+)?((?:counter|kaunter|kedai makan)\s+[^,.!?]{{2,90}}?)(?=\s+(?:selepas|kemudian|beliau|pada|semasa|dan\s+meminta)|[,.!?]|$)"
PERSON = rf"(?i){_B}(?:En\s*C|Encik|Puan|Tuan)\s+[A-Z][\p{{L}}]{{2,}}{_E}"
AMOUNT = rf"(?i){_B}RM\s*\d[\d,.]*"
SPOKEN_AMOUNT = rf"(?i){_B}((?:satu|dua|tiga|empat|lima|enam|tujuh|lapan|sembilan|sepuluh)(?:\s+(?:ratus|ribu|puluh|\w+)){{0,3}})\s+ringgit{_E}"
ACTION = rf"(?i){_B}(?:meminta|menuntut)\s+(?:saya\s+)?(?:membayar\s+)?(?:RM\s*[\d,.]+|(?:\w+\s+){{0,3}}ringgit)[^.!?]{{0,100}}"
PURPOSE = rf"(?i){_B}(?:untuk|supaya|bagi)\s+(?:memberi|mempercepatkan|memastikan|mendapat|meluluskan)[^.!?]{{0,120}}"
METHOD = rf"(?i){_B}(?:meminta|mengarahkan)[^.!?]{{0,120}}{_B}(?:secara tunai|tanpa resit|melalui|bayaran tambahan)[^.!?]{{0,80}}"
CASH = rf"(?i){_B}(?:meminta\s+)?bayaran\s+dibuat\s+secara\s+tunai\s+tanpa\s+(?:resit|risit){_E}"
ITEMS = [
    (rf"(?i){_B}(?:mesej|message)\s+WhatsApp{_E}", "Mesej WhatsApp"), (rf"(?i){_B}rakaman\s+perbualan{_E}", "Rakaman perbualan"),
    (rf"(?i){_B}rancaman\s+perbualan{_E}", "Perbualan disebut sebagai bukti (semak transkrip ASR)"),
]
EVENT_SPLIT = r"(?i)(?<=[.!?])\s+|\s+(?=Selepas itu|Kemudian|Pada mulanya|Semasa pertemuan)"
EVENT = r"(?i)pada\s+\d|berurusan|kaunter|counter|menyebut|berjumpa|meminta"
NO_EVENT = rf"(?i)^saya ingin membuat aduan{_E}|(?:mempunyai|memiliki)\s+(?:mesej|message|rakaman)"
QUESTIONS = {
    "Apa": ("apa", "Apakah kejadian utama yang ingin diadukan?"), "Siapa": ("siapa", "Siapakah pihak yang terlibat?"), "Bila": ("bila", "Bilakah kejadian berlaku?"),
    "Di mana": ("dimana", "Di manakah kejadian berlaku?"), "Mengapa": ("kenapa", "Adakah tujuan atau sebab tindakan itu dinyatakan?"), "Bagaimana": ("bagaimana", "Bagaimanakah tindakan itu berlaku?"),
}
CONCLUSION = "Draf ini dijana daripada keterangan pengadu dan memerlukan pengesahan manusia sebelum digunakan sebagai aduan rasmi."
UNKNOWN = "Maklumat kejadian belum cukup untuk diringkaskan."
BRIBERY = "Rasuah / Permintaan Suapan"


def _t() -> Column:
    return F.col("transcript")



def first(pattern: str, group: int = 0) -> Column:
    """The first match in the statement, or null."""
    return F.nullif(F.regexp_extract(_t(), pattern, group), F.lit(""))


def within(whole: Column, part: Column) -> Column:
    """The part's words stand in the whole; false where the part has none."""
    return (normalize(part) != "") & F.contains(normalize(whole), normalize(part))


def _v(key: str) -> Column:
    return F.col(f"v_{key}")


def _e(key: str) -> Column:
    return F.col(f"e_{key}")


def _set(df: DataFrame, key: str, when: Column, value: Column, evidence: Column) -> DataFrame:
    """Sets a field and its evidence in the rows where `when` is true."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumn("_hit", hit).withColumn("_val", value).withColumn("_evi", evidence).withColumns(
        {f"v_{key}": F.when(F.col("_hit"), F.col("_val")).otherwise(_v(key)), f"e_{key}": F.when(F.col("_hit"), F.col("_evi")).otherwise(_e(key))}
    ).drop("_hit", "_val", "_evi")


def proposed_fields(df: DataFrame) -> DataFrame:
    """Proposals that the statement backs: with quotes, or as literal words that answer the field.

    One expression over the array of field names, so the plan holds each check once.
    """
    names = F.array(*map(F.lit, FIELDS))

    def read(key: Column) -> Column:
        entry = F.col("fields")[key]
        quotes = F.filter(F.transform(F.coalesce(entry["evidence"], F.array().cast(_QUOTES)), clean), lambda q: (F.length(q) >= 5) & within(_t(), q))
        literal, conf = F.coalesce(entry["literal"], F.lit(False)), F.coalesce(entry["confidence"], F.lit(0.0))
        return F.struct(key.alias("key"), clean(entry["value"]).alias("value"), quotes.alias("quotes"), literal.alias("literal"), conf.alias("conf"))

    def judge(p: Column) -> Column:
        key, value = p["key"], p["value"]
        fits = within(_t(), value)
        answers = F.lit(True)
        for name, pattern in GATES.items():
            answers = F.when(key == name, value.rlike(pattern)).otherwise(answers)
        for name, text, words in (("siapa", value, PERSON_WORDS), ("kenapa", _t(), CAUSE), ("bagaimana", _t(), MANNER)):
            answers = F.when(key == name, text.rlike(word_edge(words))).otherwise(answers)
        backed = (value != "") & (F.size(p["quotes"]) > 0) & no_new_numbers(value, F.array_join(p["quotes"], " "))
        return F.struct(value.alias("value"), p["quotes"].alias("quotes"), p["conf"].alias("conf"), F.coalesce(backed, F.lit(False)).alias("backed"), F.coalesce(p["literal"] & fits & answers, F.lit(False)).alias("literal"))

    df = df.withColumn("_read", F.transform(names, read)).withColumn("_p", F.transform("_read", judge))
    columns = {}
    for i, key in enumerate(FIELDS):
        p = F.get("_p", F.lit(i))
        columns |= {
            f"v_{key}": F.when(p["backed"] | p["literal"], F.substring(p["value"], 1, 80 if key == "jumlah" else 450)),
            f"e_{key}": F.when(p["backed"], F.slice(p["quotes"], 1, 4)).when(p["literal"], F.array(p["value"])).otherwise(F.array().cast(_QUOTES)),
            f"c_{key}": F.when(p["backed"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["conf"]))),
        }
    df = df.withColumns(columns).drop("_read", "_p")
    asks = F.coalesce(_v("apa").rlike(REQUEST), F.lit(False))
    return df.withColumns({"v_apa": F.when(~asks, _v("apa")), "e_apa": F.when(~asks, _e("apa")).otherwise(F.array().cast(_QUOTES)), "c_apa": F.when(~asks, F.col("c_apa"))})


def when_fields(df: DataFrame) -> DataFrame:
    """Date and time of the statement, written or spoken."""
    df = df.withColumns({"_date": first(DATE), "_has": _v("bila").isNotNull()})
    date = F.col("_date")
    missing = date.isNotNull() & (~F.col("_has") | ~F.contains(normalize(_v("bila")), normalize(date)))
    df = _set(df, "bila", missing, F.concat_ws(", ", date, _v("bila")), F.concat(F.array(date), _e("bila")))
    year = F.trim(F.get(F.split(F.col("_s3"), YEAR_END), F.lit(0)))
    df = df.withColumns({f"_s{i}": first(SPOKEN_DATE, i) for i in range(4)}).withColumn("_year", year)
    df = df.withColumns({"_d": spoken_number(F.col("_s1")), "_y": spoken_number(F.col("_year"))})
    month = F.when(F.lower("_s2") == "setember", "September").otherwise(F.col("_s2"))
    said = F.concat(F.substring(F.col("_s0"), F.lit(1), F.length("_s0") - F.length("_s3")), F.col("_year"))
    ok = date.isNull() & F.col("_d").between(1, 31) & F.col("_y").between(1900, 2100)
    df = _set(df, "bila", ok, F.concat_ws(" ", F.col("_d").cast("string"), month, F.col("_y").cast("string")), F.array(said))
    df = df.withColumns({"_time": first(TIME), "_st": first(SPOKEN_TIME), "_hour": F.regexp_extract(_t(), SPOKEN_TIME, 1), "_part": F.regexp_extract(_t(), SPOKEN_TIME, 2)})
    time = F.rtrim("_time")
    df = _set(df, "bila", F.col("_time").isNotNull() & _v("bila").isNotNull() & ~F.contains(normalize(_v("bila")), normalize(time)), F.concat_ws(", ", _v("bila"), time), F.concat(_e("bila"), F.array(time)))
    spoken = F.rtrim(F.concat(_v("bila"), F.lit(", kira-kira jam "), spoken_number(F.col("_hour")).cast("string"), F.lit(" "), F.col("_part")))
    df = _set(df, "bila", F.col("_time").isNull() & F.col("_st").isNotNull() & _v("bila").isNotNull(), spoken, F.concat(_e("bila"), F.array(F.trim("_st"))))
    return df.drop("_date", "_has", *(f"_s{i}" for i in range(4)), "_year", "_d", "_y", "_time", "_st", "_hour", "_part")


def where_fields(df: DataFrame) -> DataFrame:
    """Places of the statement, one after another; of places inside one another the longest stays."""
    state = "struct<text:string,quotes:array<string>>"

    def add(both: bool):
        def step(s: Column, p: Column) -> Column:
            known = F.contains(normalize(s["text"]), normalize(p)) | (F.contains(normalize(p), normalize(s["text"])) & (s["text"] != "") if both else F.lit(False))
            text = F.when(s["text"] == "", p).otherwise(F.concat(s["text"], F.lit("; "), p))
            return F.when(known & (s["text"] != ""), s).otherwise(F.struct(text.alias("text"), F.concat(s["quotes"], F.array(p)).alias("quotes")).cast(state))

        return step

    found = lambda p: F.transform(F.regexp_extract_all(_t(), F.lit(p), F.lit(1)), F.trim)
    df = df.withColumns({"_p": found(PLACES), "_q": found(SPOKEN_PLACES)})
    start = F.struct(F.coalesce(_v("dimana"), F.lit("")).alias("text"), _e("dimana").alias("quotes")).cast(state)
    df = df.withColumn("_w", F.aggregate("_p", start, add(True))).withColumn("_w", F.aggregate("_q", F.col("_w"), add(False)))
    df = df.withColumn("_parts", F.filter(F.transform(F.split("_w.text", ";"), clean), lambda p: p != ""))
    longest = F.filter("_parts", lambda p: ~F.exists("_parts", lambda o: (F.length(normalize(o)) > F.length(normalize(p))) & F.contains(normalize(o), normalize(p))))
    df = df.withColumns({"v_dimana": F.nullif(F.array_join(longest, "; "), F.lit("")), "e_dimana": F.col("_w.quotes")})
    return df.drop("_p", "_q", "_w", "_parts")


def who_and_what_fields(df: DataFrame) -> DataFrame:
    """Person, amount, action, purpose and method."""
    one = lambda c: F.array(F.col(c) if isinstance(c, str) else c)
    df = df.withColumn("_x", first(PERSON))
    df = _set(df, "siapa", _v("siapa").isNull() & F.col("_x").isNotNull(), F.regexp_replace("_x", rf"(?i)^En\s*C{_E}", "Encik"), one("_x"))
    df = df.withColumn("_x", first(AMOUNT))
    df = _set(df, "jumlah", _v("jumlah").isNull() & F.col("_x").isNotNull(), clean(F.col("_x")), one("_x"))
    df = df.withColumns({"_x": first(SPOKEN_AMOUNT), "_n": spoken_number(first(SPOKEN_AMOUNT, 1))})
    df = _set(df, "jumlah", _v("jumlah").isNull() & F.col("_n").between(1, 99_999), F.concat(F.lit("RM"), grouped(F.col("_n"))), one("_x"))
    df = df.withColumn("_x", first(ACTION))
    df = _set(df, "apa", _v("apa").isNull() & F.col("_x").isNotNull(), F.substring(clean(F.col("_x")), 1, 180), one("_x"))
    spoken = _v("jumlah").isNotNull() & _v("apa").rlike(word_edge("ringgit")) & ~_v("apa").rlike(r"(?i)(?<![A-Za-z0-9_])RM\s*\d")
    shorter = F.regexp_replace(_v("apa"), r"(?i)^meminta\s+(?:saya|pengadu)\s+membayar\s+", "meminta bayaran ")
    df = df.withColumn("v_apa", F.when(spoken, F.concat(F.lit("meminta bayaran "), _v("jumlah"))).otherwise(shorter))
    df = df.withColumn("_x", first(PURPOSE))
    df = _set(df, "kenapa", _v("kenapa").isNull() & F.col("_x").isNotNull(), F.substring(clean(F.col("_x")), 1, 180), one("_x"))
    df = df.withColumn("_x", first(METHOD))
    df = _set(df, "bagaimana", _v("bagaimana").isNull() & F.col("_x").isNotNull(), F.substring(clean(F.col("_x")), 1, 220), one("_x"))
    df = df.withColumn("_x", first(CASH))
    df = _set(df, "bagaimana", F.col("_x").isNotNull() & ~F.contains(normalize(_v("bagaimana")), normalize(F.col("_x"))), F.concat_ws("; ", _v("bagaimana"), F.col("_x")), F.concat(_e("bagaimana"), one("_x")))
    return df.withColumns({f"v_{k}": report_voice_or_null(_v(k)) for k in ("apa", "kenapa", "bagaimana")}).drop("_x", "_n")


def report_voice_or_null(text: Column) -> Column:
    return F.when(text.isNotNull(), report_voice(text))


def report(df: DataFrame) -> DataFrame:
    """Topic, summary, themes, evidence items, chronology and open questions."""
    df = df.withColumns({"category": category(_t()), "_title": clean(F.col("title")), "_legacy": clean(supported("tajuk", F.col("fields")["tajuk"]["value"], _t()))})
    apa, lower = _v("apa"), lambda k: F.coalesce(_v(k), F.lit(""))
    demand = F.regexp_replace(F.regexp_replace(apa, r"(?i)^meminta\s+(?:pengadu\s+)?membayar\s+", "bayaran "), r"(?i)^meminta\s+", "")
    made = F.when(apa.isNull(), "Aduan untuk semakan").when(F.col("category") == BRIBERY, F.concat(F.lit("Dakwaan permintaan "), demand)).otherwise(F.concat(F.lit("Aduan "), apa))
    quotes = F.array_join(F.flatten(F.array(*[_e(k) for k in FIELDS])), " ")
    good = (
        (F.length("_title") >= 15) & ~F.col("_title").rlike(word_edge("saya|kami")) & ~F.col("_title").rlike(r"(?i)^(?:aduan|ajuan|tajuk|laporan)(?:\s+(?:pendek|ringkas|baru))?$")
        & no_new_numbers(F.col("_title"), F.coalesce(F.nullif(quotes, F.lit("")), _t())) & (_v("jumlah").isNull() | F.contains(normalize(F.col("_title")), normalize(_v("jumlah"))))
    )
    legacy = (F.col("_legacy") != "") & (F.length("_legacy") < 100)
    topic = F.when(good, F.substring("_title", 1, 130)).when(legacy, report_voice(F.col("_legacy"))).otherwise(F.substring(made, 1, 130))
    actor = F.when(_v("siapa").isNotNull(), F.concat(_v("siapa"), F.lit(" didakwa "))).otherwise("")
    why = F.when(_v("kenapa").isNotNull() & ~apa.rlike(word_edge("supaya|untuk|bagi")) & ~within(lower("apa"), _v("kenapa")), F.concat(F.lit(" "), _v("kenapa"))).otherwise("")
    one = F.when(apa.isNotNull(), F.concat(F.lit("Menurut pengadu, "), actor, apa, why, F.lit(".")))
    at = F.when(_v("bila").isNotNull(), F.concat(F.lit("pada "), F.regexp_replace(report_voice(_v("bila")), r"(?i)^pada\s+", "")))
    place = F.when(_v("dimana").isNotNull(), F.concat(F.lit("di "), F.regexp_replace(F.regexp_replace(report_voice(_v("dimana")), r"(?i)^di\s+", ""), r";\s*", " dan di ")))
    two = F.when(at.isNotNull() | place.isNotNull(), F.concat(F.lit("Kejadian dinyatakan berlaku "), F.concat_ws(" ", at, place), F.lit(".")))
    three = F.when(_v("bagaimana").isNotNull() & ~within(lower("apa"), _v("bagaimana")), F.concat(F.lit("Cara yang dinyatakan: "), _v("bagaimana"), F.lit(".")))
    summary = F.coalesce(F.nullif(F.substring(F.concat_ws(" ", one, two, three), 1, 1200), F.lit("")), F.lit(UNKNOWN))
    themes = F.filter(F.transform(F.col("themes"), lambda t: clean(t["quote"])), lambda q: (F.length(q) >= 8) & within(_t(), q))
    df = df.withColumns({"topic": topic, "summary": summary, "_themes": F.slice(F.coalesce(themes, F.array().cast(_QUOTES)), 1, 5)})
    df = df.withColumn("themes", F.transform("_themes", lambda q: F.struct(F.col("category").alias("label"), q.alias("quote"))))
    kind = "array<struct<description:string,quote:string>>"
    item = F.transform(F.col("items"), lambda i: F.struct(F.substring(F.coalesce(F.nullif(clean(i["description"]), F.lit("")), clean(i["quote"])), 1, 200).alias("description"), clean(i["quote"]).alias("quote")))
    df = df.withColumn("evidence_items", F.slice(F.coalesce(F.filter(item, lambda i: (F.length(i["quote"]) >= 5) & within(_t(), i["quote"])), F.array()).cast(kind), 1, 10))
    for pattern, name in ITEMS:
        df = df.withColumn("_x", first(pattern))
        new = F.col("_x").isNotNull() & ~F.exists("evidence_items", lambda i: within(i["quote"], F.col("_x")))
        more = F.array(F.struct(F.lit(name).alias("description"), F.col("_x").alias("quote"))).cast(kind)
        df = df.withColumn("evidence_items", F.when(new, F.concat("evidence_items", more)).otherwise(F.col("evidence_items")))
    steps = "array<struct<event:string,quote:string>>"
    own = F.filter(F.transform(F.col("events"), lambda e: F.struct(F.substring(report_voice(F.coalesce(F.nullif(e["event"], F.lit("")), clean(e["quote"]))), 1, 240).alias("event"), clean(e["quote"]).alias("quote"))), lambda e: (F.length(e["quote"]) >= 5) & within(_t(), e["quote"]) & ~e["quote"].rlike(rf"(?i)^saya ingin membuat aduan{_E}"))
    told = F.filter(F.transform(F.split(_t(), EVENT_SPLIT), clean), lambda q: (F.length(q) >= 18) & q.rlike(EVENT) & ~q.rlike(NO_EVENT))
    df = df.withColumns({"_own": F.slice(F.coalesce(own, F.array()).cast(steps), 1, 10), "_told": F.slice(F.transform(told, lambda q: F.struct(shorten(report_voice(q), 220).alias("event"), q.alias("quote"))), 1, 5).cast(steps)})
    df = df.withColumn("chronology", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_told")))
    open_ = F.filter(F.array(*[F.when(_v(k).isNull(), F.struct(F.lit(q).alias("field"), F.lit(text).alias("question"))) for q, (k, text) in QUESTIONS.items()]), lambda q: q.isNotNull())
    df = df.withColumns({"missing": F.transform(open_, lambda q: q["field"]), "followup_questions": F.transform(open_, lambda q: q["question"]), "amount": lower("jumlah"), "parties": lower("siapa"), "conclusion": F.lit(CONCLUSION), "review_required": F.lit(True)})
    return df.drop("_title", "_legacy", "_themes", "_x", "_own", "_told")


def analyze(statements: DataFrame) -> DataFrame:
    """The statements' rows with v_/e_ columns of the seven fields, topic, category, themes, summary, evidence_items, chronology, missing and more."""
    return report(who_and_what_fields(where_fields(when_fields(proposed_fields(statements)))))
