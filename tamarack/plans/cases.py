"""Queries on statements, numbers and OCR results: statements told by customers, and turns of conversations as lines of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import complaints, ocr, rules
from ..tables import inline, load, spread, sql_values
from . import sql as S
from .lexicon import LEXICON, LINES, PHRASES

#: What customers tell, in turn; AMOUNT, WORDS, DATE, PLACE and PERSON stand for values of their row.
TOLD = [
    "Saya nak buat aduan tentang lampu jalan rosak di PLACE pada DATE.", "PERSON meminta AMOUNT secara tunai tanpa resit untuk mempercepatkan kelulusan permit.", "buka ruang jawi dan baca tulisan tangan",
    "kembali ke carian arkib", "Permohonan saya lewat tiga bulan kerana pegawai cuti.", "Beliau meminta saya membayar WORDS ringgit untuk keutamaan.", "Terdapat tuntutan palsu dan resit palsu sebanyak AMOUNT.50 pada DATE.",
    "Penyalahgunaan kuasa oleh ketua jabatan.", "Saya dikenakan bayaran tambahan AMOUNT untuk cetakan dokumen di kaunter.", "", "Pada DATE saya pergi ke PLACE. Kemudian PERSON meminta AMOUNT daripada saya. Selepas itu saya membayar WORDS ringgit kepada beliau.",
]
MONTHS = ["Januari", "Februari", "Mac", "April", "Mei", "Jun", "Julai", "Ogos", "September", "Oktober", "November", "Disember"]
PLACES, PERSONS = ["Jalan Merdeka", "Jalan Hang Tuah", "Jalan Bukit Bintang"], ["Encik Ahmad", "Puan Siti", "Encik Hassan"]
OTHER = ["lampu jalan rosak", "pegawai cuti", "tiada dalam teks"]


def _pick(values: list[str], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def statements(spark, d):
    """n, text and the values that the text may hold, of every customer."""
    n = F.col("c_custkey")
    rows = spread(load(spark, d, "customer").select("c_custkey")).select(n.alias("n"), (n * 37 % 9000 + 1000).cast("int").alias("sum"), (n % 9 * 1000 + 1000 + n % 10 * 100).cast("int").alias("said"), _pick(PLACES, n).alias("place"), _pick(PERSONS, n + 1).alias("person"), _pick(TOLD, n).alias("t"))
    n = F.col("n")
    date = F.concat_ws(" ", (n % 28 + 1).cast("string"), _pick(MONTHS, n), (n % 40 + 1990).cast("string"))
    values = {"AMOUNT": F.concat(F.lit("RM"), F.format_number("sum", 0)), "WORDS": N.number_words(F.col("said")), "DATE": date, "PLACE": F.col("place"), "PERSON": F.col("person")}
    text = F.col("t")
    for name, value in values.items():
        text = F.replace(text, F.lit(name), value)
    return rows.select("n", text.alias("text"), "sum", "place", "person")


def navigation_intent(spark, d):
    """Requests of the inline statements and of every conversation turn."""
    turns = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), "text")
    return statements(spark, d).select(F.col("n").cast("long"), "text").union(turns).select("n", rules.navigation_intent(F.col("text")).alias("page"))


def complaint_category(spark, d):
    turns = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), "text")
    return statements(spark, d).select(F.col("n").cast("long"), "text").union(turns).select("n", rules.category(F.col("text")).alias("category"))


def supported_fields(spark, d):
    """Each field with a value that the statement may or may not hold."""
    known = F.array(F.col("place"), F.col("person"), *map(F.lit, OTHER))
    fields = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field")) for i, f in enumerate(rules.SUPPORTED_FIELDS)])
    rows = statements(spark, d).withColumn("f", F.explode(fields)).select("n", "text", "f.field", F.element_at(known, ((F.col("n") + F.col("f.i")) % 5 + 1).cast("int")).alias("value"))
    fits = F.lit(None)
    for f in rules.SUPPORTED_FIELDS:
        fits = F.when(F.col("field") == f, rules.supported(f, F.col("value"), F.col("text"))).otherwise(fits)
    return rows.select("n", "field", "value", fits.isNotNull().alias("supported"))


def _numbers(spark, d):
    return load(spark, d, "events").select("event_id", (F.col("event_id") * 7919 % 100_003).cast("int").alias("n"))


def number_words(spark, d):
    return _numbers(spark, d).select("event_id", "n", N.number_words(F.col("n")).alias("words"))


def spoken_number(spark, d):
    """Numbers read out and understood again; every tenth one with a word that is no number."""
    words = F.concat(N.number_words(F.col("n")), F.when(F.col("event_id") % 10 == 0, " rumah").otherwise(""))
    return _numbers(spark, d).withColumn("words", words).select("event_id", "words", N.spoken_number(F.col("words")).alias("n"))


def no_new_numbers(spark, d):
    """An amount beside evidence that has it in words, in digits, as another number, or not at all."""
    amount = F.format_number("n", 0)
    told = [F.concat(F.lit("meminta "), N.number_words(F.col("n")), F.lit(" ringgit")), F.concat(F.lit("RM"), amount, F.lit(" tunai")), F.concat(F.lit("meminta "), N.number_words(F.col("n") + 1)), F.lit("apa sahaja")]
    evidence = F.element_at(F.array(*told), (F.col("event_id") % 4 + 1).cast("int"))
    rows = _numbers(spark, d).select("event_id", F.concat(F.lit("bayar RM"), amount).alias("value"), evidence.alias("evidence"))
    return rows.select("event_id", N.no_new_numbers(F.col("value"), F.col("evidence")).alias("ok"))


def _first(pattern: str):
    return F.nullif(F.regexp_extract("text", pattern, 0), F.lit(""))


def extract_dates(spark, d):
    return statements(spark, d).select("n", _first(complaints.DATE).alias("date"))


def extract_amounts(spark, d):
    said = N.spoken_number(F.nullif(F.regexp_extract("text", complaints.SPOKEN_AMOUNT, 1), F.lit("")))
    return statements(spark, d).select("n", F.coalesce(T.clean(_first(complaints.AMOUNT)), F.lit("")).alias("amount"), said.alias("spoken"))


def extract_places(spark, d):
    return statements(spark, d).select("n", F.regexp_extract_all("text", F.lit(complaints.PLACES), F.lit(1)).alias("p")).select("n", F.array_join("p", "|").alias("places"))


def chronology(spark, d):
    told = F.filter(F.transform(F.split("text", complaints.EVENT_SPLIT), T.clean), lambda q: (F.length(q) >= 18) & q.rlike(complaints.EVENT) & ~q.rlike(complaints.NO_EVENT))
    return statements(spark, d).select("n", F.size(told).alias("events"))


def complaint_analysis(spark, d):
    empty = [F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ", 1)[0]) for t in complaints.PROPOSAL.split(", ") if " " in t]
    rows = statements(spark, d).select("n", F.col("text").alias("transcript"), *empty)
    return complaints.analyze(rows).select("n", "topic", "category", "summary", "amount", "parties", F.array_join("missing", ",").alias("missing"), F.size("chronology").alias("events"))


def results(spark, d):
    """Conversations as OCR results, a turn a word; some have a word with a blank, a box without area, no words, or copied labels."""
    kind, word = F.col("conv_id") % 6, F.concat(F.lit("a"), F.col("turn").cast("string"))
    x = (F.col("turn") % 15 * 60).cast("double")
    text = F.when((kind == 2) & (F.col("turn") == 0), "dua kata").otherwise(F.substring(F.md5("text"), 1, 12))
    right = F.when((kind == 5) & (F.col("turn") == 0), x).otherwise(x + 50)
    box = F.array(x, F.lit(10.0), right, F.lit(40.0))
    en = F.when(kind == 3, "English").otherwise(F.concat("role", F.col("turn").cast("string")))
    one = F.struct(F.col("turn").alias("turn"), F.struct(word.alias("id"), F.col("turn").cast("int").alias("line"), text.alias("text"), box.alias("box"), F.lit(0.9).alias("confidence")).alias("w"), F.struct(F.array(word, F.lit("z")).alias("wordIds"), F.col("role").alias("rumi"), F.col("role").alias("bm"), en.alias("en")).alias("s"))
    rows = load(spark, d, "conversations").groupBy(F.col("conv_id").alias("image"), kind.alias("kind")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    words = F.when(F.col("kind") == 4, F.array().cast(ocr.WORDS)).otherwise(F.transform("t", lambda t: t["w"]).cast(ocr.WORDS))
    line = lambda ids, en: F.struct(F.lit(0).alias("line"), F.array(*map(F.lit, ids)).alias("wordIds"), F.lit(en).alias("en"))
    lines = F.array(line(["a0"], "first"), line(["a0", "a1"], "across")).cast(ocr.LINES)
    return rows.select("image", words.alias("words"), F.transform("t", lambda t: t["s"]).cast(ocr.SEGMENTS).alias("segments"), lines.alias("line_translations"))


#: Rows of words that turns of conversations stand for: known lines, phrases, words of the dictionary.
READ = [tokens for tokens, *_ in LINES] + [tokens for tokens, *_ in PHRASES] + [[LEXICON[i][0], LEXICON[i + 1][0], "latin"] for i in range(0, len(LEXICON) - 1, 2)]


def words(spark, d):
    """Turns as lines of words: one in five has a letter too many, one in eleven a number, one in nine no line number."""
    c, t, i = F.col("conv_id"), F.col("turn"), F.col("pos")
    read = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in READ]), ((c * 7 + t) % len(READ) + 1).cast("int"))
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(read).alias("pos", "text"))
    text = F.when(((c + t) % 5 == 0) & (i == 0), F.concat("text", F.lit("x"))).when(((c + t) % 11 == 0) & (i == 1), "2026").otherwise(F.col("text"))
    sure = (c * 31 + t * 17 + i * 13) % 60 / 100 + 0.4
    return rows.select(c.alias("image"), F.when(t % 9 < 8, t).cast("int").alias("line"), (t * 100 + i).alias("pos"), text.alias("text"), sure.alias("confidence"))


def word_box_validation(spark, d):
    return ocr.validate(results(spark, d)).select("image", "error", F.coalesce(F.size("words"), F.lit(-1)).alias("n_words"))


def segment_remap(spark, d):
    found = ocr.validate(results(spark, d)).filter("error IS NULL")
    ids = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["line"].cast("string"), F.lit(":"), F.array_join(s["wordIds"], "+"), F.lit("="), s["en"])), ";")
    return found.select("image", ids("segments").alias("segments"), ids("line_translations").alias("lines"))


def lexicon_join(spark, d):
    table = inline(spark, LEXICON, "spelling string, rumi string, bm string, en string")
    return ocr.lexicon_lookup(ocr.readable(words(spark, d)), table).select("image", "line", "pos", "confidence", "rumi", "bm", "en")


def phrase_join(spark, d):
    table = inline(spark, PHRASES, "tokens array<string>, rumi string, bm string, en string")
    return ocr.phrase_lookup(ocr.lines_of(words(spark, d), ["image"], "pos"), table).select("image", "line", "rumi", "bm", "en")


def fuzzy_line_match(spark, d):
    table = inline(spark, LINES, "tokens array<string>, en string")
    found = ocr.supported_lines(ocr.lines_of(words(spark, d), ["image"], "pos"), ["image"], table)
    return found.select("image", "line", F.array_join("spelling", " ").alias("spelling"), "en", "distance")


def lines_group(spark, d):
    return ocr.lines_of(words(spark, d), ["image"], "pos").select("image", "line", F.array_join("tokens", " ").alias("text"), "least")


def ocr_coverage(spark, d):
    table = inline(spark, LEXICON, "spelling string, rumi string, bm string, en string")
    return ocr.coverage(ocr.lexicon_lookup(words(spark, d), table), ["image"]).withColumn("ratio", F.round("ratio", 6))


QUERIES = {
    f.__name__: f
    for f in (
        navigation_intent, complaint_category, supported_fields, number_words, spoken_number, no_new_numbers, extract_dates, extract_amounts, extract_places, chronology, complaint_analysis,
        word_box_validation, segment_remap, lexicon_join, phrase_join, fuzzy_line_match, lines_group, ocr_coverage,
    )
}



def _list(values) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, list) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _of(values: list, n: str) -> str:
    return f"{_list(values)}[({n}) % {len(values)} + 1]"


def _words(n: str) -> str:
    """Words of 0 to 99,999 in SQL."""

    def under_100(x: str) -> str:
        unit = lambda y: f"{_list(N.UNITS)}[CAST({y} AS BIGINT) + 1]"
        return f"(CASE WHEN {x} < 12 THEN {unit(x)} WHEN {x} < 20 THEN {unit(f'({x}) % 10')} || ' belas' ELSE {unit(f'({x}) // 10')} || ' puluh' || CASE WHEN ({x}) % 10 > 0 THEN ' ' || {unit(f'({x}) % 10')} ELSE '' END END)"

    def under_1000(x: str) -> str:
        return f"(CASE WHEN {x} < 100 THEN {under_100(x)} ELSE {under_100(f'({x}) // 100')} || ' ratus' || CASE WHEN ({x}) % 100 > 0 THEN ' ' || {under_100(f'(({x}) % 100)')} ELSE '' END END)"

    return f"(CASE WHEN {n} NOT BETWEEN 0 AND 99999 THEN '' WHEN {n} < 1000 THEN {under_1000(n)} ELSE {under_100(f'({n} // 1000)')} || ' ribu' || CASE WHEN {n} % 1000 > 0 THEN ' ' || {under_1000(f'({n} % 1000)')} ELSE '' END END)"


_N = "(SELECT event_id, event_id * 7919 % 100003 AS n FROM events)"
_FILLED = _of(TOLD, "c_custkey")
for _name, _value in {
    "AMOUNT": "'RM' || format('{:,}', s)", "WORDS": _words("said"), "DATE": f"(c_custkey % 28 + 1) || ' ' || {_of(MONTHS, 'c_custkey')} || ' ' || (c_custkey % 40 + 1990)",
    "PLACE": _of(PLACES, "c_custkey"), "PERSON": _of(PERSONS, "c_custkey + 1"),
}.items():
    _FILLED = f"replace({_FILLED}, '{_name}', {_value})"
_V = f"(SELECT c_custkey AS n, said, {_FILLED} AS text, {_of(PLACES, 'c_custkey')} AS place, {_of(PERSONS, 'c_custkey + 1')} AS person FROM (SELECT c_custkey, c_custkey * 37 % 9000 + 1000 AS s, c_custkey % 9 * 1000 + 1000 + c_custkey % 10 * 100 AS said FROM customer)) AS v"
_BOTH = f"(SELECT n, text FROM {_V} UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)"
_OCR = f"""(SELECT conv_id AS image, CASE WHEN turn % 9 < 8 THEN turn END AS line, turn * 100 + i AS pos,
    CASE WHEN (conv_id + turn) % 5 = 0 AND i = 0 THEN r[i + 1] || 'x' WHEN (conv_id + turn) % 11 = 0 AND i = 1 THEN '2026' ELSE r[i + 1] END AS text,
    CAST((conv_id * 31 + turn * 17 + i * 13) % 60 AS DOUBLE) / 100 + CAST(0.4 AS DOUBLE) AS confidence
    FROM (SELECT *, unnest(range(0, len(r))) AS i FROM (SELECT conv_id, turn, {_of(READ, "conv_id * 7 + turn")} AS r FROM conversations))) AS v"""
_LEX = sql_values(LEXICON, ["spelling", "rumi", "bm", "en"])
_LINES = f"l AS (SELECT image, coalesce(line, 0) AS line, list(text ORDER BY pos) AS tokens, min(confidence) AS least FROM {_OCR} GROUP BY image, coalesce(line, 0))"


def _lookup(source: str) -> str:
    return f"""SELECT image, line, pos, confidence, CASE WHEN ok THEN coalesce(rumi, '') ELSE '' END AS rumi, CASE WHEN ok THEN coalesce(bm, '') ELSE '' END AS bm, CASE WHEN ok THEN coalesce(en, '') ELSE '' END AS en
        FROM (SELECT w.*, x.* EXCLUDE (spelling), confidence >= CASE WHEN spelling IS NOT NULL THEN 0.5 ELSE 0.85 END AS ok FROM {source} w LEFT JOIN (SELECT * FROM {_LEX}) x ON w.text = x.spelling)"""


ORACLE_SQL = {
    "navigation_intent": f"""SELECT n, CASE WHEN regexp_matches(text, '(?i)(?:buka|pergi|buat|membuat|isi|mengisi|hantar|kemuka|kemukakan)[^\\n]{{0,30}}aduan') THEN 'aduan'
        WHEN regexp_matches(text, '(?i)(?:buka|pergi|analisis|baca|transkripsi)[^\\n]{{0,30}}(?:jawi|tulisan tangan|manuskrip)') THEN 'jawi'
        WHEN regexp_matches(text, '(?i)(?:buka|pergi|kembali)[^\\n]{{0,30}}(?:arkib|carian|koleksi)') THEN 'arkib' END AS page FROM {_BOTH}""",
    "complaint_category": f"""SELECT n, CASE WHEN regexp_matches(text, '(?i)rasuah|suapan|tanpa resit|tanpa risit') THEN 'Rasuah / Permintaan Suapan'
        WHEN regexp_matches(text, '(?i)bayaran tambahan|wang tunai|meminta\\s+RM|(?:meminta|membayar)[^\\n]{{0,50}}ringgit') AND regexp_matches(text, '(?i)mempercepatkan|kelulusan|keutamaan') THEN 'Rasuah / Permintaan Suapan'
        WHEN regexp_matches(text, '(?i)salah guna kuasa|penyalahgunaan kuasa') THEN 'Salah guna kuasa' WHEN regexp_matches(text, '(?i)tuntutan palsu|resit palsu|dokumen palsu') THEN 'Tuntutan palsu'
        WHEN regexp_matches(text, '(?i)lambat|lewat|tertangguh|kelewatan') THEN 'Kelewatan perkhidmatan' WHEN regexp_matches(text, '(?i)rosak|lampu jalan|kemudahan|tandas') THEN 'Kemudahan awam'
        ELSE 'Perkhidmatan awam lain' END AS category FROM {_BOTH}""",
    "supported_fields": f"""SELECT n, field, value, contains({S.normal("text")}, {S.normal("value")}) AND CASE field
        WHEN 'siapa' THEN regexp_matches(value, '(?i)\\b(?:{rules.PERSON})\\b') WHEN 'kenapa' THEN regexp_matches(text, '(?i)\\b(?:{rules.CAUSE})\\b')
        WHEN 'bagaimana' THEN regexp_matches(text, '(?i)\\b(?:{rules.MANNER})\\b') ELSE true END AS supported
        FROM (SELECT n, text, {_list(rules.SUPPORTED_FIELDS)}[i + 1] AS field, list_concat([place, person], {_list(OTHER)})[(n + i) % 5 + 1] AS value FROM (SELECT *, unnest(range(0, {len(rules.SUPPORTED_FIELDS)})) AS i FROM {_V}))""",
    "number_words": f"SELECT event_id, n, {_words('n')} AS words FROM {_N}",
    "spoken_number": f"SELECT event_id, {_words('n')} || CASE WHEN event_id % 10 = 0 THEN ' rumah' ELSE '' END AS words, CASE WHEN event_id % 10 > 0 AND n < 100000 THEN n END AS n FROM {_N}",
    "no_new_numbers": f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN n < 100000 WHEN 1 THEN true WHEN 2 THEN n < 100000 AND contains('meminta ' || {_words('(n + 1)')}, {_words('n')}) ELSE false END AS ok FROM {_N}""",
    "extract_dates": f"SELECT n, nullif(regexp_extract(text, '(?i)\\b\\d{{1,2}}\\s+(?:Januari|Februari|Mac|April|Mei|Jun|Julai|Ogos|September|Oktober|November|Disember)\\s+(?:19|20)\\d{{2}}\\b'), '') AS date FROM {_V}",
    "extract_amounts": f"SELECT n, regexp_replace(regexp_extract(text, '(?i)\\bRM\\s*\\d[\\d,.]*'), '\\s+', ' ', 'g') AS amount, CASE WHEN text LIKE '% ringgit%' THEN said END AS spoken FROM {_V}",
    "extract_places": rf"""SELECT n, array_to_string(regexp_extract_all(text, '(?i)\b(?:di|berhampiran|dalam)\s+((?:Jalan|Taman|Kampung|Pejabat|Dewan|Sekolah|Hospital|Kaunter|Bandar|Balai|Kedai|Perpustakaan|Pusat)\s+[^,.!?]{{2,100}}?)(?:\s+dan\s+(?:meminta|menyebut|memberi|mengambil|membayar)|[,.!?]|$)', 1), '|') AS places FROM {_V}""",
    "chronology": rf"""SELECT n, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\s+(Selepas itu|Kemudian|Pada mulanya|Semasa pertemuan)', chr(1) || '\1', 'gi'), chr(1)), lambda q: {S.clean("q")}),
        lambda q: length(q) >= 18 AND regexp_matches(q, '(?i)pada\s+\d|berurusan|kaunter|counter|menyebut|berjumpa|meminta') AND NOT regexp_matches(q, '(?i)^saya ingin membuat aduan\b|(?:mempunyai|memiliki)\s+(?:mesej|message|rakaman)'))) AS events FROM {_V}""",
    "word_box_validation": f"""SELECT conv_id AS image, CASE conv_id % 6 WHEN 2 THEN '{ocr.BAD_WORD}' WHEN 5 THEN '{ocr.BAD_WORD}' WHEN 4 THEN '{ocr.NO_WORDS}' WHEN 3 THEN '{ocr.NO_SEGMENTS}' END AS error,
        CASE WHEN conv_id % 6 < 2 THEN count(*) ELSE -1 END AS n_words FROM conversations GROUP BY conv_id""",
    "segment_remap": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE conv_id % 6 < 2)
        SELECT conv_id AS image, string_agg(turn || ':w' || i || '=' || role || turn, ';' ORDER BY turn) AS segments, CASE WHEN min(turn) = 0 THEN '0:w0=first' || CASE WHEN count(*) = 1 THEN ';0:w0=across' ELSE '' END ELSE '' END AS lines FROM c GROUP BY conv_id""",
    "lexicon_join": _lookup(f"(SELECT image, line, pos, text, CASE WHEN regexp_matches(text, '\\d') THEN least(confidence, 0.49) ELSE confidence END AS confidence FROM {_OCR} WHERE regexp_matches(text, '[\\x{{0600}}-\\x{{08FF}}]') OR regexp_matches(text, '^\\d+$'))"),
    "phrase_join": f"WITH {_LINES} SELECT image, line, rumi, bm, en FROM l JOIN (SELECT * FROM {sql_values(PHRASES, ['tokens', 'rumi', 'bm', 'en'])}) USING (tokens) WHERE least >= 0.85",
    "fuzzy_line_match": f"""WITH {_LINES}, k AS (SELECT * FROM {sql_values(LINES, ["known", "en"])}),
        p AS (SELECT image, line, known, en, list_transform(range(1, len(known) + 1), lambda i: levenshtein(tokens[i], known[i])) AS ds FROM l JOIN k ON len(tokens) = len(known) WHERE least >= 0.45),
        q AS (SELECT *, list_sum(ds) AS distance FROM p WHERE len(list_filter(ds, lambda x: x > 0)) <= 1 AND list_max(ds) <= 2),
        b AS (SELECT *, min(distance) OVER (PARTITION BY image, line) AS best FROM q), r AS (SELECT *, count(*) OVER (PARTITION BY image, line) AS ties FROM b WHERE distance = best)
        SELECT image, line, array_to_string(known, ' ') AS spelling, en, distance FROM r WHERE ties = 1""",
    "lines_group": f"WITH {_LINES} SELECT image, line, array_to_string(tokens, ' ') AS text, least FROM l",
    "ocr_coverage": f"""WITH w AS ({_lookup(f"(SELECT * FROM {_OCR})")})
        SELECT image, count(*) AS words, count(DISTINCT line) AS lines, count(*) FILTER (en <> '') AS verified, round(count(*) FILTER (en <> '') / count(*), 6) AS ratio, count(*) FILTER (en <> '') / count(*) < 0.45 AS low FROM w GROUP BY image""",
}
