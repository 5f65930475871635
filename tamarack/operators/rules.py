"""Rule tables as ordered CASE expressions: the first rule that fits decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import normalize, word_edge

#: Page requests (pattern, page), in order.
NAVIGATION = [
    (r"(?is)(?:buka|pergi|buat|membuat|isi|mengisi|hantar|kemuka|kemukakan)[^\n]{0,30}aduan", "aduan"),
    (r"(?is)(?:buka|pergi|analisis|baca|transkripsi)[^\n]{0,30}(?:jawi|tulisan tangan|manuskrip)", "jawi"),
    (r"(?is)(?:buka|pergi|kembali)[^\n]{0,30}(?:arkib|carian|koleksi)", "arkib"),
]
#: What is said when a page is opened.
NAVIGATION_REPLIES = {
    "aduan": "Saya buka halaman e-Aduan. Ceritakan apa yang berlaku, bila dan di mana. Anda boleh semak serta ubah draf sebelum menyimpannya.",
    "jawi": "Saya buka ruang Jawi dan tulisan tangan. Muat naik imej dokumen untuk melihat transkripsi dan terjemahan secara bersebelahan.",
    "arkib": "Saya buka carian arkib. Setiap jawapan penyelidikan perlu disokong petikan daripada sumber yang diindeks.",
}
#: Complaint categories (all patterns of a rule must match), in order, and the default.
CATEGORIES = [
    ([r"(?i)rasuah|suapan|tanpa resit|tanpa risit"], "Rasuah / Permintaan Suapan"),
    ([r"(?i)bayaran tambahan|wang tunai|meminta\s+RM|(?:meminta|membayar)[^\n]{0,50}ringgit", r"(?i)mempercepatkan|kelulusan|keutamaan"], "Rasuah / Permintaan Suapan"),
    ([r"(?i)salah guna kuasa|penyalahgunaan kuasa"], "Salah guna kuasa"),
    ([r"(?i)tuntutan palsu|resit palsu|dokumen palsu"], "Tuntutan palsu"),
    ([r"(?i)lambat|lewat|tertangguh|kelewatan"], "Kelewatan perkhidmatan"),
    ([r"(?i)rosak|lampu jalan|kemudahan|tandas"], "Kemudahan awam"),
]
OTHER_CATEGORY = "Perkhidmatan awam lain"
#: Words that a field must have in its value, or in the statement, to count as that field.
PERSON = "saya|kami|pengadu|penduduk|orang|pegawai|kontraktor|syarikat|pemilik|jiran|pemandu|pekerja|encik|puan|cik|tuan"
CAUSE = "kerana|sebab|punca|disebabkan|akibat|berikutan"
MANNER = "bagaimana|cara|ketika|semasa|apabila|melalui|dengan"
SUPPORTED_FIELDS = ["tajuk", "apa", "bila", "dimana", "bagaimana", "kenapa", "siapa"]


def first_match(text: Column, rules: list[tuple[list[str], str]], default: str | None = None) -> Column:
    out = F.lit(default)
    for patterns, value in reversed(rules):
        fits = F.lit(True)
        for p in patterns:
            fits = fits & text.rlike(p)
        out = F.when(fits, F.lit(value)).otherwise(out)
    return out


def navigation_intent(text: Column) -> Column:
    """Page that a request asks for, or null."""
    return first_match(text, [([p], page) for p, page in NAVIGATION])


def requested_page(question: str) -> str | None:
    """The page that one question asks for, without a job."""
    return next((page for pattern, page in NAVIGATION if re.search(pattern, question)), None)


def category(text: Column) -> Column:
    return first_match(text, CATEGORIES, OTHER_CATEGORY)


def supported(field: str, value: Column, statement: Column) -> Column:
    """The value if the statement contains it and its words answer that field, else null."""
    fits = (F.trim(value) != "") & F.contains(normalize(statement), normalize(value))
    if field == "siapa":
        fits = fits & value.rlike(word_edge(PERSON))
    if field == "kenapa":
        fits = fits & statement.rlike(word_edge(CAUSE))
    if field == "bagaimana":
        fits = fits & statement.rlike(word_edge(MANNER))
    return F.when(fits, F.substring(value, 1, 200 if field == "tajuk" else 6000))
