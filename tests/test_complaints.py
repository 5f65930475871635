"""Complaint statements: the behaviour that a user relies on, on short Malay statements."""

import pytest
from pyspark.sql import functions as F

from tamarack.operators import complaints, rules

LAMP = "Pada 18 September 2025, lampu jalan rosak di Jalan Merdeka. Penduduk tidak dapat melihat jalan pada waktu malam."
LONG = (
    "Pada 25 September 2026 kira-kira jam 3 petang, saya berurusan dengan Encik Ahmad di kaunter Bahagian Pelesenan. Beliau menyebut bayaran tambahan untuk memberi keutamaan dan "
    "mempercepatkan kelulusan permit syarikat. Kemudian beliau meminta saya berjumpa di kedai makan berhampiran pejabat dan meminta RM3,000 secara tunai tanpa resit. "
    "Saya mempunyai mesej WhatsApp dan rakaman perbualan."
)
SPOKEN = (
    "Individu tersebut ialah En C Ahmad. Perkara berlaku pada dua puluh lima setember dua ribu dua puluh enam lebih kurang jam tiga petang di counter bahagian perlesehan. "
    "Selepas itu beliau meminta saya berjumpa dengannya di sebuah kedai makan bahampiran pejabat. Beliau meminta saya membayar tiga ribu ringgit untuk mempercepatkan kelulusan permit."
)
PAID = "Encik Ahmad meminta saya membayar RM3,000 supaya permit syarikat saya diluluskan. Saya bertemu beliau di kaunter pejabat."


def entry(v):
    return {"value": v, "evidence": None, "confidence": None, "literal": True} if isinstance(v, str) else v | {"literal": False}


def backed(value, *quotes):
    return {"value": value, "evidence": list(quotes), "confidence": 0.9}


def case(transcript, fields=None, themes=(), title="", items=(), events=()):
    return ({k: entry(v) for k, v in (fields or {}).items()}, [{"quote": q} for q in themes], title, [{"description": d, "quote": q} for d, q in items], [{"event": e, "quote": q} for e, q in events], transcript)


CASES = {
    "lamp": case(LAMP, {"tajuk": "lampu jalan rosak", "apa": "lampu jalan rosak", "bila": "18 September 2025", "dimana": "Jalan Merdeka", "siapa": "Pegawai Ali"}, ["Penduduk tidak dapat melihat jalan", "pegawai meminta wang"]),
    "swapped": case(LAMP, {"tajuk": "lampu jalan", "apa": "tidak dapat melihat jalan", "bila": "di Jalan Merdeka", "dimana": "pada 18 September 2025"}, ["lampu jalan rosak di Jalan Merdeka"]),
    "backed": case(
        LONG.replace("jam 3 petang", "jam 3.00 petang"),
        {
            "apa": backed("Permintaan RM3,000 untuk mempercepatkan kelulusan permit syarikat", "meminta RM3,000 secara tunai tanpa resit", "mempercepatkan kelulusan permit syarikat"),
            "siapa": backed("Encik Ahmad", "Encik Ahmad"), "bila": backed("25 September 2026, kira-kira jam 3.00 petang", "25 September 2026 kira-kira jam 3.00 petang"),
            "dimana": backed("Kaunter Bahagian Pelesenan dan kedai makan berhampiran pejabat", "kaunter Bahagian Pelesenan", "kedai makan berhampiran pejabat"),
            "kenapa": backed("Untuk memberi keutamaan dan mempercepatkan kelulusan permit", "untuk memberi keutamaan dan mempercepatkan kelulusan permit syarikat"),
            "bagaimana": backed("Bayaran tambahan disebut, kemudian RM3,000 diminta secara tunai tanpa resit", "menyebut bayaran tambahan", "meminta RM3,000 secara tunai tanpa resit"),
        },
        ["meminta RM3,000 secara tunai tanpa resit"], "Dakwaan Permintaan RM3,000 Untuk Mempercepat Kelulusan Permit", [("Mesej WhatsApp", "mesej WhatsApp"), ("Rakaman perbualan", "rakaman perbualan")],
        [("Berurusan di kaunter", "kaunter Bahagian Pelesenan")],
    ),
    "paid": case(PAID, {"apa": "meminta saya membayar RM3,000 supaya permit syarikat saya diluluskan", "siapa": "Encik Ahmad", "dimana": "kaunter pejabat"}, title="Dakwaan permintaan saya membayar RM3,000"),
    "request": case(
        "Saya ingin membuat aduan berkenaan seorang pegawai kerajaan. Encik Ahmad meminta saya membayar RM3,000 supaya permit syarikat saya diluluskan dengan lebih cepat.",
        {"apa": "Saya ingin membuat aduan berkenaan seorang pegawai kerajaan.", "siapa": "Encik Ahmad"}, title="Dakwaan permintaan saya membayar RM3,000",
    ),
    "weak": case(
        LONG,
        {"apa": "saya berurusan dengan", "siapa": "Encik Ahmad", "dimana": "di kaunter Bahagian Pelesenan", "kenapa": "membuat bayaran tambahan untuk memberi keutamaan", "bagaimana": "meminta RM3,000 secara tunai tanpa resit", "jumlah": "RM3,000"},
        title="Aduan Pendek",
    ),
    "spoken": case(SPOKEN, {"apa": "meminta saya membayar tiga ribu ringgit"}),
    "spoken_bare": case(SPOKEN),
    "fee": case("Saya dikenakan bayaran tambahan RM10 untuk cetakan dokumen di kaunter.", {"apa": "bayaran tambahan RM10"}),
    "empty": case(""),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, *row) for name, row in CASES.items()]
    found = complaints.analyze(spark.createDataFrame(rows, "name string, " + complaints.PROPOSAL + ", transcript string").coalesce(1)).collect()
    return {r["name"]: r.asDict(recursive=True) for r in found}


def test_fields_and_themes_stay_with_the_statement(results):
    r = results["lamp"]
    assert r["topic"] == "lampu jalan rosak"
    assert r["themes"] == [{"label": "Kemudahan awam", "quote": "Penduduk tidak dapat melihat jalan"}]
    assert r["v_siapa"] is None and "Siapa" in r["missing"]
    assert "Draf" in r["conclusion"]


def test_swapped_date_and_place_are_repaired(results):
    r = results["swapped"]
    assert (r["v_bila"], r["v_dimana"], r["v_apa"]) == ("18 September 2025", "Jalan Merdeka", "tidak dapat melihat jalan")
    assert r["themes"][0]["label"] == "Kemudahan awam"


def test_backed_values_are_kept(results):
    r = results["backed"]
    assert r["v_apa"] == "Permintaan RM3,000 untuk mempercepatkan kelulusan permit syarikat"
    assert "mempercepatkan" in r["v_kenapa"] and "tunai tanpa resit" in r["v_bagaimana"] and "kedai makan" in r["v_dimana"]
    assert r["category"] == "Rasuah / Permintaan Suapan" and len(r["evidence_items"]) == 2 and len(r["chronology"]) == 1 and r["missing"] == []


def test_narrative_is_third_person_and_quotes_are_not(results):
    r = results["paid"]
    words = lambda t: t.lower().replace(",", " ").split()
    assert "saya" not in words(r["topic"]) + words(r["summary"]) + words(r["v_apa"])
    assert "saya" in words(r["e_apa"][0])
    assert all("saya" not in words(e["event"]) for e in r["chronology"])


def test_the_request_to_complain_is_no_incident(results):
    r = results["request"]
    assert "meminta bayaran RM3,000" in r["v_apa"]
    assert "ingin membuat aduan" not in r["topic"] + r["summary"]


def test_weak_spans_are_repaired_from_the_statement(results):
    r = results["weak"]
    assert "meminta RM3,000" in r["v_apa"] and "mempercepatkan kelulusan" in r["v_kenapa"] and "kedai makan" in r["v_dimana"] and "3 petang" in r["v_bila"]
    assert r["amount"] == "RM3,000" and len(r["evidence_items"]) == 2 and len(r["chronology"]) >= 2
    assert r["topic"] != "Aduan Pendek" and "RM3,000" in r["summary"]


def test_spoken_dates_and_amounts(results):
    assert results["spoken_bare"]["v_apa"] == results["spoken"]["v_apa"] == "meminta bayaran RM3,000"
    r = results["spoken"]
    assert r["parties"] == "Encik Ahmad" and r["amount"] == "RM3,000"
    assert r["v_bila"] == "25 September 2026, kira-kira jam 3 petang" and "dua puluh lima setember" in r["e_bila"][0]
    assert r["v_dimana"].index("counter") < r["v_dimana"].index("kedai makan")
    assert "mempercepatkan kelulusan" in r["v_kenapa"]


def test_a_fee_alone_is_no_bribe(results):
    r = results["fee"]
    assert r["category"] == "Perkhidmatan awam lain"


def test_empty_statement(results):
    r = results["empty"]
    assert len(r["missing"]) == 6 and r["summary"] == complaints.UNKNOWN and r["chronology"] == []


def test_supported_fields(spark):
    text = "Pada 18 September 2025, tandas perpustakaan di Kuala Lumpur rosak."
    cases = [("tajuk", "tandas perpustakaan di Kuala Lumpur rosak", True), ("bila", "18 September 2025", True), ("kenapa", "kerana tiada peruntukan", False), ("siapa", "perpustakaan", False), ("bagaimana", "rosak", False)]
    for key, value, ok in cases:
        got = spark.range(1).select(rules.supported(key, F.lit(value), F.lit(text)).alias("v")).first()["v"]
        assert (got is not None) == ok, key


def test_navigation(spark):
    got = [r[0] for r in spark.createDataFrame([("Saya nak buat aduan",), ("Apa yang berlaku pada tahun 1948?",), ("buka arkib",)], "t string").select(rules.navigation_intent(F.col("t"))).collect()]
    assert got == ["aduan", None, "arkib"]
