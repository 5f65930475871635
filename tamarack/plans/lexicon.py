"""The Jawi dictionary (spelling, rumi, bm, en), phrases, and lines with a known translation."""

LEXICON = [
    ("باجو", "baju", "baju", "clothes"), ("ساي", "saya", "saya", "I"), ("بارو", "baru", "baru", "new"), ("سلام", "salam", "salam", "peace"),
    ("سجهترا", "sejahtera", "sejahtera", "well-being"), ("تاريخ", "tarikh", "tarikh", "date"), ("مانيس", "manis", "manis", "sweet"), ("دارا", "dara", "dara", "maiden"),
    ("برباجو", "berbaju", "berbaju", "wearing clothes"), ("کروڠسڠ", "kerongsang", "kerongsang", "brooch"), ("امس", "emas", "emas", "gold"), ("منجادي", "menjadi", "menjadi", "becomes"),
    ("هياسن", "hiasan", "hiasan", "decoration"), ("کڤد", "kepada", "kepada", "to"), ("سموا", "semua", "semua", "all"), ("رعيت", "rakyat", "rakyat", "people"),
    ("مرديک", "merdeka", "merdeka", "independence"), ("همبا", "hamba", "hamba", "I"), ("هولورکن", "hulurkan", "hulurkan", "offer"), ("کالاو", "kalau", "kalau", "if"),
    ("باچ", "baca", "baca", "read"), ("ني", "ni", "ini", "this"), ("ليميتد", "limited", "limited", "limited"), ("ايديشن", "edition", "edisi", "edition"),
    ("کباي", "kebaya", "kebaya", "kebaya"), ("مليسيا", "Malaysia", "Malaysia", "Malaysia"), ("اوق", "awak", "awak", "you"), ("بوليه", "boleh", "boleh", "can"),
    ("نکاراکو", "negaraku", "negaraku", "my country"), ("تانه", "tanah", "tanah", "land"), ("تومڤهڽ", "tumpahnya", "tumpahnya", "where it was shed"), ("دارهکو", "darahku", "darahku", "my blood"),
    ("هيدوڤ", "hidup", "hidup", "live"), ("برساتودان", "bersatu dan", "bersatu dan", "united and"), ("ماجو", "maju", "maju", "advance"),
    ("رحمةهاکيا", "rahmat bahagia", "rahmat bahagia", "blessings and happiness"), ("رحةماکيا", "rahmat bahagia", "rahmat bahagia", "blessings and happiness"), ("توهن", "Tuhan", "Tuhan", "God"),
    ("کورنياکن", "kurniakan", "kurniakan", "bestow"), ("کونياکن", "kurniakan", "kurniakan", "bestow"), ("راج", "raja", "raja", "king"), ("کيت", "kita", "kita", "our"),
    ("راجکيت", "raja kita", "raja kita", "our king"), ("سلامت", "selamat", "selamat", "safely"), ("برتجتا", "bertakhta", "bertakhta", "reign"), ("برتختا", "bertakhta", "bertakhta", "reign"),
    ("هيدوف", "hidup", "hidup", "live"), ("بساتودان", "bersatu dan", "bersatu dan", "united and"), ("رحة", "rahmat", "rahmat", "blessings"), ("هاݢيا", "bahagia", "bahagia", "happiness"),
    ("رحمة", "rahmat", "rahmat", "blessings"), ("باکيا", "bahagia", "bahagia", "happiness"),
]
PHRASES = [
    (["باجو"], "baju", "baju", "clothes"), (["باجو", "ساي"], "baju saya", "baju saya", "my clothes"), (["باجو", "ساي", "بارو"], "baju saya baru", "baju saya baru", "My clothes are new"),
]
LINES = [
    (["نکاراکو", "تانه", "تومڤهڽ", "دارهکو"], "My country, the land where my blood was shed."),
    (["رعيت", "هيدوڤ", "برساتودان", "ماجو"], "The people live united and advance."),
    (["رحمةهاکيا", "توهن", "کورنياکن"], "May God bestow blessings and happiness."),
    (["رحةماکيا", "توهن", "کونياکن"], "May God bestow blessings and happiness."),
    (["راج", "کيت", "سلامت", "برتجتا"], "May our King reign in safety."),
    (["راجکيت", "سلامت", "برتختا"], "May our King reign in safety."),
    (["رعيت", "هيدوف", "بساتودان", "ماجو"], "The people live united and advance."),
    (["رعيت", "هيدوف", "برساتودان", "ماجو"], "The people live united and advance."),
    (["رحة", "هاݢيا", "توهن", "کورنياکن"], "May God bestow blessings and happiness."),
    (["رحمة", "باکيا", "توهن", "کورنياکن"], "May God bestow blessings and happiness."),
]
