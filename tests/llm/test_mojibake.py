import random

from tapeloom.llm.mojibake import CHAINS, READ_AS, USUAL, find_garbled, forms, garble, garble_all, restore_garbled

CLEAN = [
    "Die Aufsichtsbehörde prüft das Übernahmeangebot für große Lücken",
    "Komisja ogłosiła, że spółka podniosła prognozę i złożono zleceń",
    "Регулятор начал проверку после отчёта и сохранил ставку",
    "当局は調査を始めた。板の厚みは秒で回復した。",
    "“We see no reason,” she said — the café’s owner agreed at 5 °C for £3 or 4 €",
    "AVISO: A OPERAÇÃO FOI CONCLUÍDA EM SÃO BRÁSIO; NÃO HÁ AÇÕES",
    "Δp = −26, naïve spread, Đồng Mới, ¶28 ©Name 🚀",
    "plain ascii &eacute; and \\u00e9",
]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, unit string")


def test_chains(spark):
    bad = []
    for chain in CHAINS:
        for text in CLEAN[:5]:
            g = garble(text, chain)
            if g is not None and g != text and len(g) > 10 and chain[0][0] in ("utf-8", "koi8-r", "cp1251") and (len(chain) > 1 or chain[0][0] == "utf-8" or chain[0][:2] in USUAL):
                bad.append((text, g))
    texts = CLEAN * 3 + [g for _, g in bad]
    found = {r.doc_id for r in find_garbled(table(spark, texts)).collect()}
    assert found == set(range(len(CLEAN) * 3, len(texts)))


def test_restores(spark):
    wrong = [garble(CLEAN[0], ((("utf-8", "cp1252", "tapeloom-pass")),)), garble(CLEAN[1], (("utf-8", "cp1250", "tapeloom-pass"),)), garble(CLEAN[2], (("koi8-r", "cp1251", "tapeloom-pass"),)), garble(CLEAN[4], (("utf-8", "mac_roman", "tapeloom-pass"),))]
    texts = CLEAN * 2 + [f"head {w} tail" for w in wrong]
    got = {r.doc_id: (r.restored, r.complete) for r in restore_garbled(table(spark, texts)).collect()}
    n = len(CLEAN) * 2
    for i, k in ((0, 0), (1, 1), (3, 4)):
        assert got[n + i] == (f"head {CLEAN[k]} tail", True)
    assert "Регулятор начал проверку после отчёта" in got[n + 2][0]


def test_rare_chains_need_more_evidence(spark):
    """Between two alike spellings the distinct texts decide; what looks wrong counts always."""
    swapped, symbols = garble(CLEAN[2], (("iso8859-5", "koi8-r", "tapeloom-pass"),)), garble(CLEAN[1], (("cp1250", "latin-1", "tapeloom-pass"),))
    assert {r.doc_id for r in find_garbled(table(spark, [*CLEAN, swapped, symbols, f"{swapped} 2"])).collect()} == {len(CLEAN), len(CLEAN) + 1, len(CLEAN) + 2}
    kana = garble("日本銀行", (("cp932", "euc_kr", "replace"),))
    assert not [f for f in forms([kana]) if f[1] == "日本銀行"]


def test_rare_chains_need_more_evidence(spark):
    """Between two alike spellings the distinct texts decide; what looks wrong counts always."""
    swapped, symbols = garble(CLEAN[2], (("iso8859-5", "koi8-r", "tapeloom-pass"),)), garble(CLEAN[1], (("cp1250", "latin-1", "tapeloom-pass"),))
    assert {r.doc_id for r in find_garbled(table(spark, [*CLEAN, swapped, symbols, f"{swapped} 2"])).collect()} == {len(CLEAN), len(CLEAN) + 1, len(CLEAN) + 2}
    kana = garble("日本銀行", (("cp932", "euc_kr", "replace"),))
    assert not [f for f in forms([kana]) if f[1] == "日本銀行"]


def test_all_chains_at_once_give_what_one_word_gives():
    words = [w for t in CLEAN for w in t.split()] + ["é", "ąę", "漢", "日本語"]
    for chain in random.Random(4).sample(CHAINS, 150):
        got = dict(zip(*garble_all(words, chain, {}), strict=True))
        assert {i: g for i, w in enumerate(words) if (g := garble(w, chain))} == {i: g for i, g in got.items() if g}


def test_every_pair_of_readings(spark):
    """UTF-8 read as any encoding, and twice over as any two."""
    for first, second in ((e, None) for e in READ_AS):
        g = garble(CLEAN[2], (("utf-8", first, "replace"),))
        assert {r.doc_id for r in find_garbled(table(spark, [*CLEAN, g])).collect()} == {len(CLEAN)}, first
    for chain in ((("utf-8", "cp1251", "tapeloom-pass"),) * 2, (("utf-8", "cp1252", "tapeloom-pass"), ("utf-8", "mac_roman", "tapeloom-pass")), (("utf-8", "cp1251", "tapeloom-pass"), ("utf-8", "koi8-r", "tapeloom-pass"))):
        for text in (CLEAN[0], CLEAN[2]):
            got = {r.doc_id: (r.restored, r.complete) for r in restore_garbled(table(spark, [*CLEAN, garble(text, chain)])).collect()}
            assert got == {len(CLEAN): (text, True)}


def test_what_is_lost_comes_back_only_for_sure(spark):
    texts = [*CLEAN, "café naïve espaço año aço", "na\ufffdve", "caf\ufffd or na\ufffdve \ufffd", "a\ufffdo", "\ufffd\ufffd", "x \ufffd y"]
    n = len(CLEAN) + 1
    got = {r.doc_id: (r.restored, r.complete) for r in restore_garbled(table(spark, texts)).collect()}
    assert got == {n: ("naïve", True), n + 1: ("café or naïve \ufffd", False), n + 2: ("a\ufffdo", False), n + 3: ("\ufffd\ufffd", False), n + 4: ("x \ufffd y", False)}


def test_pieces_of_garbled_texts_are_no_originals(spark):
    wrong = garble("Übergrößenträger", (("utf-8", "cp1252", "tapeloom-pass"),))
    got = {r.doc_id: r.restored for r in restore_garbled(table(spark, [*CLEAN, f"ein {wrong} naÃ¯ve", "naÃ¯ve \ufffd nur\ufffd"])).collect()}
    assert got[len(CLEAN)].endswith(" naïve") and "�" in got[len(CLEAN) + 1]
    assert not [f for f in forms(["naïve"]) if f[1] == "naÃ¯ve" and f[3] != "strong"]


def test_new_words_and_edges(spark):
    texts = [*CLEAN, None, "", " \t", "unheard of: BrÃ¶nnÃ¼", "a�b ö � é", "Zürich " * 20_000, "Zürich ", "Zürich "]
    got = {r.doc_id for r in find_garbled(table(spark, texts)).collect()}
    assert got == {len(CLEAN) + 3, len(CLEAN) + 4}
    assert find_garbled(table(spark, []).limit(0)).count() == 0


def test_repetition_is_no_veto(spark):
    chains = [("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("cp866", "cp1251")]
    wrong = [garble(CLEAN[2], ((w, r, "tapeloom-pass"),)) for w, r in chains]
    for w in wrong:  # copies, and texts that only differ beside the passage
        got = {r.doc_id for r in find_garbled(table(spark, CLEAN + [w] * 6 + [f"{i} {w}" for i in range(6)])).collect()}
        assert got == set(range(len(CLEAN), len(CLEAN) + 12))
    # both spellings look like words: the distinct texts decide, not the rows
    texts = ["pod kolečko", "má kolečko", *["pod koleèko"] * 9]
    assert {r.doc_id for r in find_garbled(table(spark, texts)).collect()} == set(range(2, 11))


def test_clean_text_isnt_a_form_of_text_read_the_other_way(spark):
    other = garble(CLEAN[2], (("cp1251", "koi8-r", "tapeloom-pass"),))
    texts = [other, *(f"{i} {CLEAN[2]}" for i in range(4)), "operaçőes", "as operações", "operações"]
    assert not {r.doc_id for r in find_garbled(table(spark, texts)).collect()} - {0}
