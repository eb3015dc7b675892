import pytest

from factlattice.llm import garbled

SOUND = [
    "Le préposé aux retours a mesuré un coude fêlé ; l’été dernier, la pièce à côté était réétiquetée.",
    "Der Prüfer vermaß die früheren Messwerte für Straße und Gerät; Käufer können später prüfen.",
    "El técnico midió la presión según la última medición; ¿dónde está el número?",
    "Użytkownik powinien wyłączyć urządzenie; źródło podaje inną wartość niż część.",
    "Не указывает единицу измерения; владельцам следует обратиться за ремонтом.",
    "Ο κατασκευαστής ανακαλεί περίπου συσκευές και η τιμή δεν έχει επιβεβαιωθεί.",
    "お客様は使用を中止してください。最高外気温は四十三度です。", "Não há registro de lesões até agora. ATENÇÃO: MANUTENÇÃO SÓ DEPOIS.",
    "Rated cooling (±5 %), 45 µF, 3⅜″ drain — “quoted”… R® and T™ at 95 °F, ★★★★☆, 33 ℃.",
]


@pytest.fixture(scope="module")
def repairer():
    import collections

    import numpy as np

    c = collections.Counter()
    texts = [f"{s} {i}" for s in SOUND for i in range(40)]
    for t in texts:
        c.update(garbled.text_pairs(t).tolist())
    c[-1] = len(texts)
    return garbled.Repairer(np.array(list(c.keys())), np.array(list(c.values())))


def wrong(text, written, read):
    out = []
    for b in text.encode(written):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_signs_of_money_are_left_alone():
    import collections

    import numpy as np

    c = collections.Counter()
    texts = [f"{s} {i}" for s in SOUND for i in range(40)] + [f"Plain text {i}. ¢ rebate: £{i} / ¥{i}00 / §{i}" for i in range(8)]
    for t in texts:
        c.update(garbled.text_pairs(t).tolist())
    c[-1] = len(texts)
    repairer = garbled.Repairer(np.array(list(c.keys())), np.array(list(c.values())))
    for s in [*texts, "A ¢ rebate: £40 / ¥600 / §12", "Price ¥600 and \\600", "¥", "Le prix ¥12 et §3 du mémo"]:
        assert repairer.examine(s)[:2] == (False, s)
    for c in "¥‾¢£¬":  # an encoder may put another sign for these, a decoder never does
        assert all(garbled.Repairer._bytes(c, e) is None or garbled.Repairer._bytes(c, e).decode(e) == c for e in garbled._WIDE)


def test_sound_texts_are_left_alone(repairer):
    for s in [*SOUND, "plain ascii", "", None, "É®", "25UDК180D6"]:
        assert repairer.examine(s)[:2] == (False, s)


@pytest.mark.parametrize("i", range(len(SOUND)))
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_utf8_read_wrongly_is_restored(repairer, i, read):
    bad = wrong(SOUND[i], "utf-8", read)
    damaged, text, _, mapping = repairer.examine(bad)
    assert damaged and text == SOUND[i], mapping


@pytest.mark.parametrize(("i", "written", "read"), [(4, "cp1251", "latin-1"), (4, "koi8-r", "cp1251"), (5, "cp1253", "cp1252"), (3, "iso8859-2",
    "latin-1"), (0, "cp1252", "cp850"), (1, "mac_roman", "cp1252")])
def test_other_encodings(repairer, i, written, read):
    s = SOUND[i].replace("’", "'")
    assert repairer.examine(wrong(s, written, read))[0]


def test_parts_twice_and_lost(repairer):
    half = SOUND[0] + " " + wrong(SOUND[1], "utf-8", "cp1252")
    assert repairer.examine(half)[:2] == (True, SOUND[0] + " " + SOUND[1])
    twice = wrong(wrong(SOUND[2], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert repairer.examine(twice)[:2] == (True, SOUND[2])
    assert repairer.examine("caf� au lait")[0] and repairer.examine("tail\x9d")[0]


def test_frame(spark):
    bad = wrong(SOUND[0], "utf-8", "cp1252")
    rows = [(i, s) for i, s in enumerate(SOUND * 5)] + [(100, bad), (100, bad), (101, None), (102, ""), (103, bad * 400)]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id bigint, text string, damaged string, gain double")
    got = garbled.examined(df).where("damaged").collect()
    assert sorted(r.doc_id for r in got) == [100, 100, 103] and all(r.text in (SOUND[0], SOUND[0] * 400) for r in got)
    assert garbled.examined(df.where("doc_id < 0")).count() == 0


@pytest.fixture(scope="module")
def kana_repairer():
    import collections

    import numpy as np

    kana = ["お部屋のエアコンとファンのケーブルを確認してください。", "ファン、エアコン、ケーブルは交換済みです。", "古いファンとエアコンのケーブル"]
    c = collections.Counter()
    texts = [f"{s} {i}" for s in [*SOUND, *kana] for i in range(40)]
    for t in texts:
        c.update(garbled.text_pairs(t).tolist())
    c[-1] = len(texts)
    return garbled.Repairer(np.array(list(c.keys())), np.array(list(c.values())))


@pytest.mark.parametrize("word", ["ファン", "エアコン", "ケーブル"])
@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp437", "koi8-r", "cp1251"])
def test_short_words_of_two_byte_encodings(kana_repairer, word, read):
    bad = f"Replace the part {wrong(word, 'cp932', read)} today"
    assert kana_repairer.examine(bad)[:2] == (True, f"Replace the part {word} today")


def test_copies_of_a_garbled_text_are_found_however_many(spark):
    bad = wrong("Последняя редакция: проверено в марте", "koi8-r", "cp1251")
    sound = [f"{s} {i}" for i in range(40) for s in [*SOUND, "Проверено в марте; последняя редакция указана в сноске."]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sound)] + [(1000 + i, bad) for i in range(200)], "doc_id bigint, text string")
    got = garbled.examined(df).where("damaged").collect()
    assert sorted(r.doc_id for r in got) == list(range(1000, 1200))


@pytest.mark.parametrize("read", ["cp1252", "mac_roman", "cp437"])
def test_similar_garbled_texts_are_proven_by_structure(read):
    import collections

    import numpy as np

    bad = [wrong(f"{SOUND[0]} {i}", "utf-8", read) for i in range(180)]
    c = collections.Counter()
    texts = [f"{s} {i}" for s in SOUND for i in range(40)] + bad
    for t in texts:
        c.update(garbled.text_pairs(t).tolist())
    c[-1] = len(texts)
    r = garbled.Repairer(np.array(list(c.keys())), np.array(list(c.values())))
    assert all(r.examine(b)[:2] == (True, f"{SOUND[0]} {i}") for i, b in enumerate(bad))
    assert not any(r.examine(t)[0] for t in texts[: -len(bad)])


@pytest.mark.parametrize(
    ("left", "part", "right", "written", "read"),
    [
        ("お客様は使用を中止してください", "。", "最高", "utf-8", "cp1252"), ("お客様は使用を", "中止してください。", "", "utf-8", "cp437"),
        ("Le “prépos", "é", "” a mesuré", "utf-8", "cp1252"),
        ("Не указ", "ывает", " единицу измерения", "utf-8", "latin-1"), ("古い", "ファン", "のケーブル today", "cp932", "cp1252"),
        ("お客様は使用を", "中止してください。", "", "cp932", "cp1252"),
    ],
)
def test_garbled_parts_that_touch_sound_characters(kana_repairer, left, part, right, written, read):
    assert kana_repairer.examine(left + wrong(part, written, read) + right)[:2] == (True, left + part + right)


def test_long_runs_are_repaired_twice_over(kana_repairer):
    good = "お客様は使用を中止してください。最高外気温は四十三度です。" * 4
    twice = wrong(wrong(good, "utf-8", "latin-1"), "utf-8", "latin-1")
    assert len(twice) > 400 and kana_repairer.examine(twice)[:2] == (True, good)


def test_characters_stay_known_beyond_the_pair_limit(spark, monkeypatch):
    monkeypatch.setattr(garbled, "MAX_PAIRS", 20)
    df = spark.createDataFrame([(f"{SOUND[0]} {i}",) for i in range(40)] + [("dŵr",)], "text string")
    r = garbled.Repairer(*garbled.pair_table(df))
    assert len(r.pair) <= 20 and r._plausible("ŵé") and not r._plausible("ж")


def test_results_do_not_depend_on_the_size_of_the_pair_table(spark, monkeypatch):
    texts = [f"{s} {i}" for i in range(40) for s in SOUND] + [wrong(SOUND[4], "cp1251", "latin-1"), wrong(SOUND[3], "iso8859-2", "latin-1"),
        wrong(SOUND[0], "utf-8", "cp1252"), wrong(SOUND[6], "cp932", "cp1252"), "Le dŵr et le ŷd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = sorted(map(tuple, garbled.examined(df).collect()))
    counts = {r.pair: r.n for r in garbled.pair_counts(df).collect() if r.pair >= 0}
    monkeypatch.setattr(garbled, "MAX_PAIRS", 20)
    monkeypatch.setattr(garbled, "PIECE", 7, raising=False)
    monkeypatch.setattr(garbled, "PIECES", 3, raising=False)
    r = garbled.Repairer(*garbled.pair_table(df))
    assert len(counts) > 200 and all(r._pair(p >> 21, p & 0x1FFFFF) == n for p, n in counts.items()) and r._pair(0x416, 0xE9) == 0
    assert len(r.pair) <= 20 and len(r.pair.held) <= 3
    assert sum(row[1] for row in whole) == 4 and sorted(map(tuple, garbled.examined(df).collect())) == whole
