import pytest

from lectern.llm import encoding as E

FR, PL, RU = "L’étrier était fermé – à côté", "Głowica została przepłukana, żółty wąż", "Техник отметил, что насос протекал"


@pytest.mark.parametrize("text,wrong", [(FR, w) for w in ("cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman")] + [(PL, "cp1250"), (PL, "cp1252"), (RU, "cp1251"), (RU, "cp1252")])
def test_round_trip(text, wrong):
    bad = E._decode(text.encode(), wrong)
    assert E.repair(bad)[0] == text and E.repair("plain " + bad + " x" + text)[0].endswith(" x" + text)
    twice = E._decode(bad.encode(), wrong)
    if wrong in ("cp1252", "latin-1"):
        assert E.repair(twice)[0] == text


@pytest.mark.parametrize("t", ["CHÂSSIS Nº TÂCHE Â-7", "ESTAÇÃO DE BOMBA – VÃO", "√2 ≤ Δp ≤ 3·√2, ∑", "├── a │ └── b", "█ ░ ║", "ŽĎÁR ÚSEK ±3", "Ð-12 / Þ-9, shade Æble", "12 Ω ± 1 Ω at 45° – “x”", FR, PL, RU, "", "ascii"])
def test_odd_but_right(t):
    assert E.repair(t) == (t, 0, False)


def test_documents(spark):
    clean = [(i, t, 0) for i, t in enumerate([FR, PL, RU, "¿Quedó la émbolo?"] * 6)]
    bad = [(100, PL.encode("cp1250").decode("cp1252"), 0), (101, RU.encode("cp1251").decode("cp1252"), 0), (102, "pr�xima", 0), (103, None, 0), (104, "", 0), (105, E._decode(FR.encode(), "cp1252"), 0), (106, FR.encode("mac_roman", "replace").decode("cp1252", "replace"), 0), (107, "ok", 0), (None, "Ã©", 0)]
    df = spark.createDataFrame(clean + bad + bad[:1], "doc_id long, text string, fixed int")
    got = {r.doc_id: r.fixed_len for r in E.found(df).collect()}
    assert got.pop(106) in (len(FR), -1)
    assert got == {100: len(PL), 101: len(RU), 102: -1, 105: len(FR)}
    text = {r.id: r.fixed for r in E.restored(df).collect()}
    assert text[100] == PL and text[101] == RU
    assert E.found(df.limit(0)).count() == 0


def test_very_long():
    t = ("naïve – " * 40_000)
    assert E.repair(E._decode(t.encode(), "cp1252"))[0] == t


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman", "cp1251"])
def test_lost_rest(wrong):
    bad = E._decode("L’étrier – «fermé» était à côté…".encode(), wrong)
    cut = E._decode("…".encode(), wrong)[:2]
    assert not E.repair(bad)[2] and E.repair(bad + " et " + cut + " fin")[2]


@pytest.mark.parametrize("true,wrong,share,text", [("cp1250", "cp1252", 0.34, PL), ("cp1250", "cp1252", 0.6, PL), ("cp1251", "cp1252", 0.5, RU), ("cp1252", "mac_roman", 0.5, "Die Dichtung für die Öffnung wurde überprüft, Größe geändert"), ("cp1252", "cp1250", 0.34, "La pièce est très usée, même après le contrôle à la chaîne")])
def test_large_share_of_a_source(spark, true, wrong, share, text):
    bad = text.encode(true).decode(wrong)
    n = round(share * 50)
    df = spark.createDataFrame([(i, f"{bad if i < n else text} {i}") for i in range(50)], "doc_id long, text string")
    got = {r.id: r.fixed for r in E.restored(df).collect()}
    assert got == {i: f"{text} {i}" for i in range(n)}


def test_signs_beside_letters_stay(spark):
    rows = ["50 cm³ at 20°C", "12 kΩ ±5 %", "3µm", "Nº 7 / ŽĎÁR", "x² + y²"] * 8
    assert E.found(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).count() == 0
