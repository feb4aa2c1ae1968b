"""Look-alikes, garbled text and personal information."""

import pytest

from siftwright.llm import encoding, lookalike, pii
from siftwright.llm.pii_corpus import Maker, dni_letter, nir_key

WORDS = ["Northgate Savings", "Café Lumière", "Größe über Straße", "señal mañana", "Срочно: письмо", "Отдел доставки", "“quoted” — text’s €", "naïve façade"]


@pytest.mark.parametrize("text", [w for w in WORDS if not w.isascii()])
@pytest.mark.parametrize("codec", ["latin", "cp1251", "cp437", "mac_roman"])
def test_round_trip_through_a_wrong_encoding(text, codec):
    table = {b: c for c, b in encoding._bytes_of(codec).items() if not (codec == "latin" and 0x80 <= b < 0xA0 and ord(c) == b and encoding._char("latin", b))}
    try:
        garbled = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    except KeyError:
        pytest.skip("a byte has no character there")
    assert encoding.restore(garbled) == (text, True)
    assert encoding.restore("x " + garbled + " y")[1]


def test_what_is_affected():
    assert all(encoding.restore(w) == (w, False) for w in WORDS)
    for ok in (None, "", "plain", "CAFÉ ÎLE D'ÉTÉ", "Çınarlı Kargo", "„groß“", "Вёсла", "日本語", "x" * 500_000, "Ångström", "Åsbø"):
        assert encoding.restore(ok) == (ok, False)
    assert encoding.restore("piÃƒÂ¨ce") == ("pièce", True) and encoding.restore("Ñðî÷íî") == ("Срочно", True) and encoding.restore("Pe�a")[1]


def test_restored_table(spark):
    rows = [("subject", 1, "grÃ¶ÃŸe", "c"), ("subject", 2, None, "c"), ("subject", 3, "", None), (None, None, "ok", None), ("subject", 1, "grÃ¶ÃŸe", "c")]
    df = spark.createDataFrame(rows, "field_name string, row_id long, value string, restored string")
    got = sorted(((r.row_id, r.restored, r.affected) for r in encoding.restored(df).collect()), key=str)
    assert got == sorted([(1, "größe", True), (1, "größe", True), (2, None, False), (3, "", False), (None, "ok", False)], key=str)
    assert encoding.restored(df.limit(0)).count() == 0


def test_look_alikes(spark):
    watch = spark.createDataFrame([(1, "name", "Copy-Shop Café"), (2, "host", "a-pay.example"), (3, "name", None), (4, "name", "")], "watch_id long, field_name string, canonical string")
    like = ["Сору‑Ѕһор Café", "Copy-Shop Cafе́", "Ｃｏｐｙ－Ｓｈｏｐ　Ｃａｆé", "Co​py-Shop Café", "Copy-Shop Cafe\u0301"]
    unlike = ["Copy-Shop Café", "Copy-Shop Cafe", "copy-shop Café", "Copy-Sh0p Café", "Копи-Шоп", "", None, "Copy-Shop Café!"]
    hosts = ["а-pay.example", "xn--" + "а-pay".encode("punycode").decode() + ".example", "a-pay.example", "a-pay.test"]
    rows = [("name", i, v, 0) for i, v in enumerate(like + unlike)] + [("host", 100 + i, v, 0) for i, v in enumerate(hosts)] + [("name", 0, like[0], 0)]
    got = [(r.field_name, r.row_id, r.watch_id) for r in lookalike.look_alikes(spark.createDataFrame(rows, "field_name string, row_id long, value string, watch_id int").drop("watch_id"), watch).collect()]
    assert sorted(got) == sorted([("name", 0, 1)] * 2 + [("name", i, 1) for i in range(1, 5)] + [("host", 100, 2), ("host", 101, 2)])
    empty = spark.createDataFrame([], "field_name string, row_id long, value string")
    assert lookalike.look_alikes(empty, watch).count() == 0
    assert lookalike.shown("xn--zzzzz!.test") and lookalike.Reader({}).read("a" * 100_000 + "é") == "a" * 100_000 + "é"


GIVEN, FAMILY = ["Mark", "Grace", "Carmen", "Ilse", "Summer"], [f"{a}{b}" for a in ("Kalm", "Dun", "Ostr", "Vel") for b in ("ault", "emann", "quist", "orro", "umbe")]


@pytest.fixture(scope="module")
def model():
    return pii.Model(GIVEN, FAMILY, samples=1500)


def test_held_out_sentences(model):
    maker, hit, wrong, missed = Maker(GIVEN, FAMILY, 4321), 0, 0, 0
    for _ in range(300):
        text, spans = maker.text()
        got, want = set(model.find(text)), set(spans)
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.96 and hit / (hit + missed) > 0.94


def test_unlike_the_patterns(model):
    show = lambda t: [(k, t[a:b]) for k, a, b in model.find(t)]
    assert show("Order 425-03-4917 from relay 198.51.100.7, build 10.219.02.4.") == []
    assert show("Mark and Grace met Summer at 10:30.") == []
    assert ("email", "a.b [at] c-d [dot] test") in show("Write to a.b [at] c-d [dot] test, please.")
    n = "25021234"
    assert ("id_number", f"{n}-{dni_letter(n)}") in show(f"El documento {n}-{dni_letter(n)} pertenece a Ilse Velumbe.")
    d = "2990300195421"
    assert nir_key(d) == 97 - int(d) % 97
    assert show("") == [] and model.find(None) == [] and model.find("x" * 200_000) == []


def test_tables(spark, model):
    rows = [(1, "Best, Grace Kalmault", "c"), (2, None, "c"), (3, "", "c"), (1, "Best, Grace Kalmault", "c"), (None, "nothing", "c")]
    df = spark.createDataFrame(rows, "id long, text string, pii_kind string")
    assert [(r.id, r.pii_kind, r.start_pos, r.end_pos) for r in pii.found(df, model).collect()] == [(1, "person", 6, 20)] * 2
    assert sorted(((r.id, r.text) for r in pii.replaced(df, model).collect()), key=str) == sorted([(1, "Best, [PERSON]"), (1, "Best, [PERSON]"), (2, None), (3, ""), (None, "nothing")], key=str)
    assert pii.found(df.limit(0), model).count() == 0
    m = pii.model_of(spark.createDataFrame([("Grace", "given"), (None, "given"), ("", "family"), ("Kalmault", "family"), ("x", "other")], "name string, kind string"))
    assert m.names.given == {"grace"} and m.names.family == {"kalmault"}


@pytest.mark.parametrize("department", ["2A", "2B", "75"])
def test_nir_with_and_without_separators(department):
    from siftwright.llm.pii import _ids

    body = ["1", "84", "07", department, "123", "456"]
    key = f"{nir_key(''.join(body).replace('2A', '19').replace('2B', '18')):02d}"
    for sep in ("", " ", "-", "."):
        number = sep.join([*body, key])
        text = f"her number is {number} since then"
        got = [(text[a:b], f) for a, b, _, f in _ids(text, {}) if text[a:b] == number]
        assert any("id|nir=True" in f for _, f in got)
