"""Garbled text of many encodings comes back; correct text in many languages stays as it is."""

import pytest

from siftwright.llm import encoding

RU, GR, PL, CZ = "Проверка счёта: письмо для Ольги", "Καλημέρα κόσμε, το μήνυμα", "Zażółć gęślą jaźń, dziękuję za wiadomość", "Příliš žluťoučký kůň"
TR, ZH, TW, JA, KO = "Teşekkür ederim, güncelleme için bağlantı", "您好,请确认账单和密码", "您好,請確認帳單和密碼", "こんにちは、請求書を確認してください", "안녕하세요 주문하신 상품"
UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def shown(data: bytes, view: str) -> str:
    if view == "latin":
        return "".join(chr(b) if b in UNDEFINED else bytes([b]).decode("cp1252") for b in data)
    return data.decode(view)


@pytest.mark.parametrize(
    "text, true, view",
    [
        (RU, "cp1251", "latin"), (RU, "koi8_r", "latin"), (RU, "iso8859_5", "latin"), (RU, "koi8_r", "cp1251"), (RU, "cp1251", "koi8_r"), (RU, "utf-8", "koi8_r"), (RU, "utf-8", "cp866"), (RU, "utf-8", "latin"), (RU, "utf-8", "gbk"),
        (GR, "iso8859_7", "latin"), (GR, "cp1253", "latin"), (PL, "iso8859_2", "latin"), (PL, "cp1250", "latin"), (CZ, "iso8859_2", "latin"), (CZ, "cp1250", "latin"), (PL, "utf-8", "cp1250"), (TR, "iso8859_9", "latin"), (TR, "utf-8", "cp1254"),
        (ZH, "gb18030", "latin"), (TW, "big5", "latin"), (JA, "cp932", "latin"), (JA, "euc_jp", "latin"), (KO, "cp949", "latin"), (ZH, "utf-8", "gbk"), (ZH, "utf-8", "latin"), (JA, "utf-8", "cp932"), ("André café", "utf-8", "gbk"), ("Größe", "utf-8", "gbk"),
    ],
)
def test_comes_back(text, true, view):
    garbled = shown(text.encode(true), view)
    assert garbled != text and encoding.restore(garbled) == (text, True)


@pytest.mark.parametrize(
    "text",
    [
        "ÁÉÍÓÚ", "ÀÉÎ", "ÄÖÜß", "ÅÄÖ", "ÆØÅ", "ÑÚ", "SEÑORÍA ÁÉÍÓÚ ÑANDÚ", "ÉCOLE D'ÉTÉ À L'ÎLE DÉJÀ", "L’ÉTÉ À NOËL ÇA", "ÜBERGRÖßE ÄRGER", "CÂMARA NÃO É AÇÃO", "ÆRØ PÅ ÅBENT KØB", "ÞÓR ÞÝÐING ÆGIR ÁÐUR",
        "Hæ, það er góður dagur í Reykjavík", "m³ und m³, 3 m² à 5 °C", "nº 1ª, n.º 149", "¿cómo estás? ¡qué!", "«Ça va», dit-il", "½ und ¼", "Lefèwyck et Brænwyck", "T恤 K歌 U盘 卡拉OK 茅台", "В 1990 году", "СССР — Россия", "ПРИВЕТ МИР",
        "Ολοκλήρωση ΠΛΗΡΩΜΗΣ", "ŁÓDŹ ŻÓŁĆ", "ČEŠTINA A SLOVENČINA", "ĞÜŞİÖÇ", RU, GR, PL, CZ, TR, ZH, TW, JA, KO, "naïve façade", "100 €", "“quoted” — text’s", "Fjordlin\u0435\u00a0Cargo", "Archiv\u0435\u00a0Exchange", "Р\u00a0и\u00a0С",
    ],
)
def test_correct_text_stays(text):
    assert encoding.restore(text) == (text, False)
    assert encoding.restore(f"Re: {text} (2)") == (f"Re: {text} (2)", False)


def test_parts_and_mixtures():
    assert encoding.restore("Zürcher PrÃ¼fstelle") == ("Zürcher Prüfstelle", True)
    assert encoding.restore("TR : rÃ©ponse Ã  clÃ© 357") == ("TR : réponse à clé 357", True)
    assert encoding.restore("La piГЁce rГ©pГ©tГ©e fut signalГ©e. Voilà, déjà préférée.")[0].startswith("La pièce répétée fut signalée. Voilà")
    assert encoding.restore("it\x92s") == ("it’s", True) and encoding.restore("Acci�n") == ("Acci�n", True)
    assert encoding.restore("ÃƒÂ¼ber ÃƒÂ¤hnlich") == ("über ähnlich", True)
    long = "Prüfung größtenteils gelöscht. " * 20_000
    assert encoding.restore(long) == (long, False)
