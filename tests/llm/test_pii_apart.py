"""Personal information in sentences that were written by hand.

The first set was written apart from the training sentences (recall 0.88, precision 0.95 then); its misses led to
further training patterns, so it shows that these are learnt. The second set came after them (recall 0.79, precision 0.90).
"""

import re
from functools import cache

import pytest

from siftwright.llm import pii, tokens

GIVEN, FAMILY = ["Mark", "Grace", "Carmen", "Ilse", "Summer"], [f"{a}{b}" for a in ("Kalm", "Dun", "Ostr", "Vel") for b in ("ault", "emann", "quist", "orro", "umbe")]
MARKED = """
My SSN is <id_number:123-45-6789> and my number at work is <phone:(212) 736-5000>.
SSN <id_number:078-05-1120> belongs to <person:Anna Berger>, not to her brother.
<person:Dr.|Wei Zhang> called from <phone:+86 21 6279 8888> about the shipment.
According to <person:Priya Ramanathan>, the Red Cross will send a driver on Monday.
Please forward this to <email:oluwaseun.b@mail-relay.example> and to <person:Oluwaseun Bakare>.
The New York Times and the Wall Street Journal both asked Grace for a comment.
<person:Margaret O’Sullivan> moved to <street:14 Gainsborough Road> in March 2024.
Invoice 2024-118-4471 was paid on 12.03.2024; the balance is 1,204.50 EUR.
Her NI number is <id_number:JG 10 37 59 A>, she told us twice.
We met at <street:221b Baker Street>, then walked to the station.
Ring <person:J. Whitcombe> on <phone:020 7946 0123> or <phone:07700 900982>.
Ticket 4419-22-0071 mentions build 10.4.2 and host relay7.example only.
Sehr geehrter <person:Herr|Jürgen Kowalczyk>, Ihre Steuer-ID lautet <id_number:86095742719>.
Bitte senden Sie das Paket an <person:Annegret Schöller>, <street:Lindenallee 48>, 50968 Köln.
Die Deutsche Bahn und die Stadtwerke haben die Rechnung Nr. 77-4410 bestätigt.
Unter <phone:0221 4710-889> erreichen Sie <person:Heinz-Peter Wollweber> ab neun Uhr.
Meine neue Adresse ist <street:Am Alten Markt 7>, die alte gilt nicht mehr.
Das Protokoll der Sitzung vom 3. Mai hat 14 Seiten.
<person:Mme|Béatrice Fontanel> habite <street:8, rue des Martyrs> depuis dix ans.
Mon numéro de sécurité sociale est <id_number:2 69 05 49 588 157 80>, merci de le garder.
Contactez <person:Thibault Delacroix-Ménard> au <phone:06 12 34 56 78> avant midi.
Le Conseil Municipal et la Banque Postale ont répondu hier à 14 h 30.
Envoyez une copie à <email:t.delacroix(at)courrier.example>, svp.
La <person:señora|Carmen Zorrilla> vive en <street:Calle Mayor 55>, Madrid.
Mi DNI es <id_number:12345678Z> y mi teléfono es el <phone:612 345 678>.
El Ministerio de Hacienda publicó la Orden 44/2023 el martes.
Preguntad por <person:Íñigo Echevarría> en <email:inigo.echevarria@oficina.example>.
Codice fiscale <id_number:RSSMRA85T10A562S>, intestato a <person:Mario Rossini>.
AHV-Nummer <id_number:756.9217.0769.85> gehört zu <person:Urs Zbinden>.
Meeting notes: Grace will talk to Mark; Summer is on holiday until 2024-08-19.
From London Bridge to Kings Cross it takes 12 minutes by Northern Line.
My passport expires in 2029; the reference is KX-90211-B.
Thanks again, <person:Kwabena Osei-Tutu>
Call me: <phone:+44 20 7946 0958>, or write to <email:kwabena [at] osei [dot] example>.
""".strip().splitlines()
#: Written after the training sentences were last changed, and measured once.
LATER = """
The claim was filed by <person:Rosalind Achterberg> of <street:77 Mill Lane>, Leeds.
Text me at <phone:(503) 228-9561> or email <email:r.achterberg@claims.example>.
<person:Tomasz Wiśniewicz> and <person:Ines Caldeira> share an office on the third floor.
Employee <person:Devika Raghavan>, SSN <id_number:219-09-9999>, joined in 2019.
Central Station closes at 11 pm; Platform 9 is under repair.
Our office has moved to <street:3 Harbour Crescent>; the old phone, <phone:01273 555 812>, is dead.
Die Versicherung von <person:Frau|Hannelore Brinkmeyer> endet am 31.12.2025.
Rückfragen an <person:Sönke Petersen>, Tel. <phone:040 / 33 44 55-66>.
Wir ziehen um: <street:Goethestraße 12b>, 60313 Frankfurt.
Der Vorsitzende des Ausschusses begrüßte die Gäste aus Nordrhein-Westfalen.
<person:Monsieur|Olivier Castagnier> demeure <street:25 bis avenue Victor Hugo> à Lyon.
La Cour Suprême a rendu sa décision le 4 avril 2023, dossier 22-118.
Merci d’appeler <person:Solène Guivarc’h> au <phone:+33 2 98 44 10 20>.
El paciente <person:Joaquín Arístegui>, NIE <id_number:X1234567L>, acudió ayer.
Recogida en <street:Avenida de América 21>, planta baja.
La Universidad Complutense y el Banco Central firmaron el acuerdo.
Best wishes, <person:Oyelaran Adeniyi>
Order 114-7781203-44 ships from Warehouse 12 to Port Elizabeth.
Version 3.14.15 fixes bug 10293 in Data Center Edition.
NINO <id_number:AB123456C> was verified by <person:Gwendolyn Pryce-Jones>.
""".strip().splitlines()


def parsed(line: str) -> tuple[str, set]:
    out, spans, at = "", set(), 0
    for m in re.finditer(r"<(\w+):(?:([^|>]*)\|)?([^>]*)>", line):
        out += line[at : m.start()] + (f"{m[2]} " if m[2] else "")
        spans.add((m[1], len(out), len(out) + len(m[3])))
        out, at = out + m[3], m.end()
    return out + line[at:], spans


@cache
def model() -> pii.Model:
    return pii.Model(GIVEN, FAMILY, common=tokens.common_words(tokens.VOCABULARY))


@pytest.mark.parametrize("lines, recall, precision", [(MARKED, 0.9, 0.9), (LATER, 0.75, 0.85)])
def test_recall_and_precision(lines, recall, precision):
    hit = wrong = missed = 0
    for line in lines:
        text, want = parsed(line)
        got = set(model().find(text))
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
        for k, a, b in got ^ want:
            print("wrong" if (k, a, b) in got else "missed", k, text[a:b], "|", text)
    print(f"recall {hit / (hit + missed):.2f}, precision {hit / (hit + wrong):.2f}")
    assert hit / (hit + missed) >= recall and hit / (hit + wrong) >= precision


def test_long_addresses_and_texts():
    local = "a" * 300
    text = f"write to {local}@mail.example today"
    assert ("email", 9, 9 + len(local) + 13) in model().find(text)
    assert not [k for k, *_ in model().find("https://x.example/" + "p/" * 3000 + "u@mail.example") if k == "email"]
    assert model().find("@" * 50_000) == [] and model().find("1 " * 20_000) is not None
