"""Labelled sentences to train the personal-information model on, made from rules.

Names, streets and numbers are put together anew from syllables for each sentence, so the model
learns forms and surroundings rather than the entries themselves. Markers ``{kind:...}`` in the
patterns below name what is filled in; what isn't personal is filled in without a label.
"""

from __future__ import annotations

import random
import re

# Syllables, street words of four languages, and sentence patterns.
_SYL = "ba be bo da de do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te ti to va ve vi wa we za ze".split()
_END = "ran lin mar nel sen ton vik dal berg man der stein ova ini ez ard ot eau".split()
STREET_AFTER = "Street St Road Rd Avenue Ave Lane Close Court Drive Terrace Square Way Place Crescent Row Hill".split()
STREET_TAIL = "straße str. gasse weg allee ring platz steig stieg damm ufer pfad hof".split()
STREET_BEFORE = "rue de la|rue des|rue du|rue|avenue|place de la|place|quai des|quai aux|quai|allée des|allée|impasse|chemin des|chemin du|bd du|boulevard|Calle|C/|C/ del|Avenida|Plaza|Plaza del|Paseo|Camino|Ronda|Zum|Am|An der|Im".split("|")
# Names of many countries, so that the model doesn't learn what one list's names look like.
GIVEN_WIDE = "Wei Li Ming Hiroshi Yuki Akira Min-jun Seo-yeon Priya Arjun Deepak Anjali Fatima Omar Layla Yusuf Ahmed Zainab Chidi Amara Kwame Ngozi Thabo Olga Dmitri Svetlana Ivan Katarzyna Paweł Zofia Jiří Zdeněk Ágnes László Ioana Mihai Elena Giorgos Dimitra Ayşe Mehmet Emre Giulia Matteo Chiara Lars Ingrid Sven Astrid Mikko Aino João Inês Rui Pieter Femke Noah Emily Jack Sophie Hans Ursula Jürgen Émile Chloé Begoña Íñigo".split()
FAMILY_WIDE = "Zhang Wang Chen Liu Tanaka Suzuki Watanabe Kim Park Nguyen Tran Sharma Patel Krishnan Subramanian Chatterjee Iyer Haddad Mansour El-Sayed Okafor Adeyemi Mensah Dlamini Ivanov Sokolova Kuznetsov Kowalski Wiśniewska Novák Dvořáková Szabó Nagy Popescu Ionescu Papadopoulos Yılmaz Demir Rossi Esposito Moretti Lindqvist Johansson Nieminen Virtanen Silva Ferreira van-Dijk Visser Thompson O’Connor MacLeod Whitaker Schneider Hoffmann Köhler Lefèvre Beaumont Rousseau García Fernández Echeverría".split()
PATTERNS = (
    "Dr. {person} called about {ref}.", "Mr. {person} and Mrs. {person} signed.", "Prof. {person}, {org}", "{person} called at {time}.", "I spoke with {person} yesterday.", "Signed by {person} on May {n2}.", "Call {person} at {phone} please.", "cc {person}", "Herr {person} bittet um Rückruf: {phone}.", "Sr. {person}, DNI {id_number}, llamó.", "Le dossier de M. {person} est complet.",
    "SSN {id_number} belongs to {person}.", "My SSN is {id_number}.", "my social security number is {id_number}, thanks", "NI number {id_number}, {person}.", "DNI {id_number}", "Steuer-ID {id_number} von {person}.", "Codice fiscale {id_number} di {person}.", "AHV-Nummer: {id_number}", "Her insurance number, {id_number}, was {word}.", "{person} lives at {street}.", "Ship it to {street} by {time}.", "Mobile: {phone}", "Fax {phone}, email {email}",
    "Profile: https://{host}/u/{addr}", "git clone ssh://{addr}/{word}.git", "see https://{host}/{word}/{word}/{addr}?x={n2}", "According to {person}, the {cap} {cap} {word} on {cap}.", "Please send it to {person}, {street}.", "Ask {person} in {cap}.", "An {person}, {street}, {n2}{n3} {cap}", "erreichen Sie {person} ab {n2} Uhr", "Preguntad por {person} en {email}.", "Die {cap} und die {cap} haben die {cap} Nr. {n2}-{n4} {word}.",
    "The {cap} {cap} said {word} today.", "{cap} {cap} opened in {cap}.", "{cap} {cap}, {cap} and {cap}", "New {cap} {cap} for all.", "Our {cap} {cap} team {word} it.", "Welcome to {cap} {cap}!", "Version {d}.{n2} of {cap} {cap} is out.", "Serial {n3}-{n2}-{n4}", "Part no. {n3}-{n4}-{n2}", "Meeting on 20{n2}-{n2}-{n2} about {cap}.", "IBAN DE{n2} {n4} {n4} {n4} {n4} {n2}", "Card ending {n4}, amount {n3}.{n2}",
    "Please ring {person} on {phone} about {ref}.", "Dr {person} moved from {street} to {street}.", "The parcel for {person} goes to {street} this week.",
    "As {person} wrote on {ref}, the {word} is {word}.", "{person} of {org} confirmed {word} {ref}.", "Kind regards, {person} {street} Tel. {phone}",
    "Best,\n{person}\nTel. {phone}", "Thanks, {person}", "Cordialement, {person}", "Mit freundlichen Grüßen,\n{person}\n{street}", "Un saludo, {person} {street}",
    "Contact: {email} / {phone}", "Write to {email} before {time}.", "Copy {email} and {email} on the {word}.", "Reach me under {phone} or {email}.",
    "Répondez à {email}, objet {ref}.", "Antwort an {email}, Betreff {ref}.", "Responda a {email}, asunto {ref}.", "Questions : {phone} ou {email}.", "Rückfragen: {phone} oder {email}.",
    "Identity number {id_number} was given for {person}.", "Le numéro {id_number} appartient à {person}.", "El documento {id_number} pertenece a {person}.", "Ausweisnummer {id_number} gehört zu {person}.",
    "Applicant {person}, document {id_number}, phone {phone}, was {word}.", "For the refund we need {id_number} and nothing else.", "My number is {phone}; the old one, ext. {n2}, is dead.",
    "Bitte {person} unter {phone} anrufen.", "Veuillez joindre {person} au {phone}.", "Llame a {person} al {phone}.", "Frau {person} wohnt jetzt {street}.", "Mme {person} habite désormais {street}.",
    "La señora {person} vive ahora en {street}.", "Our driver waits at {street} until {time}.", "{phone}", "{person}", "Consultas: {phone} o {email}.",
    # Nothing personal, though it may look so.
    "Order {n3}-{n2}-{n4} and batch 20{n2}-{n2}-{n3} left {org}.", "Order {n2}-{n2}-{n4} and batch {n4} left {org}.", "Tracking {n8}-{n2} belongs to {org}, Gate {n2}.", "RFC 5322 section 3.{n2}.{n3} and invoice 0{n3}-{n4} were cited.",
    "Invoice {n3} {n2} {n4} is paid.", "Ticket {n9} and parcel {n8} were sent.", "Message-ID <{hex}.{n3}@{host}> was logged as {ref}.", "See https://{host}/u/@{word}/{n3} for the {word}.", "In-Reply-To: <{hex}@{host}>",
    "Project {cap} {cap} uses build {n2}.{n3}.{n2}.{d} since {time}.", "The {given} {after} project has {n3} open tickets, {word}.", "Hi {given}, will {given} and {given} join on May {n2}?", "{given} asked whether {given} saw it.",
    "Hop {n3} shows {ip} before {host}, so the {word} {word} it.", "Relay {ip} sent {n3} bytes, checksum {hex}, exit code 550-5.7.{n2}.", "Between {n2}:{n2} and {n2}:{n2} the {word} {word} {n3} {word}s.", "Roughly {n3} recipients opened the {word}.",
    "Die {cap} hat die {word} {cap} um {time} {word} übernommen.", "Ohne {cap} keine {cap}: das {cap} hat {n8} gezählt.", "Betrag {n3},{n2} € für {cap} {ref}, früh bestätigt.", "Case {ref}: {word} {word}, {word} pending.", "Pourquoi un prestataire garde {n8} ?",
    "{org} has {n3} boxes in {cap} {cap}.", "Between {ip} and {host} a {word} {cap} is missing.", "{cap} and {word} disagree: {ip} against {ip}.", "Entre {ip} et {host} manque une {word} {word}.", "Zwischen {ip} und {host} fehlt eine {word} {cap}.", "Dear {cap}, the {word} weighs {n3} KB.", "Message-ID <{n8}.{n3}@{host}> was {word}.", "Sehr geehrte Damen und Herren, {cap} der {cap} {word}.", "Guten Tag, {cap} {word} {word}.", "Buenos días, {cap} {word}.", "Bonjour, {cap} {word}.", "Good morning, {cap} {word}.", "Hi all, {cap} and {word}.", "Kind regards", "Best, {given}", "Thanks, {given}\nDear {given}, the {word} is {word}.", "Hello {given}, see {ref}.", "Cordialement, {given}", "Un saludo, {given}", "Mit freundlichen Grüßen, {given}", "Mrs {cap} {word} it.", "{cap} {given} {word}.", "{cap} und {cap} wurden {word}.", "Expediente {ref}: {word} {word}.",
)


class Maker:
    """Filled patterns with the character spans of what is personal."""

    def __init__(self, given: list[str], family: list[str], seed: int = 7, common: tuple[str, ...] = ()):
        self.r, self.given, self.family, self.common = random.Random(seed), given or ["Anna"], family or ["Berger"], common

    def _word(self, low: int = 2, high: int = 3) -> str:
        return "".join(self.r.choice(_SYL) for _ in range(self.r.randint(low, high)))

    def _name(self, listed: list[str], wide: list[str]) -> str:
        """A listed name two times in five, else one of the wide list, or one made from syllables or from a listed beginning."""
        k = self.r.random()
        if k < 0.4:
            return self.r.choice(listed)
        if k < 0.7:
            return self.r.choice(wide)
        return (self._word(1, 2).capitalize() if k < 0.85 else self.r.choice(listed)[: self.r.randint(3, 5)]) + self.r.choice(_END)

    def _cap(self) -> str:
        """A capitalised word that is no name: a common one, or one made from syllables."""
        return (self.r.choice(self.common) if self.common and self.r.random() < 0.6 else self._word(2, 4)).capitalize()

    def person(self) -> str:
        r = self.r
        family = self._name(self.family, FAMILY_WIDE) + (f"-{self._name(self.family, FAMILY_WIDE)}" if r.random() < 0.15 else "")
        given = self._name(self.given, GIVEN_WIDE)
        if r.random() < 0.15:
            given = f"{given[0]}."
        elif r.random() < 0.15:
            given += f" {r.choice('ABCDEHILMNOSTUWY')}."
        out = f"{family}, {given}" if r.random() < 0.12 and not given.endswith(".") else f"{given} {family}"
        return out.upper() if r.random() < 0.08 else out

    def email(self) -> str:
        r, local, host = self.r, self._word(), self.host()
        local += r.choice(["", f".{self._word()}", f"_{self._word()}", f"-{self._word()}", f"+{self._word()}", str(r.randint(1, 99))])
        at, dot = r.choice([("@", ".")] * 6 + [("[at]", "[.]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot ")])
        out = f"{local}{at}{host.replace('.', dot)}"
        return out.upper() if r.random() < 0.1 else out

    def phone(self) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        nz = lambda n: r.choice("23456789") + d(n - 1)
        if r.random() < 0.4:
            cc = r.choice("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 64 65 81 82 86 90 91 353 351 358 420 421 971".split())
            rest = r.choice([f"{nz(2)} {d(3)} {d(4)}", f"{nz(3)} {d(3)} {d(3)}", f"{nz(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{nz(9)}", f"({nz(2)}) {d(4)} {d(4)}", f"{nz(3)}-{d(3)}-{d(4)}", f"{nz(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{nz(3)} {d(7)}", f"{nz(4)} {d(6)}"])
            return r.choice(["+", "+", "00"]) + cc + r.choice([" ", " ", "-"]) + rest
        if r.random() < 0.4:
            return r.choice([
                f"({nz(3)}) {nz(3)}-{d(4)}", f"{nz(3)}-{nz(3)}-{d(4)}", f"{nz(3)}.{nz(3)}.{d(4)}", f"{nz(3)} {nz(3)} {d(4)}", f"1-{nz(3)}-{nz(3)}-{d(4)}", f"0{nz(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{nz(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"0{nz(2)} {d(7)}", f"0{nz(2)}/{d(7)}", f"0{nz(3)} {d(6)}",
                f"0{nz(4)} {d(6)}", f"020 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"0{nz(3)}-{d(6)}", f"6{d(2)} {d(3)} {d(3)}", f"9{d(2)} {d(2)} {d(2)} {d(2)}", f"0{nz(10)}", f"{nz(3)}-{d(4)}",
            ])
        return r.choice([
            f"+49 {d(2)} {d(8)}", f"+49 (0){d(2)} {d(5)}-{d(3)}", f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(2)} {d(5)} {d(3)}", f"0049 {d(2)} {d(5)} {d(3)}", f"+1 {d(3)} 555 {d(4)}", f"({d(3)}) 555-{d(4)}",
            f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"+1-{d(3)}-555-{d(4)}", f"1{d(3)}555{d(4)}", f"+1{d(3)}555{d(4)}", f"+44 20 7946 0{d(3)}", f"+44 (0)20 7946 0{d(3)}", f"01632 960{d(3)}", f"0044 1632 960 {d(3)}",
            f"+441632960{d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"01 99 00 {d(2)} {d(2)}", f"0033199 00{d(4)}", f"+33199 00 {d(4)}", f"+34 9{d(2)} {d(3)} {d(3)}",
        ])

    def id_number(self) -> str:
        r = self.r
        d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        k = r.choice([0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6])
        if k == 0:
            area = f"9{d(2)}" if r.random() < 0.4 else f"{r.choice([x for x in range(1, 900) if x != 666]):03d}"
            return r.choice(["-", "-", " ", ""]).join((area, f"{r.randint(1, 99):02d}", f"{r.randint(1, 9999):04d}"))
        if k == 1:
            letters = r.choice(["QQ", "AB", "ZX"]) if r.random() < 0.3 else r.choice("ABCEGHJKLMNOPRSTWXYZ") + r.choice("ABCEGHJKLMNPRSTWXYZ")
            parts = (letters, d(2), d(2), d(2), r.choice("ABCD"))
            out = r.choice([" ", "", "-"]).join(parts)
            return out.lower() if r.random() < 0.1 else out
        if k == 4:
            n = r.choice("123456789") + d(9)
            n += str(tax_digit(n))
            return r.choice([n, f"{n[:2]} {n[2:5]} {n[5:8]} {n[8:]}"])
        if k == 5:
            n = "756" + d(9)
            n += str(ean_digit(n))
            return r.choice([f"{n[:3]}.{n[3:7]}.{n[7:11]}.{n[11:]}", n])
        if k == 6:
            l = lambda n: "".join(r.choice("BCDFGLMNPRSTVZAEIO") for _ in range(n))  # noqa: E731, E741
            return f"{l(6)}{d(2)}{r.choice('ABCDEHLMPRST')}{r.randint(1, 71):02d}{l(1)}{d(3)}{l(1)}"
        if k == 2 and r.random() < 0.3:
            n = d(7)
            first = r.choice("XYZ")
            return f"{first}{r.choice(['', '-'])}{n}{r.choice(['', '-'])}{dni_letter(str('XYZ'.find(first)) + n)}"
        if k == 2:
            n = d(8)
            return f"{n}{r.choice(['', '-'])}{dni_letter(n)}"
        parts = [r.choice("12"), d(2), f"{r.randint(1, 12):02d}", d(2), d(3), d(3)]
        return r.choice([" ", " ", ""]).join([*parts, f"{nir_key(''.join(parts)):02d}"])

    def street(self) -> str:
        r = self.r
        no = f"{r.randint(1, 250)}{r.choice(['', '', '', 'a', 'b', ' b'])}"
        name = lambda: r.choice([self._word().capitalize(), self.r.choice(["Old ", "North ", "Copper ", "Saint ", "Lower "]) + self._word().capitalize(), self._word().capitalize() + "’s"])
        k = r.randint(0, 2)
        if k == 0:
            return f"{no} {name()} {r.choice(STREET_AFTER)}"
        if k == 1:
            return f"{self._word().capitalize()}{r.choice(STREET_TAIL)} {no}"
        way, called = r.choice(STREET_BEFORE), r.choice([self._word().capitalize(), f"{self._word().capitalize()}-{self._word().capitalize()}", f"{self._word().capitalize()} {self._word().capitalize()}", "d'" + self._word().capitalize()])
        if way[0].islower():
            return f"{no.replace(' b', ' bis')}{r.choice([' ', ', '])}{way} {called}"
        return f"{way} {called}{r.choice([' ', ', ', ' n.º '])}{no}"

    def host(self) -> str:
        return f"{self._word()}{self.r.choice(['', '-' + self._word()])}.{self.r.choice(['example', 'test', 'invalid', 'example'])}"

    def _plain(self, what: str) -> str:
        r = self.r
        if what[0] == "n" and what[1:].isdigit():
            return "".join(r.choice("0123456789") for _ in range(int(what[1:])))
        return {
            "ref": lambda: f"{r.choice('KQRT')}{r.choice('AEX')}-{r.randint(1000, 99999)}", "word": lambda: self._word(2, 4), "time": lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}", "d": lambda: str(r.randint(0, 9)),
            "org": lambda: f"{self._word().capitalize()} {self._word().capitalize()} {r.choice(['Logistics', 'Depot', 'Bank', 'Services'])}", "cap": self._cap, "given": lambda: r.choice(self.given), "after": lambda: r.choice(STREET_AFTER),
            "addr": lambda: f"{self._word()}@{self.host()}", "ip": lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)), "host": self.host, "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 12, 16]))),
        }[what]()

    def sentence(self) -> tuple[str, list[tuple[str, int, int]]]:
        out, spans = "", []
        for part in re.split(r"(\{\w+\})", self.r.choice(PATTERNS)):
            if not part.startswith("{"):
                out += part
                continue
            what = part[1:-1]
            if what in ("person", "email", "phone", "id_number", "street"):
                text = getattr(self, what)()
                spans.append((what, len(out), len(out) + len(text)))
                out += text
            else:
                out += self._plain(what)
        return out, spans

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        """One to four sentences, one after another."""
        out, spans = "", []
        for _ in range(self.r.randint(1, 4)):
            s, own = self.sentence()
            spans += [(k, a + len(out), b + len(out)) for k, a, b in own]
            out += s + self.r.choice([" ", "\n", "\r\n", "\n\n"])
        return out, spans


def dni_letter(digits: str) -> str:
    """The control letter of a Spanish identity number."""
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23]


def nir_key(digits: str) -> int:
    """The control key of a French registration number of 13 digits."""
    return 97 - int(digits) % 97


def tax_digit(digits: str) -> int:
    """The control digit of a German tax number of 10 digits (ISO 7064, modulo 11 and 10)."""
    p = 10
    for c in digits:
        p = 2 * ((p + int(c)) % 10 or 10) % 11
    return (11 - p) % 10


def ean_digit(digits: str) -> int:
    """The control digit of 12 digits, as Swiss insurance numbers have it."""
    return -sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(digits)) % 10
