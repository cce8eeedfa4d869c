"""Labelled texts for the detector of personal information: public formats in everyday contexts.

Letters, forms, notices, mails and records of four languages are filled with made-up people; as many are filled with
what looks alike: bodies and places named after people, titles, dates, sums, references, codes. All is drawn from
one seeded generator, so the models are the same in every session.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

from .personal import Names
from .personal_words import FAMILY, GIVEN, STREETS

FRONT = "ba be bri ca co da do el fa fi ga go ha he jo ka ki la lo ma mi na no o pe ra ri sa se ta to u va vi wa ze chi sto tre bla".split()
MIDDLE = "r l n m d t s v nd rt ll ss rk lm".split()
BACK = "a e i o u ey er en in on is as ez ini ski sen mann ard eau oux ero illo ing".split()
TOWN = "ville ton field burgh port mouth ford burg heim dorf stadt berg court bourg ac villa mar polis view wood".split()
BODY = "Company|Bank|Railway|Hospital|College|School|Church|Museum|Society|Library|Institute|Foundation|Council|Insurance Company|Trust|University|Hotel|Park|Bridge|Hall|Club|Brothers|& Sons|Press|Canal|Harbour|Mill|Theatre|Station|Act|Street|Road|Award|Farm|Bay|Estate".split("|")
GEO = "Mount|Lake|Fort|Port|Cape|New|Upper|Lower|North|South|Saint|San|Bad|Old|East|West|Great|Little".split("|")
GEO_BACK = "River|Valley|Island|Hills|Bay|Beach|Falls|Heights|County|Forest|Creek|Moor".split("|")
THING = "contract order parcel report invoice harvest garden ship engine meeting cottage roof letter lecture concert wagon clock mill piano horse lamp bridge sample budget".split()
DID = "arrived failed changed ended started remained moved closed opened improved".split()
SACHE = "Vertrag Bericht Antrag Garten Wagen Brief Ofen Bescheid Haushalt Beschluss Termin Rathaus Schloss König Bürger Tisch Wasser Arbeit Zeitung Frage Hilfe Straße Abend Kirche Schule Besitz Richter Kaufmann Meister Grenze Hafen Bruder Nachbar Wiese Holz Erbe Markt Recht Vormittag Käufer Zeuge Pfarrer Bauer Preis Regen Stein Zimmer Fenster".split()
CHOSE = "contrat rapport jardin navire courrier dossier marché toit concert moulin".split()
COSA = "contrato informe jardín barco correo mercado tejado concierto molino horno".split()
MONTH = "January February March April May June July August September October November December".split()
MONATE = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
HOSTS = "gmail.com yahoo.co.uk hotmail.com outlook.com web.de gmx.net t-online.de orange.fr free.fr laposte.net telefonica.es correo.es example.org example.com mail.example city.gov uni-bonn.de hospital.org my-firm.co icloud.com post.test firm.invalid lists.example.net".split()
CAPS = "ABCDEFGHIJKLMNOPRSTUVWYZ"

EN = """Dear {T}{N}, thank you for your letter of {date}.|I spoke with {N} about the {thing}.|{N} wrote to us on {date}.|Contact: {N}, {P}|Name: {N}\nPhone: {P}\nEmail: {E}|Kind regards,\n{N}|Yours faithfully, {N}|{N} ({E}) will chair the meeting in {town}.|Please send the {thing} to {N}, {A}, {town}.
The {thing} belongs to {T}{N} of {A}.|{T}{N} and {T}{N} {did} the {thing}.|Patient {N}, SSN {I}, lives at {A}.|Passport {I} was issued to {N}.|You can reach me at {P} or {E}.|Call {P} after six.|Tel. {P}, fax {P}|His number is {P}.|Her tax number is {I}.|Social security number: {I}
Mail {E} if the {thing} {did}.|Email: {E}|<{E}>|by {N}, {date}|The witness {N} said that the {thing} {did}.|According to {N}, the {thing} {did}.|Written by {N} for the {org}.|{N}, aged {small}, of {town}, {did} in {year}.|Driver licence {I}, holder {N}|National insurance number {I}
Deliver to {A}.|We met at {A} in {town}.|The house at {A} {did}.|The sale between {N} and {N} {did} on {date}.|Signed: {N}|{N}; {A}; {P}; {E}|id={I};phone={P};mail={E}|Identity card no. {I}, valid until {year}|{N} lives in {town}.|I, {N}, of {A}, declare the {thing} mine.|Write to {E} or ring {P}.|{P}, ext. {small}|{N}|{E}|I am, sir, {N}|Yours ever, {N}|In haste, {N}|{N} and {N} own the {thing}.|{N} will bring the {thing}, {N} the {thing}.|We asked {N} for the {thing}.|Have you met {N}?|My neighbour {N} {did}.|{N} sold {N} the {thing}.|It was {N} who {did}.|{N} of {town} {did}.|the poet {N}|The owner, {N}, {did}.|{N}\n{N}\n{N}|{N}\n{org}\n{town}|{N}, {town}|- {N}\n- {N}|{N}, {N} and {N} {did}.|With love, {N}|She dialled {P} twice.|{P} is the line to use.|try {P} or {P}|{I} is the number on the passport.
He thanked {N}. The {thing} {did}.|Our tenant ({N}, {A}) paid {money}.|Papers: {I}|Her papers ({I}) were lost in {town}.|We wired it to {E}.|He goes by {N} in {town}.|{T}{N}'s {thing} {did}.|{N}, Esq., {A}.|the estate of {N}, late of {town}"""
FR = """Madame, Monsieur, le {chose} de {N} est arrivé.|M. {N} habite {A} à {town}.|Mme {N} a signé le {chose}.|Écrivez à {N}, {A}, {town}.|Téléphone : {P}|Tél. {P}|Vous pouvez joindre {N} au {P}.|Courriel : {E}|Merci d'écrire à {E}.|Numéro de sécurité sociale : {I}|Passeport {I}, délivré à {town}|Le témoin {N} demeure {A}.
Le {chose} appartient à M. {N}.|Appelez le {P} avant midi.|Fait à {town}, {N}|Nom : {N}\nAdresse : {A}|La carte d'identité {I} est au nom de {N}.|Son numéro fiscal est {I}.|{N} a vendu le {chose} à {N}.|Je m'appelle {N}.|{N} n'a pas vu le {chose}; {N} non plus.|Le voisin, {N}, a vu le {chose}.|Selon {N}, le {chose} est perdu.|{N}, {A}, {P}"""
DE = """Sehr geehrte Frau {N}, der {sache} liegt bei.|Herr {N} wohnt {A} in {town}.|Telefon {P}|Tel.: {P}|Sie erreichen uns unter {P} oder {E}.|Steuernummer {I}|Reisepass Nr. {I}, Inhaber {N}|Der {sache} wurde von {N} geprüft.|Mit freundlichen Grüßen\n{N}|Anschrift: {A}, {town}|Die Zeugin {N} ({P}) kannte den {sache}.
Ausweisnummer {I}|Schreiben Sie an {N}, {A}.|E-Mail: {E}|Rufen Sie {P} an.|gez. {N}|Nach {N} war der {sache} fertig.|Sozialversicherungsnummer: {I}|Mein Name ist {N}.|Der Nachbar {N} kam mit {N}.|{N} kauft den {sache}.|Der {sache}, {N}, kam nach {town}.|Der {sache} {N} kam.|Unser {sache}, {N}, zahlt {money}.|Frau {N} und Herr {N} kamen nach {town}.|Das Haus {A} wurde verkauft."""
ES = """Estimado señor {N}: el {cosa} ha llegado.|Don {N} vive en {A}, {town}.|Teléfono: {P}|Llame al {P} antes de las seis.|Correo: {E}|Escriba a {N}, {A}.|DNI {I}|Doña {N}, con documento {I}, firmó el {cosa}.|Pasaporte {I}|La testigo {N} vio el {cosa}.|Domicilio: {A}|Firmado: {N}|El {cosa} es de {N}.|{N} vendió el {cosa} a {N}.|Me llamo {N}.|La vecina, {N}, vio el {cosa}.|{N} no vio el {cosa}.|Según {N}, el {cosa} no existe.|Su móvil es {P}.|NIE: {I}"""
PLAIN_EN = """The {org} {did} in {year}.|The {org} and the {org} share the {thing}.|In {town}, the {thing} {did} on {date}.|They travelled from {geo} to {geo}.|{town}, {town} and {geo} were closed.|Invoice {ref} of {date} comes to {money}.|See pages {range} of volume {small}.|Section {small} of the {town} Act {year}|Case {ref}, {year}|The {thing} cost {money} in {year}.
Version {version} {did} on {iso}.|ISBN {isbn}|Serial number {serial}|Order {ref}: {small} boxes @ {small} dollars|Figures: {grouped}, {dotted} and {big}|The {given} {body} {did}.|The {family} {body} {did}.|Annual General Meeting of the {org}|Terms And Conditions Of Sale|Chapter Two: The Long Road Home|The Old Man And The Sea
It rained in {month} {year}.|On Monday, {month} {small}, the {thing} {did}.|He saw {small} {town} Road workers and {year} New Town Street signs.|{range} men and {range} women came.|The {town} Street Market {did}.|In {year} Station Road {did}.|Queen Victoria Hospital, {town}|They moved to {town}, {geo}, in {year}.|Lot {ref} and box {small}.{small}.{small}
The {given} and {given} of {town} are ships.|{thing2}\n{thing2} {thing2}|The {thing2} and the {thing2} Of {town}|{thing2} {thing2} {thing2}|Item, {thing2} and {thing2}|{town}, {town}|To the {thing2}, {town}|In {town}\n{thing2} {did}.|Bring the {thing} home.|Take {thing} and {thing} to {town}.|Farmers sold the {thing} in {town}.|Nobody in {town} {did}.|Prices {did} in {year}.|Heavy rain {did}.|Workers at {geo} {did}.|Counsel for the {thing} {did}.|Teach him the {thing}.|{thing2} of the {thing} {did}.|{thing2} and {thing} {did}.|{thing2} no. {small} {did}.|{thing2} {did} in {town}.|Would the {thing} last?|{dup}|The {dup} {did}.|{thing2} {thing2} of the {thing}|The host {ip} {did}.|Ping {ip} and {ip}|He looked at two dot plots of the {thing}.|Card {card}, code {serial}|at folio {range}, line {small}|{year}-{year} and {year}/{small}|The Hope of {town} and the Faith of {geo} {did}.|The {thing} is at {geo}.|{town} {body}|{geo} {geoback}|0{small} {small} acres and {small} feet of land|Rep. {small} {small}, Rep. {small} {small}|10.1000/{small}.{small}"""
PLAIN_FR = """Le {chose} est arrivé le {small} mars {year}.|La Société {town} a fermé en {year}.|Entre {town} et {geo}, le {chose} est perdu.|Page {small}, article {small} de la loi de {year}|Le Château de {town} et le Pont du {town}|Mairie de {town}|Monsieur le Maire de {town}|La Ville de {town}, {chose}|La Banque De {town} et la Compagnie {geo}|Le {chose} coûte {money}.|La rue est fermée depuis {year}.|Place {small} du {chose}"""
PLAIN_DE = """Der {sache} und der {sache} wurden {year} geprüft.|Im {monat} {year} war der {sache} fertig.|Die Stadt {town} und das Amt {geo}|Das Gesetz Vom {small}. {monat} {year}|Der Rat Der Stadt {town}|Seite {range}, Band {small}|Das {dup} fehlt.|{small} {dup}|{Das} {sache} von {town} und {das} {sache} von {town}|Es gehört {das} {sache} von {town} und {das} {sache} zu {town}.|Wer {das} {sache} von {town} kennt, kennt {das} {sache}.|{Das} {adj} {sache} zu {town} und {das} {adj} {sache} von {town}|Er zahlte an {das} {adj} {sache} zu {town}.|Auf {adj} {sache} von {town} folgt {adj} {sache}.|Was ist mit {das} {sache} von {town}?|Im Jahre {year} fuhr er nach {town}.|Der {sache} kostet {money}.|Der {sache} von {town} und das {sache} zu {town}|{sache} von {town}|{sache} zu {town}|{sache}, {sache} und {sache}|Für den {sache}, {sache} und {sache}|Gegen den {sache}, das {sache} von {family}|Wenn der {sache} dem {sache} von {town} folgt|Er gab dem {sache} von {town} den {sache} zurück.|Die {sache} von {town} und der {sache} von {geo}|Das {sache} der {sache} zu {town} ist alt.|Wegen {sache}, Seite {small}|Die {sache} {sache} kam.|Über die {sache} {did2}|{sache}\n{sache}|Nach {sache} {sache}|Am {small}. {monat} {year} kam der {sache}.|Zum {sache} {small}"""
PLAIN_ES = """El {cosa} llegó en marzo de {year}.|La Compañía {town} cerró en {year}.|Entre {town} y {geo} no hay {cosa}.|Página {small}, artículo {small}|El Banco De {town}|La Ciudad de {town} y el Castillo de {town}|Alcalde de {town}|El Puerto de {town}|El {cosa} cuesta {money}.|La plaza está cerrada desde {year}."""
SLOT = re.compile(r"\{(\w+)\}")


def _split(block: str) -> list[str]:
    return [t.replace("\\n", "\n") for line in block.split("\n") for t in line.split("|") if t]


class Maker:
    def __init__(self, lex: Names, rng: random.Random):
        self.r = rng
        self.given, self.family = sorted(lex.given), sorted(lex.family)
        self.common_given, self.common_family = sorted(GIVEN), sorted(FAMILY)
        self.ends = sorted(e for e, n in lex.ends.items() if n >= 3 and len(e) > 2) or ["son"]
        self.starts = sorted(e for e, n in lex.starts.items() if n >= 2) or ["hart"]
        blocks = ((EN, PLAIN_EN, "en", 0.46), (FR, PLAIN_FR, "fr", 0.16), (DE, PLAIN_DE, "de", 0.22), (ES, PLAIN_ES, "es", 0.16))
        self.blocks = [(_split(a), _split(b), lang) for a, b, lang, _ in blocks]
        self.weights = [w for *_, w in blocks]

    def one(self, *x):
        return self.r.choice(x)

    def d(self, n: int) -> str:
        return f"{self.r.randrange(10**n):0{n}d}"

    def made(self) -> str:
        return (self.r.choice(FRONT) + "".join(self.r.choice(MIDDLE) + self.r.choice("aeiou") for _ in range(self.r.randint(0, 1))) + self.r.choice(MIDDLE) + self.r.choice(BACK)).title()

    def a_given(self) -> str:
        x = self.r.random()
        if x < 0.4:
            return self.r.choice(self.given).title()
        if x < 0.55:
            return self.r.choice(self.common_given).title()
        return self.made() if x < 0.93 else f"{self.made()}-{self.made()}"

    def a_family(self) -> str:
        x = self.r.random()
        if x < 0.35:
            return self.r.choice(self.family).title()
        if x < 0.5:
            return self.r.choice(self.common_family).title()
        if x < 0.7:
            return (self.r.choice(self.starts) + self.one("a", "e", "i", "o", "u", "ett", "ow", "") + self.r.choice(self.ends)).title()
        return self.one("", "", "", "", "Mc", "O'") + self.made()

    def name(self, lang: str) -> str:
        f = self.a_family()
        if self.r.random() < 0.12:
            f += "-" + self.a_family()
        particle = {"en": ("van", "de", "von der"), "fr": ("de", "de la", "du", "le"), "de": ("von", "von", "von der", "von dem"), "es": ("de", "de la", "del")}[lang]
        part = f"{self.r.choice(particle)} {f}" if self.r.random() < 0.14 else f
        i = self.r.choice(CAPS) + "."
        x = self.r.random()
        if x < 0.5:
            out = f"{self.a_given()} {part}"
        elif x < 0.62:
            out = f"{self.a_given()} {i} {part}"
        elif x < 0.68:
            out = f"{self.a_given()} {self.a_given()} {f}"
        elif x < 0.74:
            out = f"{i} {self.r.choice(CAPS)}. {f}"
        elif x < 0.79:
            out = f"{i} {f}"
        elif x < 0.81 and lang == "es":
            out = f"{self.a_given()} {self.one('del', 'de')} {self.made()} {f}"
        elif x < 0.84 and lang == "es":
            out = f"{self.a_given()} {f} {self.a_family()}"
        elif x < 0.95:
            out = f"{part}, {self.a_given()}"
        else:
            out = f"{f}, {self.a_given()} {i}" if self.r.random() < 0.6 else f"{f}, {i} {self.r.choice(CAPS)}."
        return out.upper() if self.r.random() < 0.1 else out

    def town(self) -> str:
        return (self.r.choice(FRONT) + self.r.choice(MIDDLE) + self.one("a", "e", "o", "") + self.r.choice(TOWN)).title()

    def phone(self, lang: str) -> str:
        d, r = self.d, self.r.randint
        if lang == "fr":
            a, p = str(r(1, 9)), [d(2) for _ in range(4)]
            j = self.one(" ", " ", ".", "-", "")
            return self.one(f"0{a}{j}{j.join(p)}", f"+33 {a}{j}{j.join(p)}", f"0033 {a} {' '.join(p)}", f"+33{a}{''.join(p)}", f"+33 (0){a} {' '.join(p)}", f"0033 {d(3)} {d(2)} {d(4)}")
        if lang == "de":
            a = self.one("30", "40", "89", "221", "711", "3641", "151", "170")
            return self.one(f"+49 {a} {d(5)}-{d(3)}", f"0{a} {d(r(5, 8))}", f"(0{a}) {d(4)} {d(3)}", f"(0{a}) {d(5)}/{d(3)}", f"0{a}/{d(6)}", f"+49 ({a}) {d(6)}", f"0049 {a} {d(7)}", f"0{a} {d(4)} {d(3)}", f"0{a}-{d(7)}", f"+49{a}{d(7)}")
        if lang == "es":
            a = self.one("6", "9", "7")
            return self.one(f"{a}{d(2)} {d(3)} {d(3)}", f"+34 {a}{d(2)} {d(3)} {d(3)}", f"{a}{d(2)} {d(2)} {d(2)} {d(2)}", f"0034 {a}{d(8)}", f"+34{a}{d(8)}", f"({a}{d(2)}) {d(3)} {d(3)}")
        a, b, c = str(r(2, 9)) + d(2), str(r(2, 9)) + d(2), d(4)
        j = self.one("-", "-", " ", ".")
        return self.one(f"({a}) {b}-{c}", f"{a}{j}{b}{j}{c}", f"+1 {a}{j}{b}{j}{c}", f"1-{a}-{b}-{c}", f"+1{a}{b}{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}", f"020 {d(4)} {d(4)}", f"(020) {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"0{r(11, 19)}{d(2)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"0044 20 {d(8)}")

    def paper(self, lang: str) -> str:
        d, cap = self.d, lambda n=1: "".join(self.r.choice(CAPS) for _ in range(n))
        if lang == "fr":
            return self.one(f"{self.one('1', '2')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{self.one('1', '2')}{d(14)}", f"{d(2)}{cap(2)}{d(5)}", f"{d(12)}", f"{d(2)} {d(2)} {d(3)} {d(3)} {d(3)}")
        if lang == "de":
            return self.one(f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(11)}", f"{cap()}{d(2)}{cap()}{d(2)}{cap()}{d(2)}", f"{cap()}{d(8)}", f"{d(2)} {d(6)} {cap()} {d(3)}", f"{d(3)}/{d(3)}/{d(5)}", f"{cap()}{d(7)}{cap()}")
        if lang == "es":
            return self.one(f"{d(8)}{cap()}", f"{d(8)}-{cap()}", f"{self.one('X', 'Y', 'Z')}{d(7)}{cap()}", f"{self.one('X', 'Y', 'Z')}-{d(7)}-{cap()}", f"{cap(3)}{d(6)}", f"{d(4)} {d(4)} {cap()}", f"{d(2)}.{d(3)}.{d(3)}-{cap()}")
        return self.one(f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(9)}", f"{cap(2)} {d(2)} {d(2)} {d(2)} {cap()}", f"{cap(2)}{d(6)}{cap()}", f"{cap()}{d(8)}", f"{cap(2)}{d(7)}", f"{d(2)}-{d(7)}", f"{cap()}{d(3)}-{d(4)}-{d(4)}")

    def address(self, lang: str) -> str:
        p, n = self.town() if self.r.random() < 0.6 else self.made(), str(self.one(self.r.randint(1, 99), self.r.randint(1, 999)))
        if self.r.random() < 0.2:
            p += " " + self.made()
        # of an abbreviation the dot is part of it
        kind = self.r.choice([w for w in STREETS[lang] if w + "." not in STREETS[lang]])
        if lang == "fr":
            n += self.one("", "", "", " bis", " ter")
            of = self.one("de ", "du ", "de la ", "d'", "", "des ")
            return f"{n}{self.one('', ',')} {kind} {of}{p}" if self.r.random() < 0.9 else f"{kind} {of}{p} {n}"
        if lang == "de":
            n += self.one("", "", "", "a", " b")
            return self.one(f"{p.split()[0]}{kind} {n}", f"{p.split()[0]}{kind} {n}", f"{p}er {kind.title()} {n}", f"{p.split()[0]}-{kind.title()} {n}", f"{self.one('Am', 'An der', 'Im', 'Zum', 'Auf dem', 'Unter den')} {p} {n}")
        if lang == "es":
            return f"{kind}{self.one(' ', ' ', '') if kind == 'C/' else ' '}{self.one('', '', 'de ', 'de la ', 'del ', 'de los ')}{p}{self.one(',', ',', '')} {self.one('', '', 'nº ')}{n}"
        n += self.one("", "", "", "", "A", "B")
        front = self.one("", "", "", "Old ", "North ", "Upper ", "East ", "Great ")
        out = f"{n}{self.one('', '', '', ',')} {front}{p} {kind}" if self.r.random() < 0.94 else f"{p} {self.one('Street', 'Road', 'Lane')} {n}"
        return out.upper() if self.r.random() < 0.1 else out

    def email(self) -> str:
        clean = lambda w: re.sub(r"[^a-z]", "", w.lower()) or "ann"
        g, f = clean(self.a_given()), clean(self.a_family())
        local = self.one(f"{g}.{f}", f"{g[0]}{f}", f"{g[0]}.{f}", f"{g}_{f}", f"{g}{self.d(2)}", f"{f}{self.d(4)}", f"{g}", f"{f}+{self.r.choice(THING)}", f"{f}-{g}", f"{g[0]}_{f}{self.d(2)}", f"info.{f}")
        host = self.r.choice(HOSTS) if self.r.random() < 0.6 else f"{clean(self.made())}{self.one('', '', '-' + clean(self.made()))}.{self.one('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'example', 'edu')}"
        x = self.r.random()
        if x < 0.68:
            return f"{local}@{host}"
        if x < 0.75:
            return f"{local}@{host}".upper()
        if x < 0.83:
            return f"{local} {self.one('(at)', '[at]')} {host}"
        if x < 0.88:
            return f"{local}{self.one('(at)', '[at]')}{host}"
        if x < 0.94:
            return f"{local} at {host.replace('.', ' dot ')}"
        dot = self.one(" [dot] ", " (dot) ")
        return f"{local.replace('.', dot)} {self.one('[at]', '(at)')} {host.replace('.', dot)}"

    def org(self) -> str:
        x, b = self.r.random(), self.r.choice(BODY)
        if x < 0.3:
            return f"{self.a_given()} {b}"
        if x < 0.5:
            return f"{self.a_family()} {b}"
        if x < 0.6:
            return f"{self.a_given()} {self.a_family()} {b}"
        if x < 0.8:
            return f"{self.town()} {self.one('', '', 'General ', 'National ', 'Road ', 'Street ', 'River ')}{b}"
        if x < 0.9:
            return f"{self.geo()} {b}"
        return f"{b.split()[-1]} of {self.town()}"

    def geo(self) -> str:
        return self.one(f"{self.r.choice(GEO)} {self.town()}", f"{self.town()} {self.r.choice(GEO_BACK)}", f"{self.r.choice(GEO)} {self.made()}", f"{self.r.choice(GEO)} {self.a_family()}")

    def fill(self, slot: str, lang: str) -> tuple[str, str]:
        r, d = self.r, self.d
        if slot in "NPIAE":
            # a country's numbers also stand in the texts of another language
            of = lang if r.random() < 0.85 else r.choice(("en", "fr", "de", "es"))
            return {"N": (lambda: self.name(of), "name"), "P": (lambda: self.phone(of), "phone"), "I": (lambda: self.paper(of), "id_number"), "A": (lambda: self.address(of), "address"), "E": (self.email, "email")}[slot][0](), {"N": "name", "P": "phone", "I": "id_number", "A": "address", "E": "email"}[slot]
        year, small = str(r.randint(1600, 2025)), str(r.randint(1, 999))
        made = {
            "T": lambda: self.one("", "Mr ", "Mr. ", "Mrs. ", "Ms ", "Dr. ", "Miss ", "Sir ", "Prof. ", "Captain "),
            "date": lambda: self.one(f"{r.randint(1, 28)} {r.choice(MONTH)} {year}", f"{r.choice(MONTH)} {r.randint(1, 28)}, {year}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{year}", f"{d(2)}.{d(2)}.{year}", f"the first of {r.choice(MONTH)}, {year}"),
            "iso": lambda: f"{year}-{r.randint(10, 12)}-{r.randint(10, 28)}{self.one('', 'T10:22:31', ' 10:22')}",
            "money": lambda: self.one(f"{small} dollars", f"${small},{d(3)}.{d(2)}", f"{d(1)}.{d(3)}.{d(3)} Euro", f"£{small}", f"{small} {d(3)} francs", f"{d(3)},{d(3)},{d(3)} pounds"),
            "ref": lambda: self.one(f"{small}-{year}", f"{year}-{d(5)}", f"{d(6)}", f"{d(4)}/{d(2)}", f"{small}.{d(3)}.{d(3)}", f"{r.choice(CAPS)}{r.choice(CAPS)}-{d(6)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(3)}-{d(3)}"),
            "range": lambda: f"{small}-{r.randint(1, 999)}", "version": lambda: f"{r.randint(1, 12)}.{r.randint(0, 40)}.{r.randint(0, 300)}.{d(4)}", "isbn": lambda: self.one(f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"978{d(10)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}"),
            "serial": lambda: self.one(f"{d(4)} {d(4)} {d(4)}", d(16), d(19), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(8)}-{d(8)}", f"{r.choice(CAPS)}{d(4)}-{d(5)}", d(7)), "grouped": lambda: f"{small},{d(3)},{d(3)}", "dotted": lambda: f"{d(1)}.{d(3)}.{d(3)}",
            "big": lambda: f"{small} {d(3)} {d(3)}", "card": lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", "ip": lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), "small": lambda: small, "year": lambda: year, "month": lambda: r.choice(MONTH), "monat": lambda: r.choice(MONATE), "town": self.town, "geo": self.geo, "org": self.org, "body": lambda: r.choice(BODY), "geoback": lambda: r.choice(GEO_BACK),
            "given": self.a_given, "family": self.a_family, "thing": lambda: r.choice(THING), "did": lambda: r.choice(DID), "adj": lambda: self.one("alte", "neue", "große", "letzte", "grüne", "halbe", "fremden", "hohen", "kleiner", "ganzes"), "das": lambda: self.one("der", "die", "das", "dem", "den", "des", "ein", "eine", "kein"), "Das": lambda: self.one("Der", "Die", "Das", "Dem", "Den", "Ein", "Im"), "dup": lambda: " ".join([self.one(self.town(), r.choice(SACHE), r.choice(BODY))] * 2), "did2": lambda: self.one("ist nichts bekannt", "wird beraten"), "thing2": lambda: r.choice(THING).title(), "sache": lambda: r.choice(SACHE), "chose": lambda: r.choice(CHOSE), "cosa": lambda: r.choice(COSA),
        }
        return made[slot](), ""

    def sentence(self) -> list[tuple[str, str]]:
        personal, plain, lang = self.r.choices(self.blocks, self.weights)[0]
        template = self.r.choice(personal if self.r.random() < 0.66 else plain)
        out = [(x, "") if n % 2 == 0 else self.fill(x, lang) for n, x in enumerate(SLOT.split(template))]
        if self.r.random() < 0.05:  # headings and shouted text
            out = [(x.upper(), kind) for x, kind in out]
        return out + ([(self.one(".", "", "", ";"), "")] if template[-1] in "}" else [])

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        parts: list[tuple[str, str]] = []
        for i in range(self.r.randint(1, 4)):
            if i:
                parts.append((self.one(" ", " ", " ", "\n", "\r\n", "\n\n"), ""))
            parts += self.sentence()
        wrap = self.r.random() < 0.15
        out, truth, n = [], [], 0
        for s, kind in parts:
            if wrap and " " in s and self.r.random() < 0.3:
                k = self.r.choice([i for i, c in enumerate(s) if c == " "])
                s = s[:k] + self.one("\n", "\r\n") + s[k + 1 :]
            if kind:
                truth.append((n, n + len(s), kind))
            out.append(s)
            n += len(s)
        return "".join(out), truth


def sentences(lex: Names, n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts with the spans ``(start, end, kind)`` in them."""
    maker = Maker(lex, random.Random(seed))
    for _ in range(n):
        yield maker.text()
