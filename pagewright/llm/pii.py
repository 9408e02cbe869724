"""Problem 9: personal information in free text.

Regular expressions propose spans, anchored where an automaton of cue words and units of
addresses strikes, or where capitalised words stand side by side. Every span has a score:
its shape counts, a checksum confirms or weakens it, and the words around it, labels, titles,
given names and other items nearby raise or lower it. What reaches the threshold is reported
and can be replaced by a typed placeholder.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.quality import lexicon_words

KINDS = ["email", "id_number", "address", "phone", "name"]  # of spans that overlap, the earlier kind stays
THRESHOLD = 2.0

# --- e-mail --------------------------------------------------------------------------------------

_AT = r"(?:@|\s?[\[({]\s?(?:at|ät|arobase|собака)\s?[\])}]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|точка)\s?[\])}]\s?|\s+dot\s+)"
_EMAIL = re.compile(rf"[^\W_][\w.+-]*{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+(?<![-_])", re.IGNORECASE)
_EMAIL_HINT = re.compile(r"@|[\[({]\s?(?:at|ät|arobase|собака)\s?[\])}]|\s(?:at)\s+\S+\s+dot\s", re.IGNORECASE)


def emails(text: str) -> Iterator[tuple[int, int, float]]:
    """The local part is followed back from each sign as far as it reaches."""
    for hint in _EMAIL_HINT.finditer(text):
        begin = hint.start()
        while begin and text[begin - 1].isspace():
            begin -= 1
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
            begin -= 1
        while begin < hint.start() and not text[begin].isalnum():
            begin += 1
        m = _EMAIL.match(text, begin)
        if m and m.start() < hint.start() < m.end():
            last = re.split(_DOT, m.group(), flags=re.IGNORECASE)[-1]
            spaced = re.search(r"\sat\s", m.group(), re.IGNORECASE) and not re.search(r"\sdot\s|[\[({]", m.group(), re.IGNORECASE)
            if re.fullmatch(r"[^\W\d_]{2,24}", last) and not spaced:
                yield m.start(), m.end(), 3.0


# --- checksums -----------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """The sum of digits, every second from the right doubled, is a multiple of ten."""
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97_key(number: str) -> bool:
    """Thirteen digits and two more that are 97 minus the rest of the first by 97; the departments 2A and 2B count as 19 and 18."""
    digits = number.replace("2A", "19", 1).replace("2B", "18", 1) if number[5:7] in ("2A", "2B") else number
    return len(digits) == 15 and digits.isascii() and digits.isdigit() and 97 - int(digits[:13]) % 97 == int(digits[13:])


def pension_key(number: str) -> bool:
    """Eight digits, a letter as two digits by its place, and two more digits, weighted; the last digit is the sum of the digits of the products modulo 10."""
    if not re.fullmatch(r"\d{8}[A-Z]\d{3}", number):
        return False
    digits = number[:8] + f"{ord(number[8]) - 64:02d}" + number[9:]
    return sum(sum(divmod(int(d) * w, 10)) for d, w in zip(digits, (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1))) % 10 == int(digits[12])


def taxpayer_key(digits: str) -> bool:
    """Twelve digits, the last two being weighted sums of those before, modulo 11 and 10."""
    if len(digits) != 12:
        return False
    first, second = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    return all(sum(int(d) * w for d, w in zip(digits, ws)) % 11 % 10 == int(digits[len(ws)]) for ws in (first, second))


def weighted_key(digits: str) -> bool:
    """Nine digits weighted 9 to 1, modulo 101 and 100, give the last two of eleven."""
    return len(digits) == 11 and sum(int(d) * (9 - i) for i, d in enumerate(digits[:9])) % 101 % 100 == int(digits[9:])


def iso7064_key(digits: str) -> bool:
    """Eleven digits with a check digit by the product method modulo 11 and 10."""
    if len(digits) != 11:
        return False
    product = 10
    for d in digits[:10]:
        product = (int(d) + product) % 10 or 10
        product = product * 2 % 11
    return (11 - product) % 10 == int(digits[10])


# --- identity numbers ----------------------------------------------------------------------------

#: Labels of personal numbers, lower-cased.
ID_LABELS = [
    "passport", "ssn", "social security", "ni number", "ni no", "national insurance", "taxpayer id", "tax id", "identity card", "id card", "driving licence", "driver's license",
    "ausweis", "steuer-id", "steueridentifikationsnummer", "sozialversicherungsnummer", "rentenversicherungsnummer", "reisepass", "passnummer", "versichertennummer",
    "passeport", "nir", "sécurité sociale", "carte d'identité", "cni", "numéro fiscal", "паспорт", "снилс", "инн", "удостоверени", "загранпаспорт",
]
_AFTER_LABEL = re.compile(r"[\w-]{0,8}(?:\s+(?:nummer|numbers?|no|nr|number|серии|серия|номер|n|card))*\s*(?:[.°№#])?\s*[:№#]?\s*(?:no\.?|nr\.?|n°|№|number|is|lautet|est)?\s*:?\s*", re.IGNORECASE)
#: Shapes of numbers, with the key of the register that has that shape.
_ID_FORMS = [(re.compile(p), key) for p, key in (
    (r"[12]\s?\d\d\s?(?:0[1-9]|1[0-2]|[2-9]\d)\s?(?:\d\d|2[AB])\s?\d{3}\s?\d{3}\s?\d\d\b", mod97_key),
    (r"\d{2}\s?\d{6}\s?[A-Z]\s?\d{3}\b", pension_key),
    (r"\d{3}-\d{3}-\d{3}[ -]\d{2}\b", weighted_key),
    (r"\d{2}\s?\d{2}\s*(?:№|N|n)?\s*\d{6}\b", None),
    (r"\d{3}[- ]\d{2}[- ]\d{4}\b", None),
    (r"\d{2}\s\d{3}\s\d{3}\s\d{3}\b", iso7064_key),
    (r"[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b", None),
    (r"\d{2}[A-Z]{2}\d{5}\b", None),
    (r"[A-Z]{1,3}\d{6,9}[A-Z]?\b", None),
    (r"[A-Z][0-9A-Z]{8,9}\b(?<=\d)", None),
    (r"\d{12}\b", taxpayer_key),
    (r"\d{11}\b", lambda n: iso7064_key(n) or weighted_key(n)),
    (r"\d{9,10}\b", None),
)]
#: Weights: a label with a number of a known shape; a key that holds or fails; Luhn's sum where a shape has no key of its own; a person or a thing before the number.
LABELLED, KEY_HOLDS, KEY_FAILS, LUHN_HOLDS, PERSON_NEAR, THING_BEFORE, BARE = 2.0, 1.0, -0.4, 0.1, 0.5, -2.0, 1.0
#: Shapes that count without a label; the key decides.
_BARE_ID = re.compile(r"(?<![\w.,-])(?:[12]\s?\d\d\s?(?:0[1-9]|1[0-2])\s?(?:\d\d|2[AB])\s?\d{3}\s?\d{3}\s?\d\d|\d{3}-\d{3}-\d{3} \d{2}|\d{2}\s\d{6}\s[A-Z]\s\d{3})(?![\w,.-]*\d)")


def checked(value: str, key: Callable[[str], bool] | None) -> float:
    """What a checksum adds: the key of the number's register where it has one, else weak support by Luhn's sum."""
    number = re.sub(r"[^0-9A-Z]", "", value)
    if key is not None:
        return KEY_HOLDS if key(number) else KEY_FAILS
    return LUHN_HOLDS if number.isdigit() and len(number) >= 9 and luhn(number) else 0.0


def labelled_id(text: str, end: int) -> tuple[int, int, float] | None:
    """The number after a label that ends at ``end``: of the readings from each word the best, of equal ones the first."""
    gap = _AFTER_LABEL.match(text, end)
    # The gap may have eaten letters that belong to the number: try from every word in it.
    at = {gap.end()} | {end + m.start() for m in re.finditer(r"(?<!\w)\w", text[end : gap.end()])}
    for begin in sorted(at):
        for form, key in _ID_FORMS:
            m = form.match(text, begin)
            if m and not text[begin - 1 : begin].isalnum():
                return begin, m.end(), LABELLED + checked(m.group(), key)
    return None


def bare_ids(text: str) -> Iterator[tuple[int, int, float]]:
    """Numbers without a label: their key must hold, and no thing may be named before them."""
    for m in _BARE_ID.finditer(text):
        key = next(k for form, k in _ID_FORMS if form.match(m.group()))
        thing = _THING_LABEL.search(_before(text, m.start()))
        yield m.start(), m.end(), BARE + checked(m.group(), key) + (THING_BEFORE if thing else 0.0)


def _before(text: str, at: int, most: int = 48) -> str:
    """The last characters before a place, each run of blanks as one: longer than any label that is looked for."""
    begin, out = at, ""
    while begin and len(out) < most:
        begin = max(0, begin - most)
        out = re.sub(r"\s+", " ", text[begin:at])
    return out[-most:]


# --- phone numbers -------------------------------------------------------------------------------

_PHONE = re.compile(r"(?<![\w.,:/@€$-])(?:\+\d|00\d|\(?\d)[\d  ()./-]{5,24}\d(?![\w]|[.,-]\d|/\d|@)")
_PHONE_STRONG = re.compile(
    r"(?:\+|00)\d{1,3}[ .-]?\(?\d.*"
    r"|(?:1[-. ]?)?\(\d{3}\)[ -]?\d{3}[-. ]\d{4}|(?:1[-. ])?\d{3}([-. ])\d{3}\1\d{4}"
    r"|8[ -]\(?\d{3}\)?[ -]\d{3}[ -]\d{2}[ -]\d{2}|0\d{2} \d{4} \d{4}|\(0\d{2,5}\)[ /-]?\d{3,9}(?:[ -]\d{1,6})*|0\d{2,4}[/ -]\d{3,8}[ -]?\d{1,6}"
    r"|0\d(?:[ .]\d{2}){4}"
)
_PHONE_WEAK = re.compile(r"0\d{9}|1?\d{10}|8\d{10}|0\d{2,4}[ /-]\d{5,9}|[78]\d{10}")
_PHONE_LABEL = re.compile(r"(?:phone|mobile|cell|fax|call|calls|dial|ring|tel|tél|telefon|téléphone|handy|rufnummer|тел|телефон|моб|звоните|reached (?:on|at)|erreichbar unter|unter|répond au|au|or|ou|oder|или|mobil)\b\.?\s*(?:no\.?|number|nr\.?|n°)?\s*:?\s*$", re.IGNORECASE)
_THING_LABEL = re.compile(r"(?:serial|code|lot|run|sample|isbn|issn|contract|grant|panel|needs?|range|version|firmware|node|order|invoice|part|model|batch|no\.|№|timestamp|room|section|ref|doi|iban|account|card)\b[\s:.#]*(?:no\.?|number|nr\.?)?[\s:.#]*$", re.IGNORECASE)


def phones(text: str) -> Iterator[tuple[int, int, float]]:
    for m in _PHONE.finditer(text):
        value = m.group().rstrip(" (.-/")
        begin, end = m.start(), m.start() + len(value)
        digits = re.sub(r"\D", "", value)
        if not 9 <= len(digits) <= 15 or value.count("(") != value.count(")"):
            continue
        before = _before(text, begin)
        if re.search(r"\d{4}-\d\d-\d\d", value) or re.fullmatch(r"(\d)\1+", digits):
            continue
        score = 2.0 if _PHONE_STRONG.fullmatch(value) else 1.0 if _PHONE_WEAK.fullmatch(value) else 0.0
        if _PHONE_LABEL.search(before) or re.search(r"\|\s*$", before):
            score += 1.0
        if _THING_LABEL.search(before):
            score -= 2.0
        if re.match(r"\s?(?:ext\b|\(ext|poste|доб|durchwahl)", text[end : end + 12], re.IGNORECASE):
            score += 0.5
        if score and score >= THRESHOLD:
            yield begin, end, score


# --- addresses -----------------------------------------------------------------------------------

_UP = "A-ZÀ-ÖØ-ÞА-ЯЁŒ"
_PLACE = rf"[{_UP}][\w'’]+(?:-[\w'’]+)*"
_TOWN = rf"{_PLACE}(?:[ ]{_PLACE}){{0,2}}"
_G = r",\s{1,12}"
#: What streets are called; anchors and patterns are made of the same lists.
WAYS = {
    "en": ["Street", "St", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Drive", "Dr", "Court", "Ct", "Boulevard", "Blvd", "Square", "Sq", "Way", "Close", "Terrace", "Row", "Crescent", "Gardens", "Parkway", "Pkwy", "Mews", "Walk"],
    "de": ["straße", "strasse", "str.", "gasse", "allee", "weg", "platz", "ring", "damm", "ufer", "graben", "stieg", "markt", "hof", "berg"],
    "fr": ["rue", "avenue", "av.", "impasse", "boulevard", "bd", "place", "pl.", "allée", "chemin", "quai", "cours", "route", "square", "passage"],
    "ru": ["ул", "улица", "пр", "просп", "проспект", "пер", "переулок", "наб", "бул", "пл", "ш"],
}
#: Words before the name of a street that an address can have, and of which it begins at the first.
WORDS_BEFORE = 8
_EN_WAY = "(?:" + "|".join(rf"{w}\.?" for w in sorted(WAYS["en"], key=len, reverse=True)) + ")"
_DE_WAY = "(?:" + "|".join(f"[{w[0].upper()}{w[0]}]{re.escape(w[1:])}" for w in WAYS["de"]) + ")"
_FR_WAY = "(?:" + "|".join(re.escape(w) + ("" if w.endswith(".") else r"\.?" if w == "bd" else "") for w in sorted(WAYS["fr"], key=len, reverse=True)) + ")"
_RU_WAY = "(?:" + "|".join(sorted(WAYS["ru"], key=len, reverse=True)) + ")"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Suite|Unit)\s{1,8}\d{1,4}[A-Za-z]?"
_ADDRESSES = {
    "en": re.compile(rf"(?<![\w-])(?:{_FLAT}{_G})?\d{{1,5}}[A-Za-z]?\s{{1,8}}(?:{_PLACE}\s{{1,8}}){{1,3}}{_EN_WAY}(?![\w])(?:{_G}{_FLAT})?(?:{_G}{_TOWN}(?:{_G}[A-Z]{{2}})?(?:\s{{1,8}}(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[\dA-Z]?\s?\d[A-Z]{{2}}))?)?"),
    "de": re.compile(rf"(?<![\w-])(?:(?:An?|Am|Im|Zum|Zur|Auf|Unter|Hinter|In)\s{{1,4}}(?:de[rmn]\s{{1,4}})?|{_PLACE}(?:er|e)\s{{1,4}})?(?=[{_UP}])[\w-]*{_DE_WAY}\s{{1,4}}\d{{1,4}}\s?[a-z]?(?!\w)(?:{_G}(?:D-)?\d{{5}}\s{{1,4}}{_TOWN}|{_G}{_TOWN})?"),
    "fr": re.compile(rf"(?<![\w-])\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s{{1,8}}{_FR_WAY}\s{{1,4}}(?:[\w'’-]+\s{{1,4}}){{0,4}}?{_PLACE}(?:\s{{1,4}}{_PLACE})?(?:{_G}(?:\d{{5}}\s{{1,4}})?{_PLACE}(?:\s{{1,4}}{_PLACE})?)?"),
    "ru": re.compile(rf"(?<![\w-])(?:\d{{6}}{_G})?(?:(?:г|гор|пос|с|д)\.\s{{0,4}}{_TOWN}{_G})?(?<!\w){_RU_WAY}\.?\s{{1,4}}{_PLACE}(?:\s{{1,4}}{_PLACE}){{0,2}}(?:{_G}(?:д(?:ом)?\.?\s{{0,4}})?\d{{1,4}}[а-я]?(?:/\d+)?(?!\w))?(?:{_G}(?:корп|стр)\.?\s{{0,4}}\d+)?(?:{_G}(?:кв|оф)\.?\s{{0,4}}\d{{1,5}})?(?:{_G}(?:г|гор|пос|с)\.\s{{0,4}}{_TOWN})?(?:{_G}\d{{6}}(?!\d))?"),
}
_WORD_START = re.compile(r"(?<!\S)\S")


def address_at(text: str, end: int, way: str, tongue: str) -> Iterator[tuple[int, int, float]]:
    """Addresses with the street word that ends at ``end``: read from each of the words before it that can belong to one."""
    begin = end - len(way)
    after, before = text[end : end + 1], text[begin - 1 : begin]
    if after.isalnum() or (tongue != "de" and before.isalnum()) or (tongue in ("fr", "ru") and before and not before.isspace() and before not in ",(.;:"):
        return
    at = begin
    for _ in range(WORDS_BEFORE + 1):
        while at and not text[at - 1].isspace():
            at -= 1
        # What is in front of a word, such as a bracket, is no part of an address.
        first = next((i for i in range(at, begin + 1) if text[i].isalnum()), begin)
        m = _ADDRESSES[tongue].match(text, first)
        if m and m.end() >= end and re.search(r"\d", m.group()):
            yield m.start(), m.end(), 2.5
        while at and text[at - 1].isspace():
            at -= 1
        if not at:
            break


# --- names ---------------------------------------------------------------------------------------

_N = rf"[{_UP}][\w'’]+(?:-[{_UP}][\w'’]+)*"
_INIT = rf"[{_UP}]\."
_SP = r"(?:[ \t\xa0]{1,4}|[ \t]*\n[ \t]*)"
_FORMS = [re.compile(p) for p in (
    rf"(?:{_INIT}{_SP}?){{1,2}}{_N}(?!\w)",
    rf"{_N}(?:{_SP}{_INIT})?{_SP}{_N}(?!\w)(?!\s?:)",
    rf"{_N},{_SP}(?:{_N}(?!\w)(?:{_SP}{_INIT})?|(?:{_INIT}{_SP}?){{1,2}})(?!\s?:)",
)]
_SURNAME = re.compile(rf"{_N}(?!\w)")
#: Roles, labels and words of correspondence that stand before a person's name, lower-cased.
NAME_CUES = [
    "colleague", "operator", "author", "authors", "reviewer", "contact", "name", "from", "to", "cc", "attn", "dear", "regards", "sincerely", "interview with", "prepared by", "written by", "reviewed by", "signed by", "approved by", "checked by", "engineer", "technician", "applicant", "patient", "participant",
    "kollege", "kollegin", "prüfer", "prüferin", "autor", "ansprechpartner", "erstellt von", "geprüft von", "bearbeitet von", "freundlichen grüßen", "bediener", "techniker", "gespräch mit", "von", "an",
    "opérateur", "opératrice", "auteur", "collègue", "nom", "rédigé par", "vérifié par", "établi par", "cordialement", "écrire à", "technicien", "entretien avec", "à", "par",
    "оператор", "автор", "коллега", "коллегой", "контакт", "фио", "подготовил", "подготовила", "проверил", "проверила", "составил", "составила", "с уважением", "инженер", "техник", "беседа с", "указан", "указана",
]
#: Words that begin sentences and headings, whether or not a lexicon has them.
STARTERS = ["please", "laut", "the", "this", "when", "while", "after", "where", "figure", "table", "section", "chapter", "national", "insurance", "number", "write", "call", "our", "my", "his", "her", "we", "it", "here", "gone", "late", "she", "re"]
#: Titles, which are not part of a name.
TITLES = ["Dr.", "Dr", "Prof.", "Professor", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Herr", "Herrn", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "г-н", "г-жа", "г-ну", "господин", "госпожа", "Инженер", "инженер", "доктор", "Доктор", "профессор", "Ing.", "Dipl.-Ing."]
#: What people do, and how else a sentence may go on after its subject; prepositions before a person.
NAME_ACTS = r"\s+(?:(?:calibrated|repaired|approved|signed|wrote|tested|checked|reported|reviewed|adjusted|installed|replaced|confirmed|thinks|said|says|asked|noted|meint|sagt|prüfte|schrieb|pense|dit|vérifie|считает|сказал\w*|принимает|возвращает|проверил\w*|утвердил\w*|отремонтировал\w*|откалибровал\w*|написал\w*|измерил\w*|заменил\w*|настроил\w*)\b|hat\s+(?:de[nmr]|die|das|eine?n?)\b|a\s+\w+[éit]\b|can be reached|is reached)"
NAME_VERBS = r"\s+(?:was|is|has|had|can|will|hat|ist|wird|kann|a|est|peut|может)\b"
NAME_PREPOSITIONS = r"(?:^|[\s(])(?:by|with|to|from|for|of|lists|names|von|mit|an|für|bei|par|avec|à|de|от|с|со|к|для|у)$"
#: Nouns of things that carry a person's name.
_THING = re.compile(r"(?:[ \t\n]+|-)(?:method|filter|equation|test|law|effect|process|number|model|transform|theorem|algorithm|scale|index|constant|instruments?|gmbh|ag|inc|ltd|llc|corp|company|university|institute|laborator\w+|street|road|lane|method\w*|verfahren|gleichung|filter\w*|метод\w*|уравнени\w+|фильтр\w*|and the \S+ equation)\b", re.IGNORECASE)
_THING_BEFORE = re.compile(r"(?:méthode|équation|filtre|loi|effet|théorème|метод\w*|уравнени\w+|фильтр\w*|закон\w*|supplied by|geliefert von|fourni par)(?: de| d')?$", re.IGNORECASE)
_CAPITAL = re.compile(rf"(?<![\w@.'’+-])[{_UP}](?:[\w'’]|\.)")
#: Weights of a name: a title, a cue or a role before it, a given name, an initial, a part that no lexicon knows, a preposition before or a verb after, an act of a person after, another item right after, a thing named after a person.
TITLE, CUE, GIVEN, INITIAL, UNKNOWN, AROUND, ACT, ITEM_NEAR, THING = 2.0, 1.25, 1.25, 1.0, 0.5, 0.5, 1.5, 1.5, -3.0
_AMOUNT = re.compile(r"[\d°%][ \xa0]?\Z")
_ACTS, _VERBS = re.compile(NAME_ACTS), re.compile(NAME_VERBS)
_M_TITLE = re.compile(rf"(?<![\w.])M\.\s({_N})(?=\s+(?:a|est|et|peut|pense|dit)\b)")


class Finder:
    """Finds items; holds the lexicon, the given names and the automata of anchors."""

    def __init__(self, lexicon: list[str], given: list[str]):
        self.words = frozenset(lexicon)
        self.given = frozenset(g.lower() for g in given)
        # Words of cues, titles, labels and streets are no part of a name.
        self.never = frozenset(w for x in (*NAME_CUES, *ID_LABELS, *(t.lower() for t in TITLES), *(w.lower() for w in WAYS["en"]), *STARTERS) for w in re.findall(r"[^\W\d_]{2,}", x)) - self.given
        self.ways = ahocorasick.Automaton()
        anchors: dict[str, list[tuple[str, str]]] = {}
        for tongue, ways in WAYS.items():
            for way in ways:
                for x in {way, way.capitalize()} if tongue == "de" else {way}:
                    anchors.setdefault(x, []).append((tongue, x))
        for x, hits in anchors.items():
            self.ways.add_word(x, hits)
        self.ways.make_automaton()
        self.labels = ahocorasick.Automaton()  # over lower-cased text
        for x in ID_LABELS:
            self.labels.add_word(x, x)
        self.labels.make_automaton()

    def _parts(self, name: str) -> list[str]:
        return [p.lower() for p in re.findall(r"[^\W\d_]{2,}", name)]

    def _plausible(self, name: str) -> bool:
        """No part is an ordinary word, and one is not just a given name."""
        parts = self._parts(name)
        return bool(parts) and not any((p in self.words and p not in self.given) or p in self.never for p in parts) and not re.search(r"\d", name)

    def _readings(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """Spans from ``at`` that have the form of a name of several parts."""
        for form in _FORMS:
            if (m := form.match(text, at)) and self._plausible(m.group()) and not _M_TITLE.match(text, at):
                yield at, m.end()

    def _score(self, text: str, begin: int, end: int, items: list[tuple[int, int, str]], german: bool) -> float:
        """Adds up what speaks for a person between ``begin`` and ``end``."""
        name, before = text[begin:end], _before(text, begin)
        parts = self._parts(name)
        score = UNKNOWN * min(2, sum(p not in self.given and p not in self.words for p in parts))
        score += GIVEN * any(p in self.given for p in parts) + INITIAL * bool(re.search(rf"(?<!\w){_INIT}", name))
        if german and score <= 2 * UNKNOWN and not name.isupper():
            score = UNKNOWN  # nouns have capitals there
        if _TITLE_BEFORE.search(before):
            score += TITLE
        elif _CUE_BEFORE.search(before):
            score += CUE
        elif re.search(NAME_PREPOSITIONS, before.rstrip()):
            score += AROUND
        if _ACTS.match(text, end):
            score += ACT
        elif _VERBS.match(text, end):
            score += AROUND
        if any(e <= b2 and _ITEM_GAP.fullmatch(text, e, b2) for b2, _, _ in items for e in (end,) if 0 <= b2 - e <= 80):
            score += ITEM_NEAR
        if _THING.match(text, end) or _THING_BEFORE.search(before.rstrip()):
            score += THING
        if "\n" in name:
            score -= AROUND
        return score + (end - begin) / 1000  # of readings of one place the longer is better

    def names(self, text: str, items: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, float]]:
        german = len(_GERMAN.findall(text)) > len(_NOT_GERMAN.findall(text))
        for c in _CAPITAL.finditer(text):
            before = _before(text, c.start(), 16)
            if text[c.start() + 1] == "." and _AMOUNT.search(text, max(0, c.start() - 3), c.start()):
                continue  # a unit
            spans = list(self._readings(text, c.start()))
            titled = bool(_TITLE_BEFORE.search(before))
            if titled and not spans and (m := _SURNAME.match(text, c.start())) and self._plausible(m.group()) and text[c.start() : m.end()] not in TITLES:
                spans = [(c.start(), m.end())]
            for begin, end in spans:
                yield begin, end, self._score(text, begin, end, items, german)
        for m in _M_TITLE.finditer(text) if "M. " in text else ():
            if self._plausible(m.group(1)):
                yield *m.span(1), 2.5 + (THING if _THING.match(text, m.end(1)) else 0.0) + 1.0

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, kind) of items, in order and without overlaps."""
        found = [(b, e, "email", s) for b, e, s in emails(text)]
        if any(c.isdigit() for c in text):
            lower = text.lower()
            if len(lower) != len(text):
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for end, x in self.labels.iter(lower):
                end += 1
                if (end == len(x) or not text[end - len(x) - 1].isalnum()) and (hit := labelled_id(text, end)):
                    near = PERSON_NEAR if self._person_before(text, end - len(x)) else 0.0
                    found.append((hit[0], hit[1], "id_number", hit[2] + near))
            for end, hits in self.ways.iter(text):
                for tongue, way in hits:
                    found += [(b, e, "address", s) for b, e, s in address_at(text, end + 1, way, tongue)]
            found += [(b, e, "id_number", s) for b, e, s in bare_ids(text)]
            found += [(b, e, "phone", s) for b, e, s in phones(text)]
        kept = self._without_overlaps([x for x in found if x[3] >= THRESHOLD])
        named = [(b, e, "name", s) for b, e, s in self.names(text, [(b, e, k) for b, e, k, _ in kept])]
        kept = self._without_overlaps(kept + [x for x in named if x[3] >= THRESHOLD])
        return [(b, e, k) for b, e, k, _ in sorted(kept)]

    def _person_before(self, text: str, at: int) -> bool:
        """A capitalised word that no lexicon knows, or an initial, stands shortly before."""
        return any(self._plausible(m.group()) for m in _SURNAME.finditer(_before(text, at)))

    @staticmethod
    def _without_overlaps(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        kept: list[tuple[int, int, str, float]] = []
        for x in sorted(set(found), key=lambda x: (KINDS.index(x[2]), -x[3] if x[2] == "name" else 0, x[0] - x[1], -x[3])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        return kept


_TITLE_BEFORE = re.compile(r"(?<![\w.])(?:" + "|".join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True)) + r")\s$")
_CUE_BEFORE = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(t) for t in sorted(NAME_CUES, key=len, reverse=True)) + r")\s?[:,]?\s$", re.IGNORECASE)
#: Between a name and an item that belongs to it: a bracket or comma, or a few words within the sentence.
_ITEM_GAP = re.compile(r"\s*[<(|,]?\s*|[\s,]+(?:[\w°№'’:-]+\.?[\s:]+){1,6}")
#: Words that tell German from the other languages.
_GERMAN, _NOT_GERMAN = re.compile(r"(?<!\w)(?:der|die|das|und|ist|wird|nicht|mit|von|bei)(?!\w)"), re.compile(r"(?<!\w)(?:the|and|is|of|with|la|le|les|et|est|и|в|на|не|что)(?!\w)")


@lru_cache(maxsize=2)
def _finder(words: tuple[str, ...], given: tuple[str, ...]) -> Finder:
    return Finder(list(words), list(given))


# --- operators -----------------------------------------------------------------------------------


def _given_names(names: DataFrame, most: int = 100_000) -> list[str]:
    rows = names.where("given_name is not null").select("given_name").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} given names")
    return sorted(r.given_name for r in rows)


def personal_items(documents: DataFrame, lexicon: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, kind, value), distinct: every item as it stands, each whitespace run as one space.

    NULL, empty and blank texts have none; texts are searched whole, in one pass without a
    shuffle but for the final distinct. Lexicon and given names are bounded tables.
    """
    words, given = tuple(lexicon_words(lexicon)[0]), tuple(_given_names(given_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(words, given)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += {(doc, kind, " ".join(text[b:e].split())) for b, e, kind in finder.find(text)}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.string()))], ["doc_id", "kind", "value"])

    return documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, kind string, value string").distinct()


def redacted(documents: DataFrame, lexicon: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, text, n_items): texts with ``[EMAIL]`` and the like in place of items; NULL and empty texts stay as they are."""
    words, given = tuple(lexicon_words(lexicon)[0]), tuple(_given_names(given_names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(words, given)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(1).to_pylist():
                items = finder.find(text) if text else []
                out, at = [], 0
                for b, e, kind in items:
                    out += [text[at:b], f"[{kind.upper()}]"]
                    at = e
                texts.append(None if text is None else "".join(out) + text[at:])
                counts.append(len(items))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["doc_id", "text", "n_items"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, text string, n_items int")
