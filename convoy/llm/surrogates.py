"""Keyed stand-ins for personal information: of the same kind, gender, script and format, and distinct where originals are."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Mapping

from convoy.llm.pii import ADDRESS, EMAIL, ID_NUMBER, NAME, PARTICLES, PHONE, fold

#: Letters of initials, by script: consonants and vowels, each permuted among themselves (fixed tables).
LETTERS = {
    "latin": ("bcdfghjklmnpqrstvwxyz", "aeiou"),
    "greek": ("βγδζθκλμνξπρστφχψ", "αεηιουω"),
    "cyrillic": ("бвгджзклмнпрстфхцчшщ", "аеиоуыэюя"),
}
#: Letters that syllables are made of, by script (fixed tables).
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou"),
    "greek": ("βγδζκλμνπρστφ", "αεηιου"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу"),
}
#: Given names borne by men though they end in a, and by women though they do not (fixed lists).
MEN = set("andrea luca sasha nicola hanno otto hugo mario marco diego pablo pedro ignacio fernando eduardo antonio matteo dario bruno leo theo".split())
WOMEN = set("agnes astrid beatrix brigitte camille carmen charlotte claire delphine elke esther greta heike helene ilse ines ingrid ingrith irene isabel kirsi margot mathilde noemi ode pilar rosalind sian susanne sylvie tamsin amelie aurelie elodie julie lucie marie maelle renate stephanie sabine ulrike zoe cecile alice anne".split())
#: Parts of a street's name that stay (fixed list).
STREET_WORDS = re.compile(
    r"^(?:street|st|road|rd|lane|ln|avenue|ave|av|drive|dr|close|crescent|cres|terrace|row|court|ct|way|place|pl|square|sq|grove|gardens|mews|walk|hill|rise|boulevard|blvd|bd|parade|quay|alley|yard|stra(?:ß|ss)e|str|weg|platz|gasse|allee|ring|damm|ufer|graben|steig|pfad|chaussee|hof|berg|markt|wall"
    r"|rue|impasse|chemin|allée|quai|cours|ruelle|route|passage|sentier|faubourg|calle|c|avenida|avda|plaza|paseo|camino|carrera|ronda|callejón|travesía|glorieta|carretera|n|º|núm|no|bis|ter|la|le|les|los|las|el|l|d|des|du|del|de|der|den|dem|am|an|auf|im|in|zum|zur|unter|hinter|vor|bei|beim|saint|sainte|y|[a-z])$", re.I
)
STREET_END = re.compile(r"(?:stra(?:ß|ss)e|str|weg|platz|gasse|allee|ring|damm|ufer|graben|steig|pfad|chaussee|hof|berg|markt|wall)$", re.I)
_RUN = re.compile(r"[^\W\d_]+|\d+")
_DOTTED = re.compile(r"\s?[\[({<]\s?(?:at|dot|\.)\s?[\])}>]\s?|\s+(?:at|dot)\s+|&#0*64;|&commat;|@|\.", re.I)


def script(word: str) -> str:
    for c in word:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def like(model: str, word: str) -> str:
    """``word`` in the case of ``model``."""
    if len(model) > 1 and model.isupper():
        return word.upper()
    return word.capitalize() if model[:1].isupper() else word


def gender(given: str) -> str:
    g = fold(given)
    return "f" if g in WOMEN or (g.endswith("a") and g not in MEN) else "m"


def unit(kind: str, value: str) -> tuple[str, str]:
    """What a value is told apart by: equal units get equal stand-ins, different ones different ones."""
    if kind == PHONE:
        digits = re.sub(r"\(0\)", "", value)
        return kind, re.sub(r"^00", "+", re.sub(r"[^\d+]", "", digits))
    if kind == ID_NUMBER:
        return kind, re.sub(r"[^A-Z0-9]", "", value.upper())
    if kind == EMAIL:
        return kind, _DOTTED.sub(_plain, value).lower()
    return kind, " ".join(_RUN.findall(fold(value)))


def _plain(m: re.Match) -> str:
    return "@" if re.search(r"@|64;|commat|\bat\b", m[0], re.I) else "."


_PARTICLE = re.compile(rf"(?:{PARTICLES})$")
_NAME_WORD = re.compile(r"[^\W\d_]+")


def name_parts(value: str) -> list[tuple[str, int, int]]:
    """(role, begin, end) of each word of a name: g given, i initial, f family; particles and elided ones stay."""
    words = [(m[0], *m.span()) for m in _NAME_WORD.finditer(value)]
    turned = "," in value
    comma = value.find(",")
    last = max((k for k, (_, a, _) in enumerate(words) if not turned or a < comma), default=0)  # the family name itself
    small = [bool(_PARTICLE.match(w)) and k != last and (k > 0 or turned) for k, (w, _, _) in enumerate(words)]
    out = []
    for k, (w, a, b) in enumerate(words):
        after_comma = turned and a > comma
        if small[k] and not after_comma or len(w) == 1 and value[b : b + 1] in ("'", "’"):
            continue
        if len(w) == 1:
            out.append(("i", a, b))
        elif after_comma or (not turned and k == 0):
            out.append(("g", a, b))
        else:
            out.append(("f", a, b))
    return out


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """The parts of a value that are replaced and checked each for itself."""
    if kind != NAME:
        return [unit(kind, value)]
    return [("given" if r == "g" else "family", fold(value[a:b])) for r, a, b in name_parts(value) if r != "i"]


#: Syllables of a stand-in, whatever the number of units, so that a corpus that grows keeps its stand-ins: 70 to their power.
SYLLABLES = {"given": 4, "family": 6}
#: From this try on, a stand-in is a little longer than its original, as its format has too few values.
LONGER = 6


class Surrogates:
    """Stand-ins from a secret ``key``; ``attempts`` is the try at which a unit's stand-in is its own alone (0 unless listed)."""

    def __init__(self, key: str, attempts: Mapping[tuple[str, str], int] | None = None):
        self.key, self.attempts = key.encode(), attempts or {}
        self._initials: dict[str, str] = {}
        for letters in (x for pair in LETTERS.values() for x in pair):
            self._initials |= zip(letters, sorted(letters, key=lambda c: self._bits("initial", c, 0)), strict=True)

    def _bits(self, role: str, norm: str, attempt: int) -> int:
        return int.from_bytes(hmac.new(self.key, f"{role}\0{norm}\0{attempt}".encode(), hashlib.sha512).digest(), "big")

    def _letter(self, letter: str) -> str:
        """Initials keep to each other: a keyed permutation of the consonants and one of the vowels; letters of no table stay."""
        low = fold(letter)[:1]
        return like(letter, self._initials.get(low, low))

    def _word(self, bits: int, how: str, n: int, first: str = "", end: str = "") -> str:
        consonants, vowels = SCRIPTS[how]
        out = ""
        for i in range(n):
            bits, c = divmod(bits, len(consonants))
            bits, v = divmod(bits, len(vowels))
            out += (first.lower() if first and not i else consonants[c]) + vowels[v]
        return out + end

    def _digits(self, model: str, bits: int) -> str:
        bits, head = divmod(bits, 9)
        out = str(head + 1)
        for _ in model[1:]:
            bits, d = divmod(bits, 10)
            out += str(d)
        return out[: len(model)]

    def canonical(self, role: str, norm: str, attempt: int) -> str:
        """What must differ between units of a role, whatever their spelling."""
        if role == "given":
            return fold(self._given(norm, attempt))
        if role == "family":
            return fold(self._family(norm, attempt))
        return unit(role, self._other(role, norm, norm, attempt))[1]

    def _given(self, given: str, attempt: int) -> str:
        end = {"latin": {"f": "na", "m": "n"}, "greek": {"f": "να", "m": "ς"}, "cyrillic": {"f": "на", "m": "н"}}[script(given)][gender(given)]
        return self._word(self._bits("given", fold(given), attempt), script(given), SYLLABLES["given"] + attempt // LONGER, self._letter(given[0]), end)

    def _family(self, family: str, attempt: int) -> str:
        return self._word(self._bits("family", fold(family), attempt), script(family), SYLLABLES["family"] + attempt // LONGER)

    def replace(self, kind: str, value: str) -> str:
        """The stand-in for a value, spelled as the value is."""
        if kind != NAME:
            role, norm = unit(kind, value)
            return self._other(kind, value, norm, self.attempts.get((role, norm), 0))
        out, at = [], 0
        for role, a, b in name_parts(value):
            word = value[a:b]
            if role == "i":
                new = self._letter(word)
            elif role == "g":
                new = like(word, self._given(word, self.attempts.get(("given", fold(word)), 0)))
            else:
                new = like(word, self._family(word, self.attempts.get(("family", fold(word)), 0)))
            out += [value[at:a], new]
            at = b
        return "".join([*out, value[at:]])

    def _other(self, kind: str, value: str, norm: str, attempt: int) -> str:
        bits = self._bits(kind, norm, attempt)

        def run(m: re.Match) -> str:
            nonlocal bits
            word = m[0]
            bits, own = divmod(bits, 1 << 40)
            bits |= 1 << 60  # never runs dry
            if word.isdigit():
                return self._digits(word, own)
            if kind == ADDRESS:
                if STREET_WORDS.match(word):
                    return word
                end = STREET_END.search(word)
                return like(word, self._word(own, script(word), 4 + attempt // LONGER) + (end[0].lower() if end else ""))
            return like(word, self._word(own, script(word), 3))

        if kind == ID_NUMBER:
            new = []
            for c in norm:
                bits, own = divmod(bits, 260)
                new.append(str(own % 10) if c.isdigit() else chr(65 + own % 26))
            fill = iter(new)
            return re.sub(r"[A-Za-z0-9]", lambda m: like(m[0], next(fill).lower()), value) + self._more(kind, norm, attempt)
        if kind == PHONE:
            # The way the number is prefixed stays: + or 00 and country code, or the first digit.
            head = re.match(r"(?:\+|00)\d{1,2}[ .\-/]?(?:\(0\))?|\(?(?:0?[1-9]|\d)", value)
            keep = head.end() if head else 0
            country = re.match(r"\+1|(?:\+|00)\d\d", value)
            if country:
                keep = country.end()
                keep += (m.end() if (m := re.match(r"[ .\-/]?\(0\)", value[keep:])) else 0)
            tail = re.sub(r"\D", "", value[keep:])
            digits = iter(str(bits % 10 ** len(tail)).zfill(len(tail))) if tail else iter("")
            return value[:keep] + re.sub(r"\d", lambda m: next(digits), value[keep:]) + self._more(kind, norm, attempt)
        if kind == EMAIL:
            marks = list(_DOTTED.finditer(value))
            at = next((m for m in marks if _plain(m) == "@"), None)
            if at is None:
                return value
            local = _RUN.sub(run, value[: at.start()])
            if fold(value[: at.start()]) == fold(local):
                local += like(local, self._word(bits, "latin", 2))
            if attempt >= LONGER:
                local += self._more(kind, norm, attempt)
            labels = re.split(f"({_DOTTED.pattern})", value[at.end() :], flags=re.I)
            labels = [(like(x, "example") if i == len(labels) - 1 else _RUN.sub(run, x)) if i % 2 == 0 else x for i, x in enumerate(labels)]
            return local + at[0] + "".join(labels)
        return _RUN.sub(run, value) if kind != ADDRESS or attempt < LONGER else self._longer_street(_RUN.sub(run, value), norm, attempt)

    def _more(self, kind: str, norm: str, attempt: int) -> str:
        """Digits that make a stand-in longer once its format has run out of values: none before the try ``LONGER``."""
        n = attempt - LONGER + 1
        return str(self._bits(f"{kind}+", norm, attempt) % 10**n).zfill(n) if n > 0 else ""

    def _longer_street(self, value: str, norm: str, attempt: int) -> str:
        """A street of no words of its own (5th Avenue): its number grows."""
        return re.sub(r"\d+", lambda m: m[0] + self._more(ADDRESS, norm, attempt), value, count=1)
