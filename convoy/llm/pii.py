"""Personal information in free text: where it stands, and of what kind."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

from convoy.llm.tokens import VOCABULARIES, capital_words, common_words

EMAIL, PHONE, ID_NUMBER, ADDRESS, NAME = KINDS = ("email", "phone", "id_number", "address", "name")

#: Given names known beforehand: the commonest of many languages (fixed list). All others are learned from the corpus.
GIVEN_NAMES = frozenset("""
adam ahmed alejandro alexander alice ali amir amit ana anastasia andrea andreas andrew angela anita anna anne antonio aleksandr barbara ben brian bruno carlos carmen carol
catherine charles charlotte chen christian christine christopher claire claudia dario daniel david deborah diego dmitri dorothy edward elena elizabeth elodie emily emma eric
eva fatima fatou fernando francesca francesco francisco francois frank frederic gabriel george giovanni giulia giuseppe greta gunter hans heinz helen helena henry hugo ibrahim
ines ingrid irina isabel ivan jack james jan jane jean jennifer jens jessica joao johan john jonas jorge jose joseph juan julia julie jurgen karen karin katarzyna kevin klaus
kwame lars laura lena li linda lisa louis lucia luis luca magdalena marc marco margaret maria mariam marie mario mark markus martin mary matthew mehmet mei michael michel miguel
mohamed monika mustafa nadia nancy nicolas nikolai nina olga oliver omar oscar pablo pamela patricia paul paula pavel pedro peter petra philippe pierre priya rachel raj
renata richard robert roberto rosa ruth samuel sandra sara sarah sergei sofia sofie stefan stephanie steven susan sven svetlana takeshi thomas tomas ursula viktor
walter wanda wei wolfgang yuki yusuf
иван мария анна ольга александр сергей γιωργος μαρια ελενη
""".split())  # fmt: skip
#: Of these, words in small letters, too: so written, they begin no name (fixed list).
NOT_SMALL = frozenset("carol jack jan mark li ruben rosa mei wei ali ben chen frank".split())

#: Small words before a family name (fixed list).
PARTICLES = r"(?i:de la|de las|de los|van der|van den|van de|von der|von dem|von|van|vom|zu|zum|zur|den|der|ter|ten|de|del|della|delle|di|da|das|dos|do|du|des|le|la|los|las|af|av|al|el|bin|ibn)"

#: Capitalised words that stand beside names without being part of them (fixed list).
NO_NAMES = set("""
a about after again all also an and any are as ask at attn au aussi avec because been before between both but by can cc compare could credit danke das dear
der die does ein eine el ella en ende et everything fragt from gracias grüße gruß gruss had has have hallo he hello her here hey hi his hola how i if il ils in is it its ja je
just la las last le les leave log los man many mein merci mit mr mrs ms my near never no not nobody now of off oh ok on once one only or our per please por pour preguntad que
regards saludos salut said says schreibt see send she short sie since so some somebody start still sure thanks that the their them then there these they this those to today
too try un una und une up use version very via von voyez was watch we were what when where which who why will wir with would write wrote yes yet you your cheers best greetings
bonjour cordialement dr prof herr frau señor señora monsieur madame sir lady captain team press books inc ltd gmbh group bay
however yesterday tomorrow later finally anyway meanwhile therefore indeed perhaps maybe actually monday tuesday wednesday thursday friday saturday sunday
heute gestern morgen montag dienstag mittwoch donnerstag freitag samstag sonntag hier demain lundi mardi mercredi jeudi vendredi samedi dimanche ayer lunes martes miércoles jueves viernes sábado domingo
""".split())  # fmt: skip

#: Last words of streets, places and firms (fixed list): after one, no family name was meant unless a title or an e-mail address says so.
PLACES_AND_FIRMS = frozenset("""
street road avenue boulevard lane drive square gardens crescent terrace station airport university hospital college school museum hotel island river lake park valley beach bay tools works
labs systems software services solutions foundation institute company corporation corp llc plc ag kg press books news times post media bank group partners records studios club union street
""".split())  # fmt: skip
#: What after a name tells that it names a firm, place, work or prize (fixed list).
NAMED_AFTER = re.compile(
    r"[ \t]+(?:(?-i:Inc|Ltd|LLC|GmbH|AG|SA|Corp|PLC)\b|(?:club|street|road|avenue|square|prize|award|foundation|institute|university|school|college|hospital|museum|theorem|station|airport|building|bridge|hall|park|river|film|novel|song|stra(?:ß|ss)e|platz|preis|brand|store|group|company)\b)", re.I
)

_L, _UP = r"[^\W\d_]", r"A-ZÀ-ÖØ-ÞĀ-ŽΆ-ΏΑ-ΫЀ-Я"
_WORD = rf"{_L}+(?:['’\-]{_L}+)*"
_GAP = r"(?:[ \t ]|&nbsp;)+"

_LOCAL, _LABEL, _TOP = r"[^\W_](?:[\w.+%\-]*[^\W_])?", r"[^\W_](?:[\w\-]*[^\W_])?", r"(?=\d*[^\W\d_])[^\W_]{2,24}(?![\w\-@])"
_AT = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|&#0*64;|&commat;)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s+dot\s+|\.)"
EMAIL_AT = re.compile(
    rf"(?<![\w.+%\-/])(?:{_LOCAL}(?:@|{_AT}){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}{_TOP}|{_LOCAL}\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL})*\s+dot\s+{_TOP})", re.I
)
#: What an address spelled with a mark for "@" holds at least.
MAY_MAIL = re.compile(r"[\[({<]\s?at\s?[\])}>]", re.I)

#: Words that tell that the number after (or before) them is none of a person (fixed list).
NOT_OF_A_PERSON = re.compile(r"(?:\b(?:ticket|job|order|part|trace|ref|reference|isbn|issn|page|build|version|invoice no\.?|serial|sku|model|case|item|rate|commit|log|batch|node|row|rows|id=)\W{0,3}(?:no\.?\s|number\s|nr\.?\s)?|[#=/_])$", re.I)
STOCK_AFTER = re.compile(r"\s*(?:is|are) (?:out of|in) stock|\s+rows\b", re.I)

ID_WORD = re.compile(
    r"(?<!\w)(?:tax[ -]?(?:id|number|no\b\.?)|tin|ssn|social security(?: (?:number|no\b\.?))?|national (?:id|identity|insurance)(?: (?:card|number|no\b\.?))*|ni (?:number|no\b\.?)|nino|id[ -]?card(?: (?:number|no\b\.?))?|identity card(?: (?:number|no\b\.?))?|passports?(?: (?:numbers?|no\b\.?))?"
    r"|steuer-?id(?:entifikationsnummer)?|steuernummer|personalausweis(?:nummer)?|ausweis(?:nummer|-nr)?|reisepass(?:nummer)?|pass(?:nummer|-nr)|sozialversicherungsnummer|rentenversicherungsnummer"
    r"|passeport|num[ée]ro (?:fiscal|de s[ée]curit[ée] sociale|de passeport)|s[ée]curit[ée] sociale|carte d['’]identit[ée]|nir|dni|nie|nif|n[úu]mero de la seguridad social|seguridad social|pasaporte|(?:mi )?documento(?: nacional)?(?: de identidad)?|c[ée]dula|identificaci[óo]n|pi[èe]ce d['’]identit[ée]|num[ée]ro d['’]identit[ée]|n° de s[ée]curit[ée] sociale|ausweis|bsn|burgerservicenummer|aadhaar|aadhar|cpf|pesel|personnummer|codice fiscale|carta d['’]identità|carnet de identidad|passaporto|cnp|insz|curp|nhs (?:number|no\b\.?)|social insurance (?:number|no\b\.?)|pps (?:number|no\b\.?)|rijksregisternummer|t\.?c\.? kimlik(?: no)?|dowód osobisty|henkilötunnus)(?!\w)", re.I
)
#: A word of each, in small letters, without accents: texts without any hold no keyword (fixed list).
ID_WORDS = frozenset("""
tax tin ssn social national ni nino passport passports steuer steueridentifikationsnummer steuerid steuernummer personalausweis personalausweisnummer ausweis ausweisnummer reisepass reisepassnummer
passnummer pass sozialversicherungsnummer rentenversicherungsnummer passeport fiscal securite identite nir dni nie nif identidad seguridad pasaporte documento cedula identificacion bsn burgerservicenummer
aadhaar aadhar cpf pesel personnummer fiscale identita passaporto cnp insz curp nhs pps rijksregisternummer kimlik dowod henkilotunnus
""".split())  # fmt: skip
#: Numbers whose own check digits prove them, without a keyword: Brazilian CPF, Spanish DNI and NIE, French NIR.
SELF_CHECKED = re.compile(r"(?<![\w.\-/])(?:\d{3}\.\d{3}\.\d{3}-\d\d|(?:\d{8}|[XYZ]\d{7})-?[A-Z]|[12] ?\d\d ?(?:0[1-9]|1[0-2]) ?\d[\dAB] ?\d{3} ?\d{3} ?\d\d)(?![\w\-/])")
ID_VALUE = re.compile(
    r"(?<![\w.])(?:[a-z]{2}(?: \d\d){3} [a-z](?!\w)|(?:(?-i:[A-Z]{1,3})[ \-]?|[a-z]{1,3})?\d(?:[ \-.]?\d){4,14}(?:[a-z](?!\w)|[ \-](?-i:[A-Z])(?!\w)|(?!\w))|(?-i:[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z])(?!\w)|(?-i:(?=[A-Z]*\d[A-Z]*\d)[A-Z0-9]{7,12})(?!\w))", re.I
)
#: What stands between a value and a keyword after it, and between the values of a list (fixed lists).
ID_BETWEEN = re.compile(r",?\s+(?:is|was|are|ist|war|est|es|as|als)\s+(?:(?:my|your|his|her|their|our|the|a|an|meine?|seine?|ihre?|die|der|das|mon|ma|son|sa|le|la|mi|su|el|new|old)\s+){0,2}|\s*[=(]\s*(?:(?:my|the|meine?|mon|ma|mi)\s+)?", re.I)
ID_LIST = re.compile(r"(?:\s*[,;/&]\s*|\s+)(?:(and|or|und|oder|et|ou|y|o)\s+)?", re.I)

#: Runs of digits and their separators, inside which telephone numbers stand.
DIGITS_RUN = re.compile(r"\d[\d ()./\-]{5,}\d")
PHONE_NUMBER = re.compile(
    r"(?<![\w.\-+/=:#])(?:"
    r"(?:\+|00)[1-9]\d{0,2}[ .\-/]?(?:\(0\)[ .\-/]?)?(?:\(\d{1,4}\)[ .\-/]?)?\d{1,4}(?:[ .\-/]?\d{2,4}){2,5}"
    r"|(?:1[ .\-])?\(\d{2,5}\)[ .\-]?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}"
    r"|(?:1[ .\-])?[2-9]\d\d([ .\-])\d{3}\1\d{4}"
    r"|1[2-9]\d{9}"
    r"|0[1-9]\d{0,3}[ ./\-]\d{5,8}"
    r"|0[1-9]\d{0,4}(?:[ ./\-]\d{2,4}){2,4}"
    r"|0[1-9]\d{8,9}"
    r")(?!\d)(?![.\-/:]\d)(?!\w)"
)

_STREET_EN = r"street|st|road|rd|lane|ln|avenue|ave|drive|dr|close|crescent|cres|terrace|row|court|ct|way|place|pl|square|sq|grove|gardens|mews|walk|hill|rise|boulevard|blvd|parade|quay|alley|yard|highway|hwy|parkway|pkwy"
_STREET_DE = r"stra(?:ß|ss)e|str|weg|platz|gasse|allee|ring|damm|ufer|graben|steig|pfad|chaussee|hof|berg|markt|wall|straat|laan|gracht|kade|plein|gatan|vägen|gränd|vej|gade|veien|gata|katu"
_STREET_FR = r"rue|avenue|av\.|boulevard|bd\.?|impasse|chemin|allée|allee|quai|ruelle|sentier|faubourg"
_PLACE_FR = r"place|cours|route|passage|square"
_STREET_ES = r"calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|callejón|travesía|glorieta|carretera|rua|travessa|praça|(?-i:V)ia|(?-i:V)iale|piazza|corso|vicolo|ul\.|ulica|aleja"
_NO = r"\d{1,4}(?:[a-z](?!\w)|[ ][a-z](?=[ \t]*(?:[,.;:)\]\r\n]|$))| ?(?:bis|ter)(?!\w))?"
_NOS = rf"{_NO}(?:[\-–]\d{{1,4}}(?:[a-z](?!\w))?(?![\w\-/]))?"
#: Words after "am" and the like that tell a time (fixed list).
_NO_PLACE = r"(?:(?:mon|diens|donners|frei|sams|sonn)tag|mittwoch|sonnabend|januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember|jahre?|tag|morgen|abend)\b"
_DE_PLACE = r"am|im|an der|an den|auf der|auf dem|in der|in den|zum|zur|unter den|hinter der|hinter dem|vor dem|beim|bei der"
#: A house number, from which addresses are looked for in both directions.
HOUSE = re.compile(r"\d+")
#: A time or a decimal number goes on after it (a postcode after a comma is none).
_NO_END = r"(?!\w|\.\d|,\d\d?(?!\d)|:\d\d(?!\d))"
#: Before a street a number has at most five digits, after it at most four (five are a postcode there).
NUMBER_FIRST = re.compile(
    rf"(?:{_NO}|\d{{5}}),?{_GAP}(?:(?:{_L}[\w'’\-]*{_GAP}){{1,3}}?(?:{_STREET_EN})\b\.?"
    rf"|(?:(?:{_STREET_FR}|{_PLACE_FR}){_GAP}(?:(?:de la|de l['’]|des|du|de|d['’]|aux|au|à la|saint|sainte){_GAP}?)+|(?:{_STREET_FR}){_GAP}(?=(?-i:[{_UP}]))){_L}[\w'’\-]*(?:{_GAP}(?-i:[{_UP}]){_L}+)*)", re.I,
)
NUMBER_LAST = re.compile(
    rf"(?<!\w)(?<!{_L}-)(?!(?:during|spring|string|bring|offspring)\b)(?:{_L}[\w\-]*(?:{_STREET_DE})\b\.?,?|(?:{_L}+er|(?-i:[{_UP}]){_L}+|{_L}[a-zß\-]*sche){_GAP}(?:{_STREET_DE})\b\.?,?|(?:{_DE_PLACE}){_GAP}(?!{_NO_PLACE})(?-i:[{_UP}]){_L}+){_GAP}{_NOS}{_NO_END}"
    rf"|(?<!\w)(?:{_STREET_ES}){_GAP}?(?:(?:de la|de los|de las|del|de|la|el|los|las|della|delle|dei|do|da|dos){_GAP})*{_L}[\w'’\-]*(?:{_GAP}(?:(?:de la|del|de|da|do|y){_GAP})?(?-i:[{_UP}]){_L}+)*,?{_GAP}(?:(?:n\.?\s?[º°o]\.?|núm\.?|no\.?|nº)(?:{_GAP})?)?{_NOS}{_NO_END}", re.I,
)
#: What the words before a number must hold for a street to stand there: an ending, or a word (from the patterns above).
_ENDS = tuple("straße strasse str weg platz gasse allee ring damm ufer graben steig pfad chaussee hof berg markt wall straat laan gracht kade plein gatan vägen gränd vej gade veien gata katu".split())
_STARTS = frozenset("am im der den dem zum zur beim".split())
_ROMANCE = frozenset("calle avenida avda plaza paseo camino carrera ronda callejón travesía glorieta carretera rua travessa praça via viale piazza corso vicolo ul ulica aleja".split())
_FIRST = frozenset((_STREET_EN + "|rue|avenue|av|boulevard|bd|impasse|chemin|allée|allee|quai|ruelle|sentier|faubourg|" + _PLACE_FR).split("|"))
#: A full stop belongs to the address only after an abbreviation; words before a whole street name are none of it (fixed lists).
ABBREVIATED = re.compile(r"\b(?:st|rd|ln|ave|av|dr|cres|ct|pl|sq|blvd|bd|hwy|pkwy)\.$", re.I)
PREPOSITION = re.compile(rf"(?:am|im|an der|an den|auf der|auf dem|in der|in den|zum|zur|beim|bei der){_GAP}(?=[^\W\d_]+(?i:stra(?:ß|ss)e|str|gasse|allee|platz|chaussee|weg)\b)")
_NUMERO = re.compile(r"(?:\bn\.?\s?[º°o]|\bnúm)\.?$", re.I)

URL_AT = re.compile(r"(?:https?://|www\.)[^\s<>\[\]\"']+", re.I)

#: One word of a name, or what stands with it: an initial (or two), a title, a capitalised word; and runs of them.
_ELEMENT = rf"[{_UP}](?:\.(?:[ \-]?[{_UP}]\.)*|(?:rof|rs?|s|ra?|me|lle|t)\.|{_L}*(?:['’\-]{_L}+)*)"
ELEMENT = re.compile(_ELEMENT)
RUN = re.compile(rf"{_ELEMENT}(?:(?:{_GAP}|(?<=\.))(?:{PARTICLES}{_GAP})*{_ELEMENT})+")
REVERSED = re.compile(rf"[{_UP}]{_L}*(?:['’\-]{_L}+)*,{_GAP}(?=(?P<g>[{_UP}](?:{_L}+(?:-{_L}+)?(?:{_GAP}[{_UP}]\.)?|\.)(?![\w'’\-])))")
PARTICLES_END = re.compile(rf"(?<![\w'’\-])(?:{PARTICLES}{_GAP})+$")
SMALL_PAIR = re.compile(rf"[ \t>(]*(?P<g>{_L}+(?:-{_L}+)?){_GAP}(?:{PARTICLES}{_GAP})*(?P<f>{_L}+(?:['’\-]{_L}+)*)(?![\w@])")

#: Titles, greetings and words that open a letter's end (fixed lists, folded): as first words of a run they are none of the name.
TITLES = frozenset("dr prof mr mrs ms sr sra mme mlle miss herr herrn frau senor senora monsieur madame mademoiselle mevrouw meneer signor signora pan pani".split())
GREETINGS = frozenset("hi hello dear hey hallo liebe lieber bonjour hola cher chere estimado estimada querido querida beste ciao caro cara ola kära".split())
OPENERS = frozenset("ask attn contact regards sincerely cordialement saludos gruss grusse grussen thanks cheers call email tell meet cc kollege kollegin nachbar nachbarin chef chefin freund freundin bruder schwester vater mutter arzt anwalt lehrer lehrerin professor doctor uncle aunt captain president groeten hilsen saluti".split())
#: What before a name tells that a person comes (fixed lists), at the end of what precedes it.
PERSON_BEFORE = re.compile(
    r"(?:\b(?:(?:please )?ask|asked|attn|contact(?: person)?:?|ansprechpartner(?:in)?:?|tell|told|meet|met|colleague|friend|boss|manager|regards|sincerely|cordialement|saludos|gr(?:uß|üße|üßen)|(?:goes|credits?|thanks|thank you) to|dank an|dank geht an|thank|cc|named|name is|called|i am|i'm|this is|fragt|frag|fragen sie|kollege|kollegin|voyez avec|demandez à|voir avec|merci à|collègue"
    r"|gracias a|preguntad a|preguntar a|pregunta a|compañer[oa]|(?:found|written|reported|fixed|reviewed|signed|approved|posted|sent|suggested|caught|spotted|made|authored|maintained) by|day \d+|dr|prof|mrs?|ms|herrn?|frau|mme|señora?|monsieur|madame)[.,:]*|\b(?:on|am|le|el) [^\n]{1,40}\d,|(?:^|\n)[ \t>]*(?:from|von|de|to|an|cc|author|name|reporter|signed|owner|contact):)[ \t ]+\(?$", re.I
)
CLOSING_BEFORE = re.compile(r"(?:regards|sincerely|faithfully|cheers|thanks|cordialement|saludos|saluti|groeten|hilsen|grüßen|grüße|gruß|wishes)[,.!]?[ \t]*(?:\r?\n[ \t>]*){0,3}$", re.I)
SIGN_BEFORE = re.compile(r"(?:^|\n)[ \t>]*(?:--|__|~~|\*\*|==|—)[\-_~*=—]*[ \t]*(?:\r?\n[ \t>]*)+$")
#: What after it tells that a person stood there (fixed lists).
PERSON_AFTER = re.compile(r"\)?[ \t ]+(?:said|says|wrote|writes|disagrees|disagreed|told|asked|asks|replied|thinks|thought|agreed|explained|answered|schrieb|schreibt|meint|meinte|sagt|sagte|fragt|fragte|dazu|a écrit|écrit|écrivit|dit|dijo|escribió|escribe|pregunta|ha scritto|schreef|skrev)\b|\)[ \t]disagrees", re.I)
MAIL_AFTER = re.compile(r"[ \t ]*(?:<|&lt;|\[)(?:mailto:)?[\w.+%\-]+(?:@|\s?[\[({]\s?at\b|\s+at\s|&#0*64;|&commat;)", re.I)
#: A word in small letters before it.
WITHIN = re.compile(rf"(?<![\w.\-/]){_L}+,?[ \u00a0][\"„“«(]?$")
#: A word in small letters after it; and a family name written as one, not like a product's.
AFTERWARDS = re.compile(r"[ \u00a0](?=[^\W\d_])(?-i:[a-zà-öø-ÿ])")
PLAIN = re.compile(rf"(?:(?:Mc|Mac|O['’]|D['’])?[{_UP}](?:(?![{_UP}]){_L})+)(?:-[{_UP}]{_L}+)*")
LINE_END = re.compile(r"[ \t*_~>]*(?:[,.!;:]?[ \t]*(?:\r?\n|$)|<br)")
GREETED = re.compile(r"[ \t]*(?:[,!:;–]|\r?\n|$)")
#: Before a name in small letters, which must not lie further off (fixed list).
SMALL_CUES = ("goes to ", "thanks to ", "thank ", "found by ", "reported by ", "fixed by ", "written by ", "ask ", "attn ", "attn: ", "contact ", "regards, ", "regards,\n", "regards,\r\n", "saludos, ", "cordialement, ", "grüße, ", "gruß, ", "gracias a ", "preguntad a ", "merci à ", "voyez avec ", "fragt ", "dr. ", "mr. ", "mrs. ", "ms. ", "herr ", "frau ", "name is ", "colleague (", "day 1", "day 2", "day 3")


SMALL_AFTER = (" said ", " says ", " wrote", " disagrees", " disagreed", " told ", " asked ", " replied", " schrieb", " meint ", " sagt ", " dazu", " a écrit", " dijo ", ") disagrees")
_SMALL_CUES, _SMALL_AFTER = ([(own[0] if (own := re.findall(r"[^\W_]+", c)) else "", c) for c in cues] for cues in (SMALL_CUES, SMALL_AFTER))
SMALL_BACK = re.compile(rf"(?<![\w'’\-@.]){_L}+(?:-{_L}+)?{_GAP}(?:{PARTICLES}{_GAP})*{_L}+(?:['’\-]{_L}+)*$")


@lru_cache(1 << 17)
def fold(word: str) -> str:
    """Lower case without accents."""
    word = word.casefold().replace("ł", "l").replace("ø", "o").replace("đ", "d")
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _shape(value: str) -> str:
    return re.sub(r"\d", "0", re.sub(r"[^\W\d_]", "a", value))


def self_checked(value: str) -> bool:
    """Whether the check digits of a number in one of the forms of ``SELF_CHECKED`` are right."""
    v = re.sub(r"[\s.\-]", "", value)
    if len(v) == 11 and v.isdigit():
        def digit(n: int) -> int:
            return sum(int(c) * (n + 1 - i) for i, c in enumerate(v[:n])) * 10 % 11 % 10

        return len(set(v)) > 1 and digit(9) == int(v[9]) and digit(10) == int(v[10])
    if len(v) == 9:
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(v[:8].translate({88: 48, 89: 49, 90: 50})) % 23] == v[8]
    return len(v) == 15 and 97 - int(v[:13].replace("2A", "19").replace("2B", "18").replace("A", "0").replace("B", "0")) % 97 == int(v[13:])


class Text:
    """A text with its small letters in the same places and the set of its words, by which searches are left out that can find nothing."""

    __slots__ = ("low", "runs", "text", "words")

    def __init__(self, text: str):
        self.text, low = text, text.lower()
        self.low = low = low if len(low) == len(text) else "".join(c if len(c) == 1 else "?" for c in map(str.lower, text))
        words = set(low.split())
        mixed = [w for w in words if not w.isalnum()]
        words.update(_RUNS.findall(" ".join(mixed)))
        words.update([fold(w) for w in words if not w.isascii()])
        self.words, self.runs = words, list(DIGITS_RUN.finditer(text))

    def places(self, word: str):
        """Where a word (in small letters) stands by itself."""
        low, n, at = self.low, len(word), self.low.find(word)
        while at >= 0:
            if not low[at - 1 : at].isalpha() and not low[at + n : at + n + 1].isalpha():
                yield at
            at = low.find(word, at + n)


_RUNS = re.compile(r"[^\W_]+")
SURE, UNSURE = 2, 1


class Detector:
    """Finds spans of personal information by rules and context.

    ``given_names`` adds to the few given names known beforehand. ``learned`` does likewise; :mod:`convoy.llm.redact` learns it
    from the corpus. ``vocabularies`` are files of public tokenizers, which tell which words are common.
    """

    def __init__(self, given_names=(), vocabularies=VOCABULARIES):
        self.given = frozenset(map(fold, GIVEN_NAMES)) | {fold(n) for n in given_names}
        self.common, self.proper = common_words(tuple(vocabularies)), capital_words(tuple(vocabularies))

    def spans(self, text: str, learned=frozenset()) -> list[tuple[int, int, str]]:
        """Disjoint (begin, end, kind), in order; names that need a learned given name count if it is in ``learned``."""
        return [(a, b, kind) for a, b, kind, key, _ in self.candidates(text) if key is None or key in learned]

    def candidates(self, text: str) -> list[tuple[int, int, str, str | None, str | None]]:
        """Disjoint (begin, end, kind, key, lesson), in order.

        ``key`` is the given name that must be known for a name to count, null where the place or the name itself is proof
        enough. ``lesson`` is the given name that a sure name teaches, null if it is an initial.
        """
        begins: list[int] = []
        ends: list[int] = []
        out = []

        def free(a: int, b: int) -> bool:
            i = bisect_right(begins, a)
            return (i == 0 or ends[i - 1] <= a) and (i == len(begins) or begins[i] >= b)

        def take(a: int, b: int) -> None:
            i = bisect_right(begins, a)
            begins.insert(i, a)
            ends.insert(i, b)

        def add(a: int, b: int, kind: str, key=None, lesson=None) -> None:
            if free(a, b):
                take(a, b)
                out.append((a, b, kind, key, lesson))

        t = Text(text)
        if "@" in text or "dot" in t.words or "&" in text and ("64;" in text or "commat;" in t.low) or MAY_MAIL.search(text):
            for m in EMAIL_AT.finditer(text):
                a = m.start() + (7 if m[0].lower().startswith("mailto:") else 0)
                add(a, m.end(), EMAIL)
        if "://" in text or "www." in text:
            gaps = []
            for m in URL_AT.finditer(text):  # numbers inside URLs belong to nobody
                at = m.start()
                for i in range(bisect_right(ends, at), len(begins)):  # around e-mail addresses in it
                    if begins[i] >= m.end():
                        break
                    gaps.append((at, begins[i]))
                    at = ends[i]
                gaps.append((at, m.end()))
            for a, b in gaps:
                if a < b:
                    take(a, b)
        for a, b in self.addresses(t):
            add(a, b, ADDRESS)
        for a, b in self.id_numbers(t):
            add(a, b, ID_NUMBER)
        for c in t.runs:
            for m in PHONE_NUMBER.finditer(text, max(0, c.start() - 2), c.end()):
                if not self.impersonal(text, m.start(), m.end()) and 7 <= sum(x.isdigit() for x in m[0]) <= 15:
                    add(*m.span(), PHONE)
        names = self.names(t)
        for a, b, key, lesson in sorted(names, key=lambda x: (x[2] is not None, x[0], -x[1])):
            add(a, b, NAME, key, lesson)
        return sorted(out, key=lambda x: x[0])

    @staticmethod
    def impersonal(text: str, a: int, b: int) -> bool:
        return bool(NOT_OF_A_PERSON.search(text, max(0, a - 24), a) or STOCK_AFTER.match(text, b))

    @classmethod
    def id_numbers(cls, t: Text):
        text = t.text
        if not ID_WORDS.isdisjoint(t.words) or "card" in t.words and ("id" in t.words or "identity" in t.words):
            for w in ID_WORD.finditer(text):
                # A value starts within 60 characters of its keyword; where it ends is not bounded (none is longer than 48).
                for m in ID_VALUE.finditer(text, max(0, w.start() - 108), w.start()):
                    if ID_BETWEEN.fullmatch(text, m.end(), w.start()):
                        yield m.span()
                m = ID_VALUE.search(text, w.end(), w.end() + 108)
                if not m or m.start() > w.end() + 60 or re.search(r"[.!?]\s|\n\s*\n|\d", text[w.end() : m.start()]):
                    continue
                yield m.span()
                while (go := ID_LIST.match(text, m.end())) and (n := ID_VALUE.match(text, go.end())) and (_shape(n[0]) == _shape(m[0]) or go[1] and not PHONE_NUMBER.match(text, n.start())):
                    yield n.span()
                    m = n
        for c in t.runs:
            for m in SELF_CHECKED.finditer(text, max(0, c.start() - 1), c.end() + 24):
                if self_checked(m[0]) and not cls.impersonal(text, *m.span()):
                    yield m.span()

    @staticmethod
    def addresses(t: Text):
        text, low = t.text, t.low
        first_may, romance = not _FIRST.isdisjoint(t.words), not _ROMANCE.isdisjoint(t.words) or "c/" in low
        last_may = romance or any(w.endswith(_ENDS) for w in t.words) or not _STARTS.isdisjoint(t.words)
        if not (first_may or last_may):
            return
        floor = 0  # where a street before the number may start: in its line, after the last number that stands by itself
        for n in HOUSE.finditer(text):
            a = n.start()
            if n.end() - a > 5:
                continue
            last = text[a - 1 : a]
            if blank := last.isspace():
                first = True
            elif last.isalnum() or last and last in "_.-/°":
                first, blank = False, last in "º°oO.mM" and _NUMERO.search(text, max(0, a - 6), a)
            else:
                # 11:47 and 1,200 are none.
                first, blank = not (last and last in ":," and text[a - 2 : a - 1].isdigit()), last == ";" and text.endswith("&nbsp;", 0, a)
            if first and first_may and (m := NUMBER_FIRST.match(text, a)):
                yield a, m.end() - (m[0].endswith(".") and not ABBREVIATED.search(m[0]))
            if not (blank and last_may):
                continue
            end = a - 6 if last == ";" else a - 1
            floor = max(floor, text.rfind("\n", floor, a) + 1)
            start = max(low.rfind(" ", floor, end), low.rfind("\t", floor, end), low.rfind(" ", floor, end), low.rfind(";", floor, end)) + 1
            word = low[max(start, floor) : end].rstrip(".,")
            if romance or word.endswith(_ENDS) or text[max(start, floor) : end][:1].isupper() and not _STARTS.isdisjoint(low[max(floor, start - 12) : start].replace("&nbsp;", " ").split()):
                for m in NUMBER_LAST.finditer(text, floor, a + 24):
                    if m.start() < a < m.end():
                        yield m.start() + (p.end() if (p := PREPOSITION.match(m[0])) else 0), m.end()
            if last.isspace():
                floor = a

    def names(self, t: Text) -> list[tuple[int, int, str | None, str | None]]:
        """(begin, end, key, lesson) of all names that may stand in a text, overlapping ones too."""
        text, found = t.text, []
        for m in RUN.finditer(text):
            before = text[m.start() - 1 : m.start()]
            if not (before and (before.isalnum() or before in "_'’-@")) and (x := self._run(text, *m.span())):
                found.append(x)
        if "," in text:
            for m in REVERSED.finditer(text):
                before = text[m.start() - 1 : m.start()]
                if not (before and (before.isalnum() or before in "_'’-@")) and (x := self._reversed(text, m)):
                    found.append(x)
        found += self._small(t)
        again = {text[a:b] for a, b, key, lesson in found if key is None and lesson and lesson not in self.given}
        for value in again:  # other mentions of a name that its place gave away
            at = text.find(value)
            while at >= 0:
                b = at + len(value)
                before, after = text[at - 1 : at] if at else "", text[b : b + 1]
                if not (before.isalnum() or before and before in "'’-@._") and not (after.isalnum() or after and after in "_@"):
                    found.append((at, b, None, None))
                at = text.find(value, b)
        return found

    def _context(self, text: str, a: int, b: int) -> int:
        """How far the place tells that a person is named there: 3 by the writer's own mark, 2 by words beside it, 0 not at all."""
        if MAIL_AFTER.match(text, b):
            return 3
        w = max(0, a - 80)
        if (CLOSING_BEFORE.search(text, w, a) or SIGN_BEFORE.search(text, w, a)) and LINE_END.match(text, b):
            return 3
        return 2 if PERSON_BEFORE.search(text, w, a) or PERSON_AFTER.match(text, b) else 0

    def _run(self, text: str, a: int, b: int):
        """The name in a run of capitalised words, if there is one."""
        parts = [(m.start(), m.end(), m[0]) for m in ELEMENT.finditer(text, a, b)]
        i, n, title, cue = 0, len(parts), False, 0
        while i < n:
            word = parts[i][2]
            w = fold(word.rstrip("."))
            if len(w) == 1:
                break
            if w in TITLES:
                title = True
            elif w in OPENERS:
                cue, title = 2, False
            elif w in GREETINGS:
                cue, title = 1, False
            elif word.lower() in NO_NAMES or (n - i > 2 and len(parts[i + 1][2].rstrip(".")) > 1 and w not in self.given and word.lower() in self.common and not title):
                cue, title = 0, False
            else:
                break
            i += 1
        while n - i > 2 and (parts[n - 1][2].lower() in NO_NAMES or parts[n - 1][2].lower() in self.common and fold(parts[n - 2][2]) not in self.given):
            n -= 1
        if n - i < 2 or n - i > 6:
            return None
        begin, given = parts[i][0], parts[i][2]
        initial = given.endswith(".")
        if len(given) == 1:
            return None
        # The family name: the next full word, and on while that is a given name, too, or no word of its own.
        k = i + 1
        while k < n - 1 and (len(parts[k][2].rstrip(".")) == 1 or parts[k][2].endswith(".") or _PARTICLE.match(parts[k][2])):
            k += 1
        while k < n - 1 and len(parts[k + 1][2].rstrip(".")) > 1 and (fold(parts[k][2].split("-")[0]) in self.given or self._rare(parts[k + 1][2])):
            k += 1
        end, family = parts[k][1], parts[k][2]
        if family.endswith("."):
            if len(family) < 3:
                return None
            end, family = end - 1, family[:-1]
        if family.endswith(("'s", "’s")):
            end, family = end - 2, family[:-2]
        key = fold(given.split("-")[0])
        known = not initial and key in self.given
        if not self._family(family, 2 if title else 3):
            return None
        fl, gl = family.lower(), given.lower()
        if title:
            return (begin, end, None, None if initial else key)
        if not (known or initial) and (gl in NO_NAMES or gl in self.common and fl in self.common):
            return None
        context = max(self._context(text, begin, end), 2 * (cue == 2), 2 * (cue == 1 and bool(GREETED.match(text, end))))
        if context < 3 and (fl in PLACES_AND_FIRMS or gl in PLACES_AND_FIRMS or NAMED_AFTER.match(text, end)):
            return None
        lesson = None if initial else key
        if initial or known:
            return (begin, end, None, lesson) if context or fl not in self.common else None
        if not (len(given) > 1 and (given[1:].islower() or "-" in given or (given.isupper() and family.isupper()))):
            return None
        if gl in self.common or fl in self.common:
            return (begin, end, None, lesson) if context == 3 and not {gl, fl} & PLACES_AND_FIRMS else (begin, end, key, None) if fl not in self.common else None
        if context:
            turned = fold(family.split("-")[0])
            return (begin, end, None, lesson if turned not in self.given else None)
        # In the midst of a sentence two words of their own that stand alone are a name; elsewhere the given name must be known.
        # Two words that are both well known with a capital are as likely a place or a firm.
        lonely = (
            n == len(parts) and (WITHIN.search(text, max(0, begin - 40), begin) if i == 0 else i == 1 and AFTERWARDS.match(text, end))
            and given[1:].islower() and PLAIN.fullmatch(family) and not (gl in self.proper and fl in self.proper)
        )
        return (begin, end, None if lonely else key, None)

    def _reversed(self, text: str, m: re.Match):
        """A family name before a comma and a given name or initial."""
        family, given = text[m.start() : m.end()].split(",")[0], m["g"]
        begin, end = m.start(), m.end("g")
        if p := PARTICLES_END.search(text, max(0, begin - 48), begin):
            begin = p.start()
        first = re.split(rf"{_GAP}", given)[0]
        initial = first.endswith(".")
        key = fold(first.split("-")[0])
        fl = family.lower()
        if not self._family(family, 3) or first.lower() in NO_NAMES or fold(fl) in GREETINGS or fl in PLACES_AND_FIRMS or fl in self.common and fold(fl) not in self.given:
            return None
        known, both = not initial and key in self.given, fold(family) in self.given
        context = self._context(text, begin, end)
        if initial:
            return (begin, end, None, None) if context else None
        if known and not both:
            return (begin, end, None, None)
        if context == 3:
            return (begin, end, None, None if known else key)
        return None if both else (begin, end, key, None)

    def _small(self, t: Text):
        """Names in small letters, which only a cue before them or a line of their own gives away."""
        text, low = t.text, t.low
        at = []
        for word, cue in _SMALL_CUES:
            i = low.find(cue) if word in t.words else -1
            while i >= 0:
                if not low[i - 1 : i].isalpha():
                    j = i + len(cue)
                    at.append((j + 2 + (low[j + 1 : j + 2] == ",") if cue.startswith("day ") else j, False))
                i = low.find(cue, i + 1)
        begin = 0  # lines of few words, signatures among them
        for line in low.split("\n"):
            if line.count(" ") < 12 and len(line.strip(" \t\r>*_~-").split()) in (2, 3, 4):
                at.append((begin, True))
            begin += len(line) + 1
        for word, cue in _SMALL_AFTER:
            i = low.find(cue) if not word or word in t.words else -1
            while i >= 0:
                if m := SMALL_BACK.search(text, max(0, i - 80), i):
                    at.append((m.start(), False))
                i = low.find(cue, i + 1)
        if "@" in text or "at" in t.words:
            for mark in (" <", " &lt;"):
                i = low.find(mark)
                while i >= 0:
                    if MAIL_AFTER.match(text, i) and (m := SMALL_BACK.search(text, max(0, i - 80), i)):
                        at.append((m.start(), False))
                    i = low.find(mark, i + 1)
        for i, line in at:
            m = SMALL_PAIR.match(text, i)
            if not m or not m["g"].islower() or not m["f"][0].islower() or len(m["f"]) < 3 or len(m["g"]) < 2:
                continue
            key = fold(m["g"].split("-")[0])
            known = key in self.given and key not in NOT_SMALL
            if m["f"] in self.common or m["f"] in NO_NAMES or m["g"] in NO_NAMES or line and not LINE_END.match(text, m.end()):
                continue
            yield (m.start("g"), m.end(), None if known else key, None)

    def _rare(self, word: str) -> bool:
        w = word.lower()
        return word[1:].islower() and w not in self.common and w not in NO_NAMES and w not in PLACES_AND_FIRMS

    def _family(self, word: str, least: int = 3) -> bool:
        parts = word.split("-")
        return len(word) >= least and all(p[:1].isupper() for p in parts) and word.lower() not in NO_NAMES and parts[0].lower() not in NO_NAMES


_PARTICLE = re.compile(rf"(?:{PARTICLES})$")
