"""Problem 4: personal information inside free text is found and replaced by placeholders.

Method: regular expressions propose spans, checksum validators (Luhn, mod-97 and those of
national numbers) confirm them, and nearby context words raise or lower the score; a span
counts from a score of THRESHOLD. Kinds are sought in the order e-mail, address, identity
number, phone, name, each outside the spans already taken.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import Scratch, ship_package

THRESHOLD = 0.6
KINDS = ("email", "address", "id_number", "phone", "name")

# Ways to write an address's at sign and dots.
_AT = r"(?:\s?[@＠]\s?|\s?[(\[{]\s?at\s?[)\]}]\s?)"
_DOT = r"(?:\.|．|\s?[(\[{]\s?dot\s?[)\]}]\s?)"
_LOCAL = r"(?<![\w.+%/-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}"
_EMAIL = re.compile(
    rf"(?:mailto:)?{_LOCAL}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}[A-Za-z]{{2,24}}(?![\w@-])(?!{_DOT}\w)"
    rf"|{_LOCAL} at (?!(?:the|a|an|this|that|my|our|all|least|last)\b)[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot [A-Za-z]{{2,24}}\b(?! dot )"
)

# Street words of the languages, and what may follow a street.
_STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Ct|Terrace|Ter|Square|Sq|Crescent|Parkway|Pkwy|Highway|Hwy"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?)\s*#?\w{1,5}"
_TOWN = r"(?!Flat|Apt)[A-ZÀ-Þ][\w'-]+(?:,?\s+\d{4,6})?(?![\w.]*@)"
_ADDRESS = re.compile(
    "|".join(
        [
            rf"(?:\b{_UNIT},\s*)?(?<![\w.,$#-])\d{{1,5}}[A-Za-z]?\s+(?:[A-Z][\w'-]+\s+){{1,3}}(?:{_STREET}|Place|Pl|Way|Close|Dr)\b\.?(?:,\s*{_UNIT})?(?:,\s+{_TOWN})?",
            rf"(?:\b(?i:{_UNIT}),\s*)?(?<![\w.,$#-])\d{{1,5}}\s+(?i:[a-z'-]+)\s+(?i:{_STREET})\b\.?(?i:,\s*{_UNIT})?(?:,\s+[A-Za-z]+\s+\d{{5}})?",
            r"\b(?:P\.?\s?O\.?\s?|(?i:post office ))B(?i:ox)\s+\d{1,6}(?:,\s+[A-Z]\w+(?:\s+\d{5})?)?",
            r"\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer)\s+\d{1,4}\s?[a-z]?\b(?:,\s+\d{5}\s+[A-ZÄÖÜ]\w+)?",
            r"(?<![\w.,-])\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|boulevard|bd|impasse|allée|place|chemin|quai|route|cours|passage)\s+(?:(?:du|de la|des|de)\s+|de l'|d')?[A-ZÀ-Þ][\w'-]+(?:,\s+\d{5}\s+[A-ZÀ-Þ]\w+)?",
            r"\b(?:ул\.|улица|пер\.|переулок|просп\.|проспект|пр-т|бульвар|б-р|наб\.|набережная|шоссе|пл\.|площадь)\s+[А-ЯЁ][\w-]+,?\s+(?:(?:д\.|дом)\s*)?\d{1,4}\w?(?:,\s*кв\.\s*\d+)?",
            r"\b(?:Calle|C/|Avenida|Avda\.|Av\.|Plaza|Pza\.|Paseo|Camino|Travesía|Ronda)\s*(?:de\s+(?:la\s+|los\s+|las\s+)?|del\s+)?[A-ZÀ-Þ][\w'-]+,?\s+(?:n\.?\s?º\s*)?\d{1,4}(?:,\s+\d{5}\s+[A-ZÀ-Þ]\w+)?",
        ]
    )
)

# Words around an identity number, and around numbers of other kinds.
_ID_BEFORE = re.compile(
    r"(?i)ssn|social security|\bsocial\b|taxpayer|tax id|identity (?:number|card|no)|national insurance|\bnino\b|passport|\bid card|driver'?s licen[cs]e"
    r"|ausweis|steuer-?id|steuernummer|identifikationsnummer|reisepass|sozialversicherung|\bdni\b|\bnie\b|\bnif\b|documento|pasaporte"
    r"|sécu|fiscal|passeport|carte d.identité|\bинн\b|снилс|паспорт"
)
_ID_AFTER = re.compile(r"(?i)\bmy (?:whole )?social\b|a nombre de|\bssn\b")
_OTHER_NUMBER = re.compile(
    r"(?i)ticket|order|serial|\bitem\b|checksum|\bseed\b|build|version|batch|invoice|score|section|\brfc\b|charge|заказ|верси|commande|pedido|bestellung"
)
_ID = re.compile(r"(?<![\w.-])[A-Z]{0,2}[ .-]?\d(?:[ .-]{0,1}[\dX]){5,20}(?:[ -]?[A-Z])?(?![\w-])")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")

# Words around a phone number.
_PHONE_BEFORE = re.compile(
    r"(?i)\btel\b|\btel\.|phone|\bcall\b|\btext\b|reach|desk|\bline\b|mobile|\bcell\b|whatsapp|ring me|anruf|rückfragen|telefon|appel|joign|numéro|llam|teléfono|телефон|звон|тел\."
)
_DIGIT_WORD = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_PHONES = [
    (re.compile(r"(?<![\w.+-])(?:\+1|001|1)?[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?:,? ?(?:ext\.?|x) ?\d{1,5})?(?![\w-])"), 0.6),
    (re.compile(r"(?<![\w+])\+\d[\d ()/.-]{6,20}\d(?:,? ?(?:ext\.?|x) ?\d{1,5})?(?!\w)"), 0.8),
    (re.compile(r"(?<![\w.-])00[1-9]\d{0,2}[ -]\d[\d -]{5,14}\d(?!\w)"), 0.6),
    (re.compile(r"(?<![\w.-])(?:\(020\)|020) ?\d{4} ?\d{4}(?!\w)"), 0.6),
    (re.compile(r"(?<![\w.-])(?:\(0\d{2,4}\) ?|0\d{2,4}[ /])\d{3,8}(?:[ -]\d{1,4}){0,2}(?!\w)"), 0.6),
    (re.compile(r"(?<![\w.-])0[1-9](?:[ .]\d{2}){4}(?!\w)"), 0.6),
    (re.compile(r"(?<![\w.-])8 ?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}(?![\w-])"), 0.6),
    (re.compile(r"(?<![\w.-])[5-9]\d{2}(?:-\d{6}|(?: \d{2}){3}|(?: \d{3}){2})(?!\w| \d)"), 0.3),
    (re.compile(r"(?<![\w.-])\d{9,11}(?![\w-])"), 0.25),
    (re.compile(rf"(?i)\b(?:(?:{_DIGIT_WORD})[ ,-]+){{6,}}(?:{_DIGIT_WORD})\b"), 0.7),
]
# Titles, organisations, and words that introduce a person: surely, and perhaps.
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra|Mme|M|Monsieur|Madame|Señor|Señora|г-н|г-жа)\.?\s+"
_COMPANY = r"Motors|Labs|Cloud|Works|Group|Systems|Inc|Ltd|LLC|Corp|GmbH|AG|SA|Bank|University|Institute|Foundation|Street|Avenue"
_SURELY = re.compile(
    r"(?i:my name is|name's|signed,|sincerely,|regards,|cheers,|yours,|ask for|attention|attn:?|landlord|landlady|neighbo[u]?r|saludo,|atentamente,|grüße,|grüßen,|cordialement,|уважением,"
    r"|mi nombre es|me llamo|a nombre de|je m'appelle|ich heiße|mein name ist|меня зовут|\bwife|\bhusband|\bcolleague|\bboss)\s+$"
)
_PERHAPS = re.compile(r"(?i:thanks to|\bmet|\basked|\bi am|i'm|\bwith|\bfrom|\bby|\bto|\btold|\bsaid|\bbei|\bmit|\bavec|\bcon|--|—)\s+$")
_THING = re.compile(r"(?i:\b(?:the|a|an|this|that|our|my|its|der|die|das|den|dem|ein|eine|le|la|les|un|une|el|los|las|una|of))\s+$")
_MEETS = re.compile(r"(?i:thanks to|\bmet|\basked|\bi am|i'm|\btold)\s+$")
_MEETS = re.compile(r"(?i:thanks to|\bmet|\basked|\bi am|i'm|\btold)\s+$")
_AFTER = re.compile(r"(?i:\s+(?:said|says|wrote|told|asked|lives|promised|keeps|replied|called|wohnt|sagt|habite|vive|a répondu|respondió|from support)\b|,\s+(?:my|our)\b)")


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return bool(digits) and total % 10 == 0


def mod97(number: str) -> bool:
    """French identity number of 15 digits: the last two are 97 minus the rest's remainder."""
    return len(number) == 15 and number.isdigit() and 97 - int(number[:13]) % 97 == int(number[13:])


def _mod11_10(number: str) -> bool:
    product = 10
    for digit in number[:-1]:
        product = 2 * ((int(digit) + product) % 10 or 10) % 11
    return len(number) == 11 and (11 - product) % 10 == int(number[-1])


def _spanish(text: str) -> bool:
    match = re.fullmatch(r"([XYZ]?)(\d{7,8})([A-Z])", text)
    return bool(match) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(str("XYZ".find(match[1]) if match[1] else "") + match[2]) % 23] == match[3]


def _snils(number: str) -> bool:
    return len(number) == 11 and sum(int(d) * (9 - i) for i, d in enumerate(number[:9])) % 101 % 100 == int(number[9:])


def checksum_ok(text: str) -> bool:
    """Whether the text passes the check of some identity number."""
    bare = re.sub(r"[ .-]", "", text)
    if _spanish(bare):
        return True
    return bare.isdigit() and (mod97(bare) or (len(bare) == 11 and (_mod11_10(bare) or _snils(bare))) or (len(bare) == 9 and luhn(bare)))


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


@dataclass(frozen=True)
class Ordinary:
    """What texts tell of words: the usual ones with their share of the texts; of all words that are no listed names, their number and how many have each run of letters."""

    usual: tuple[tuple[str, float], ...] = ()
    runs: tuple[tuple[str, int], ...] = ()
    words: int = 0

    @staticmethod
    def of(shares: tuple[tuple[str, float], ...], listed: set[str]) -> Ordinary:
        """From every word with its share."""
        plain = {w for w, _ in shares} - listed
        return Ordinary(tuple(shares), tuple(Counter(g for w in plain for g in letter_runs(w)).items()), len(plain))


def letter_runs(word: str) -> set[str]:
    """The word's runs of two to four letters, its start and end among them."""
    word = f"^{word}$"
    return {word[i : i + n] for n in (2, 3, 4) for i in range(len(word) - n + 1)}


class Likeness:
    """How much a word resembles the known names of a kind, by its runs of two to four letters.

    A naive Bayes model of listed names against ordinary words, per letter of the word.
    Of the words it takes their number and how many of them have a run.
    """

    def __init__(self, names: list[str], usual: Counter, words: int):
        self.seen, self.usual, self.words = Counter(g for w in names for g in letter_runs(w)), usual, words
        self.names, self.few, self.many = frozenset(names), len(names) + 1.0, words + 1.0

    def __call__(self, word: str) -> float:
        """The model's log odds; a listed name is judged by the others."""
        if not self.names or not self.words:
            return 0.0
        own, odds = word in self.names, 0.0
        for g in letter_runs(word):
            seen, usual = self.seen[g] - own, self.usual[g]
            if seen or usual > FEW:
                odds += math.log((seen + 0.5) / self.few) - math.log((usual + 0.5 * self.many / self.few) / self.many)
        return odds / max(1, len(word))


#: Likeness from which an unlisted word may be a name in good company, in some, and in little.
SOME_LIKE, LIKE, VERY_LIKE = 0.7, 1.5, 3.0
#: Share of texts from which an unlisted word is no name, and from which a listed one may be a word of the language.
USUAL, COMMON = 0.001, 0.004
#: Words up to which a run of letters that no listed name has says nothing.
FEW = 3
#: Words whose scores, and runs of letters whose counts, a Python worker keeps.
KEPT_WORDS, KEPT_RUNS = 200_000, 200_000
_TOKEN = re.compile(r"[^\W\d_]{2,}")
_INITIAL = re.compile(r"\s+[A-ZÀ-ÞА-ЯЁ]\.")
_INITIALS_BEFORE = re.compile(r"(?<![\w@./+%-])(?:[A-ZÀ-ÞА-ЯЁ]\.\s?){1,2}\s*$")
_TITLE_BEFORE = re.compile(rf"(?<![\w@./+%-]){_TITLE}$")
_ENDS = re.compile(rf"(?![\w@]|[-.+]\w|\s+(?:{_COMPANY})\b)")
_TITLE_WORD = re.compile(_TITLE.replace(r"\.?\s+", ""))
_BETWEEN = re.compile(r"(?:\s+[A-ZÀ-ÞА-ЯЁ]\.)?\s+")
_STARTS = frozenset("@./+%-_")


class Finder:
    """Finds personal information, given the known names as (name, kind), and ordinary words to tell names from."""

    def __init__(self, known: tuple[tuple[str, str], ...], ordinary: Ordinary | tuple[tuple[str, float], ...] = ()):
        self.listed = listed_names(known)
        if not isinstance(ordinary, Ordinary):
            ordinary = Ordinary.of(ordinary, set().union(*self.listed.values()))
        self.usual, self.common = (frozenset(w for w, share in ordinary.usual if share > least) for least in (USUAL, COMMON))
        runs = Counter(dict(ordinary.runs))
        self.like = {kind: Likeness(sorted(names), runs, ordinary.words) for kind, names in self.listed.items()}
        # Where the listed names resemble each other, one that doesn't is likely to be a word too.
        self.alike = {kind: bool(names) and sorted(map(self.like[kind], names))[len(names) // 2] >= LIKE for kind, names in self.listed.items()}
        self.cached: dict[str, tuple[float, float, bool]] = {}

    def _word(self, word: str) -> tuple[float, float, bool]:
        """(as a given name, as a family name, unsure): what a word by itself says, whether it needs company."""
        out = self.cached.get(word)
        if out is None:
            if len(self.cached) >= KEPT_WORDS:
                self.cached.clear()
            low, values, unsure = word.lower(), [], False
            for kind in ("given", "family"):
                alike = self.like[kind](low) if len(low) > 3 else 0.0
                if low in self.listed[kind]:
                    # A listed name that is also a usual word, or unlike the other names, says little by itself.
                    doubt = low in self.common or (self.alike[kind] and alike < SOME_LIKE) or (not self.usual and kind == "given" and len(low) < 5)
                    unsure |= doubt
                    values.append(0.2 if doubt else 0.6 if alike >= LIKE or not self.alike[kind] else 0.5)
                elif low in self.usual or alike < SOME_LIKE:
                    values.append(0.0)
                else:
                    values.append(0.5 if alike >= VERY_LIKE else 0.4 if alike >= LIKE else 0.25)
            out = self.cached[word] = (values[0], values[1], unsure)
        return out

    def _names(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the names in a text: words that are or resemble known names, in the company of others, of titles, initials and context."""
        found, past = [], 0
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        for i, (start, end, word) in enumerate(tokens):
            given, family, unsure = self._word(word)
            if start < past or (start and text[start - 1] in _STARTS) or _TITLE_WORD.fullmatch(word):
                continue
            before = text[max(0, start - 24) : start] if given or family or word[0].isupper() else ""
            title = _TITLE_BEFORE.search(before) if before and word[0].isupper() else None
            capital = word[0].isupper()
            sure = bool(before) and bool(_SURELY.search(before))
            if not (given or family or title or (sure and capital)):
                continue
            best = None
            initials = None if title else _INITIALS_BEFORE.search(before)
            if i + 1 < len(tokens):
                after, stop, other = tokens[i + 1]
                gap, (given2, family2, _) = text[end:after], self._word(other)
                same = word.islower() == other.islower()
                straight = same and (gap.isspace() or (_INITIAL.match(gap) and gap[_INITIAL.match(gap).end() :].isspace()))
                alone = unsure and other.islower() and other.lower() not in self.listed["family"]  # an ordinary word before another
                if straight and given and family2 and not alone:
                    both = word.lower() in self.listed["given"] and other.lower() in self.listed["family"]
                    best = (stop, given + family2 + (0.4 if both else 0.2))
                elif same and (gap.isspace() or gap.strip() == "," and gap[0] == ",") and family and given2 and (gap.isspace() or max(family, given2) >= 0.5 or min(family, given2) >= 0.4):
                    best = (stop, family + given2 + 0.2)
                elif straight and capital and other[0].isupper() and sure and not _ENDS.match(text, end) is None and (given or family or given2 or family2 or _plain_name(word, other)):
                    best = (stop, 0.6)
                if best and max(given, family) < 0.4 and i + 2 < len(tokens):
                    given3, family3, _ = self._word(tokens[i + 2][2])
                    if _BETWEEN.fullmatch(text, stop, tokens[i + 2][0]) and (given2 >= 0.4 and family3 >= 0.4 or family2 >= 0.4 and given3 >= 0.4):
                        continue  # the two after it are the better pair
                if best and best[1] < 0.75 and not sure:
                    best = None  # two words that resemble names in part
                if best and (not _ENDS.match(text, best[0]) or "\n\n" in gap):
                    best = None
                if best and gap.lstrip().startswith(",") and (more := _INITIAL.match(text, best[0])):
                    best = (more.end(), best[1])
            if best is None:
                if not _ENDS.match(text, end):
                    continue
                score = max(given, family, 0.1 if capital else 0.0)
                listed = word.lower() in self.listed["given"] or word.lower() in self.listed["family"]
                score += (0.5 if title else 0.0) + (0.3 if initials and family else 0.0) + (0.1 if capital else 0.0 if listed else -0.3)
                if not title and _THING.search(before) and not sure:
                    score -= 0.5
                if sure and capital and not (given or family) and word[1:].islower() and text[end : end + 1] in ("", ".", ",", "\n", ";", ")"):
                    score += 0.4
                if capital and (given or family):
                    score += 0.4 if sure else 0.1 if not unsure and (_PERHAPS.search(before) or _AFTER.match(text, end)) else 0.3 if unsure and _MEETS.search(before) else 0.0
                stop = end
                if given and (more := _INITIAL.match(text, end)) and not text[more.end() : more.end() + 1].isalnum():
                    stop = more.end()
                best = (stop, score)
            if best[1] >= THRESHOLD - 1e-9:
                begin = start - len(title.group()) if title else start - len(initials.group()) if initials and family and best[0] == end else start
                begin = begin if begin >= past else start
                found.append((begin, best[0], min(1.0, best[1])))
                past = best[0]
        return found

    def spans(self, text: str) -> list[Span]:
        """Spans in text order; a null or empty text has none."""
        if not text:
            return []
        found, rest = [], text

        def take(start: int, end: int, kind: str, score: float) -> None:
            nonlocal rest
            found.append(Span(start, end, kind, score))
            rest = rest[:start] + "\0" * (end - start) + rest[end:]

        for match in _EMAIL.finditer(text):
            take(*match.span(), "email", 1.0)
        if any(c.isdigit() for c in rest):
            for match in list(_ADDRESS.finditer(rest)):
                take(*match.span(), "address", 0.9)
            for match in list(_ID.finditer(rest)):
                if (score := self._id_score(rest, match)) >= THRESHOLD:
                    take(*self._trimmed(rest, match), "id_number", score)
        for pattern, base in _PHONES:
            for match in list(pattern.finditer(rest)):
                if (score := self._phone_score(rest, match, base)) >= THRESHOLD:
                    take(*self._trimmed(rest, match), "phone", score)
        for start, end, score in self._names(rest):
            take(start, end, "name", score)
        return sorted(found, key=lambda s: s.start)

    @staticmethod
    def _trimmed(text: str, match: re.Match) -> tuple[int, int]:
        start, end = match.span()
        while text[start] in " .-":
            start += 1
        return start, end

    @staticmethod
    def _id_score(text: str, match: re.Match) -> float:
        before, after = text[max(0, match.start() - 40) : match.start()], text[match.end() : match.end() + 55]
        # The clause before the number says what it is, not the sentence before that.
        clause = re.split(r"(?<=[a-zа-я]{3})[.!?]\s|\n", before)[-1]
        score = 0.3 + 0.2 * checksum_ok(match.group()) + 0.3 * bool(_SSN.fullmatch(match.group().strip()))
        score += 0.5 * bool(_ID_BEFORE.search(clause) or _ID_AFTER.search(re.split(r"[.!?]\s|\n", after)[0]))
        return score - 0.6 * bool(_OTHER_NUMBER.search(clause))

    @staticmethod
    def _phone_score(text: str, match: re.Match, base: float) -> float:
        clause = re.split(r"(?<=[a-zа-я]{4})[.!?]\s|\n", text[max(0, match.start() - 45) : match.start()])[-1]
        digits = sum(c.isdigit() for c in match.group())
        if digits and not 8 <= digits <= 20:
            return 0.0
        return base + 0.4 * bool(_PHONE_BEFORE.search(clause)) - 0.5 * bool(_OTHER_NUMBER.search(clause))

    def redacted(self, text: str | None) -> str | None:
        """The text with every span replaced by its kind in brackets."""
        out, at = [], 0
        for span in self.spans(text):
            out += [text[at : span.start], f"[{span.kind.upper()}]"]
            at = span.end
        return text if not out else "".join(out) + text[at:]


@functools.lru_cache(2)
def finder(known: tuple[tuple[str, str], ...], ordinary: Ordinary | tuple[tuple[str, float], ...] = ()) -> Finder:
    return Finder(known, ordinary)


def _plain_name(first: str, last: str) -> bool:
    """Two words in the shape of a name: a capital, then small letters."""
    return first[1:].islower() and last[1:].islower()


def known_names(names: DataFrame) -> tuple[tuple[str, str], ...]:
    """The reference list of names: a fixed list of some hundreds that every task gets."""
    return tuple(sorted((r["person_name"], r["name_kind"]) for r in names.select("person_name", "name_kind").where("person_name is not null").collect()))


def listed_names(known: tuple[tuple[str, str], ...]) -> dict[str, set[str]]:
    """The known names of each kind, in lower case."""
    return {kind: {n.lower() for n, k in known if k == kind and n} for kind in ("given", "family")}


def ordinary_words(texts: DataFrame, known: tuple[tuple[str, str], ...]) -> Ordinary:
    """The words, in lower case, of all distinct texts.

    Each word is counted over every text and its runs of letters over every word. The driver
    gets what the finder asks for: words in a share of over USUAL of the texts, which are at
    most a text's mean number of words / USUAL, and runs that over FEW words or listed names have.
    """
    spark = ship_package(texts.sparkSession)
    scratch, listed = Scratch(spark, "words"), frozenset().union(*listed_names(known).values())
    named = frozenset(g for name in listed for g in letter_runs(name))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    every = F.explode(F.array_append(words, F.lit(""))).alias("word")  # the empty word counts the texts
    counts = scratch.save(texts.where("text <> ''").select("text").distinct().select(every).groupBy("word").count(), "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def row() -> pa.RecordBatch:
            columns = [pa.array(list(found), pa.string()), pa.array([g in named for g in found], pa.bool_()), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["run", "named", "count"])

        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word not in listed:
                    found[""] += 1  # the empty run counts the words
                    found.update(letter_runs(word))
            if len(found) >= KEPT_RUNS:
                yield row()
                found.clear()
        yield row()

    total = sum(r["count"] for r in counts.where("word = ''").collect())
    usual = counts.where("word <> ''").where(F.col("count") / max(1, total) > USUAL).collect()
    runs = counts.where("word <> ''").select("word").mapInArrow(run, "run string, named boolean, count bigint").groupBy("run", "named").agg(F.sum("count").alias("count"))
    runs = {r["run"]: r["count"] for r in runs.where(F.col("named") | (F.col("run") == "") | (F.col("count") > FEW)).select("run", "count").collect()}
    scratch.close()
    many = runs.pop("", 0)
    return Ordinary(tuple(sorted((r["word"], r["count"] / total) for r in usual)), tuple(sorted(runs.items())), many)


def find_pii(texts: DataFrame, known: tuple[tuple[str, str], ...], ordinary: Ordinary | tuple[tuple[str, float], ...] = ()) -> DataFrame:
    """(field_name, record_id, pii_kind, seq): one row for each occurrence in texts (field_name, record_id, text).

    seq counts the occurrences of a kind within a record in text order from 1. Null, empty
    and clean texts give nothing; a text that is repeated gives its rows once; a record with
    several texts gives the rows of each. Long texts are read whole. Rows with a null
    record_id are ignored.
    """
    ship_package(texts.sparkSession)
    distinct = texts.where("text <> '' and record_id is not null").select("field_name", "record_id", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder(known, ordinary).spans
        for batch in batches:
            fields, records, kinds, numbers = [], [], [], []
            for field, record, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                count = Counter()
                for span in spans(text):
                    count[span.kind] += 1
                    fields.append(field)
                    records.append(record)
                    kinds.append(span.kind)
                    numbers.append(count[span.kind])
            columns = [pa.array(fields, pa.string()), pa.array(records, pa.string()), pa.array(kinds, pa.string()), pa.array(numbers, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["field_name", "record_id", "pii_kind", "seq"])

    return distinct.mapInArrow(run, "field_name string, record_id string, pii_kind string, seq int").distinct()


def redact(texts: DataFrame, known: tuple[tuple[str, str], ...], ordinary: Ordinary | tuple[tuple[str, float], ...] = ()) -> DataFrame:
    """(field_name, record_id, text) with placeholders; null and empty texts stay as they are, repeated rows are repeated."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redacted = finder(known, ordinary).redacted
        for batch in batches:
            text = pa.array([redacted(t) for t in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["field_name", "record_id", "text"])

    return texts.select("field_name", "record_id", "text").mapInArrow(run, "field_name string, record_id string, text string")
