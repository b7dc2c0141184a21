"""Problem 10: visually identical text with different characters comes out in one form.

Method: the words of a text, as written, traverse a trie of the corpus's own spellings, as
written, with a weighted edit automaton. Look-alike letters, wide forms, ligatures, loose
accents and characters without a shape cost nothing; readings that only the vocabulary can
settle (1 or l or I, rn or m) cost little and are tried in words that can't be meant as they
stand; all else is a real edit and costs more than any budget. The commonest spelling reached
at the least cost is the canonical one; only a word that reaches none is normalised by table.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import ship_package

# Letters that look like the one on the right.
LOOKALIKES = {
    "Cyrillic": ("аеорсухѕіјһԁԛԝүӏАВЕКМНОРСТХЅІЈҮԌԚԜӀ", "aeopcyxsijhdqwylABEKMHOPCTXSIJYGQWI"),
    "Greek": ("ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳ", "ovpABEZHIKMNOPTYXj"),
    "Latin": ("ɡǀ", "gl"),
    "Armenian": ("օհցսՕ", "ohguO"),
}
# Hyphens that differ from the plain one in breaking only, ligatures, spaces, line breaks.
HYPHENS = "‐‑"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}
SPACES = "               　"
BREAKS = "\r\u0085  "
# Readings that differ in little, as (seen, meant); a word's vocabulary tells which is meant.
DOUBTFUL = (("1", "l"), ("1", "I"), ("l", "I"), ("l", "1"), ("I", "l"), ("I", "1"), ("0", "O"), ("0", "o"), ("O", "0"), ("o", "0"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"))
# Fixed value: characters without a shape. A joiner between emoji makes another emoji and stays.
_EMOJI = r"\p{Extended_Pictographic}"
IGNORABLE = regex.compile(
    r"[­͏᠎​‌‎‏⁠-⁤﻿]"
    rf"|‍(?!{_EMOJI})|(?<![{_EMOJI}️\U0001F3FB-\U0001F3FF])‍"
)
#: Spellings the automaton can reach: the corpus's commonest words.
VOCABULARY = 20_000
#: Words kept by a Python worker.
KEPT_WORDS = 200_000
#: What a doubtful reading and a real edit cost, and what a word may spend: two doubts, never an edit.
DOUBT, EDIT, BUDGET = 1, 8, 2

_FOLD = {ord(a): b for odd, plain in LOOKALIKES.values() for a, b in zip(odd, plain, strict=True)}
_SHAPELESS = "\u00ad\u034f\u180e\u200b-\u200f\u2060-\u2064\ufeff"
# Letters and digits with what hides between them: loose accents, characters without a shape, joiners.
_WORD = re.compile(rf"[^\W_](?:[^\W_]|[\u0300-\u036f{_SHAPELESS}])*")
# A word that can't be meant as it stands: a digit that passes for a letter between or after three letters, a capital I amid small ones.
_DOUBTED = re.compile(r"(?=.*[^\W\d_]{2})(?=(?:[\d]*[^\W\d_]){3})(?:.*[^\W\d_][01]|.*[01][^\W\d_]|.*[a-z]I[a-z])")


def _wide_forms() -> dict[str, str]:
    """Wide and narrow forms by their Unicode decomposition, and the other characters with a plain twin."""
    table = {}
    for code in range(0xFF00, 0xFFF0):
        kind, _, plain = unicodedata.decomposition(chr(code)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            table[chr(code)] = "".join(chr(int(c, 16)) for c in plain.split())
    table |= dict.fromkeys(SPACES, " ") | dict.fromkeys(BREAKS, "\n") | dict.fromkeys(HYPHENS, "-")
    return table | LIGATURES


_PLAIN = _wide_forms()
_UNPLAIN = re.compile("[" + "".join(map(re.escape, sorted(_PLAIN))) + "]")


def plain(text: str) -> str:
    """Without ignorables, wide forms, ligatures and odd spaces, accents composed; letters keep their script."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else unicodedata.normalize("NFC", _UNPLAIN.sub(lambda m: _PLAIN[m.group()], IGNORABLE.sub("", text)))


def by_table(word: str) -> str:
    """The form that all words share that look like this one, whatever the vocabulary."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", plain(word)).translate(_FOLD))


@functools.lru_cache(100_000)
def shape(char: str) -> str:
    """What a character shows: nothing, or plain letters and their accents, look-alikes as one."""
    return unicodedata.normalize("NFD", plain(char)).translate(_FOLD)


class _Place:
    """A place in the trie: the spelling that ends here, and the ways on by the first thing they show."""

    __slots__ = ("ends", "ways")

    def __init__(self):
        self.ends: tuple[int, str] | None = None
        self.ways: dict[str, list[tuple[str, _Place]]] = {}


class SpellingTrie:
    """Spellings as written, with their counts, found from whatever looks like them."""

    def __init__(self, counts: dict[str, int]):
        self.root, made = _Place(), {}
        for word, count in counts.items():
            place = self.root
            for char in word:
                below = made.get((id(place), char))
                if below is None:
                    below, shown = _Place(), shape(char)
                    made[id(place), char] = below
                    place.ways.setdefault(shown[:1], []).append((shown, below))
                place = below
            place.ends = (count, word)

    def reach(self, word: str, budget: int = 0) -> list[tuple[int, int, str]]:
        """(cost, count, spelling) of every spelling within the budget, each at its least cost.

        A state of the automaton is a place in the trie, a place in the word, and what the
        word has shown and the trie not yet matched. Reading a character of either side is
        free, a doubtful reading costs DOUBT, leaving out or adding a shown one costs EDIT.
        """
        word = word if word.isascii() else unicodedata.normalize("NFC", word)
        found, states, seen = {}, [(0, self.root, 0, "")], set()
        while states:
            cost, place, at, rest = states.pop()
            while at < len(word) and len(rest) < 4:  # no character shows more than four
                rest, at = rest + shape(word[at]), at + 1
            if budget:
                state = (cost, id(place), at, rest)
                if state in seen:
                    continue
                seen.add(state)
            if not rest:
                if place.ends and cost < found.get(place.ends[1], (budget + 1,))[0]:
                    found[place.ends[1]] = (cost, place.ends[0])
            else:
                states += [(cost, below, at, rest[len(shown) :]) for shown, below in place.ways.get(rest[0], ()) if rest.startswith(shown)]
                if cost + DOUBT <= budget:
                    for seen_as, meant in DOUBTFUL:
                        if rest.startswith(seen_as):
                            states.append((cost + DOUBT, place, at, meant + rest[len(seen_as) :]))
                if cost + EDIT <= budget:
                    states.append((cost + EDIT, place, at, rest[1:]))
            if cost + EDIT <= budget:
                states += [(cost + EDIT, below, at, rest) for ways in place.ways.values() for _, below in ways]
        return [(cost, count, spelling) for spelling, (cost, count) in found.items()]

    def canonical(self, word: str) -> str:
        """The commonest spelling among those of the least cost, ties by code points; else the word's table form.

        A word that may stand as it is reaches its look-alikes only. Doubtful readings settle
        a word only if all spellings of the least cost look the same. What decides is what
        the word shows, so words that look the same come out the same.
        """
        form = by_table(word)
        reached = self.reach(word) or (self.reach(form, BUDGET) if len(form) > 3 and _DOUBTED.match(form) else [])
        least = min((r[0] for r in reached), default=0)
        best = [r for r in reached if r[0] == least]
        if not best or (least and len({by_table(r[2]) for r in best}) > 1):
            return form
        return min(best, key=lambda r: (-r[1], r[2]))[2]


class Normalizer:
    """Canonical form of whole texts; keeps the words met."""

    def __init__(self, spellings: tuple[tuple[str, int], ...]):
        self.trie, self.known = SpellingTrie(dict(spellings)), {}

    def word(self, match: re.Match) -> str:
        word = match.group()
        out = self.known.get(word)
        if out is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            out = self.known[word] = word if word.isdecimal() and word.isascii() else self.trie.canonical(word)
        return out

    def text(self, text: str) -> str:
        """The text with every word in its canonical spelling and the rest by table; an empty text stays empty."""
        return plain(_WORD.sub(self.word, text))


@functools.lru_cache(2)
def normalizer(spellings: tuple[tuple[str, int], ...]) -> Normalizer:
    return Normalizer(spellings)


def spellings(documents: DataFrame, text: str, size: int = VOCABULARY) -> tuple[tuple[str, int], ...]:
    """(word, count): the commonest words met more than once, counted over all texts; at most `size` come to the driver.

    Words written with ignorables, wide forms, ligatures, loose accents or letters of two
    scripts are disguises and no spellings; nor are numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # counted within a batch before anything is shuffled
            counts = Counter()
            for value in batch.column(0):
                counts.update(_WORD.findall(value.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "count"])

    words = documents.select(text).where(F.col(text).isNotNull()).mapInArrow(run, "word string, count bigint")
    odd = r"[\p{M}\p{Cf}\x{ff00}-\x{ffef}\x{fb00}-\x{fb06}\x{212a}\x{212b}\x{0261}\x{01c0}]|^\P{L}+$"
    mixed = r"\p{IsLatin}.*[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]|[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}].*\p{IsLatin}"
    counts = words.groupBy("word").agg(F.sum("count").alias("count")).where("count > 1").where(~F.col("word").rlike(odd) & ~F.col("word").rlike(mixed))
    top = counts.orderBy(F.desc("count"), "word").limit(size).collect()
    return tuple((row["word"], row["count"]) for row in top)


def normalize(documents: DataFrame, key: str, text: str, spellings: tuple[tuple[str, int], ...]) -> DataFrame:
    """(key, text, canonical): a null text stays null, an empty one empty; repeated rows are repeated."""
    kind = documents.schema[key].dataType.simpleString()
    shared = ship_package(documents.sparkSession).sparkContext.broadcast(spellings)  # at most VOCABULARY words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_form = normalizer(shared.value).text
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                forms = pa.array([None if t is None else to_form(t) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), forms], names=[key, text, "canonical"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, {text} string, canonical string")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def text_forms(documents: DataFrame, key: str, text: str, longer_than: int, spellings: tuple[tuple[str, int], ...]) -> DataFrame:
    """(key, raw, form): 128-bit digests of every text with more than `longer_than` characters and of its canonical form."""
    kind = documents.schema[key].dataType.simpleString()
    shared = ship_package(documents.sparkSession).sparkContext.broadcast(spellings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_form = normalizer(shared.value).text
        for batch in batches:
            texts = batch.column(1).to_pylist()
            raw, form = pa.array([_digest(t) for t in texts], pa.binary()), pa.array([_digest(to_form(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, form], names=[key, "raw", "form"])

    long = documents.select(key, text).where(F.char_length(text) > longer_than)
    return long.mapInArrow(run, f"{key} {kind}, raw binary, form binary")


#: Up to this many exact copies a text's documents are paired one by one, beyond through the smallest id.
COPIES_PAIRED = 64


def identical_looking(forms: DataFrame, key: str, copies: int | None = COPIES_PAIRED) -> DataFrame:
    """(key_a, key_b), smaller first: documents whose texts look the same but differ in characters.

    Documents with the very same text are no pair. Every document of a text is paired with
    every document of each look-alike text; where a text has over `copies` copies, they
    are paired with the smallest id of the other text (and its few copies), so that copies
    cost in proportion to their number and no link between different texts is lost. With
    copies=None every pair is given; looking_members gives the rest by membership.
    """
    varied = forms.groupBy("form").agg(F.min("raw").alias("_low"), F.max("raw").alias("_high")).where("_low <> _high").select("form")
    some = forms.join(varied, "form", "left_semi")
    texts = some.groupBy("form", "raw").agg(F.count("*").alias("_copies"), F.min(key).alias("_first"))
    some = some.join(texts, ["form", "raw"])
    chosen = some if copies is None else some.where((F.col("_copies") <= copies) | (F.col(key) == F.col("_first")))
    a = chosen.select("form", F.col("raw").alias("raw_a"), F.col(key).alias("x"))
    b = some.select("form", F.col("raw").alias("raw_b"), F.col(key).alias("y"))
    pairs = a.join(b, "form").where("raw_a <> raw_b")
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def looking_members(forms: DataFrame, key: str) -> DataFrame:
    """(key, text_key, look_key): one row for each document of forms; the smallest key of its very text and of its look.

    With it every pair of documents that look the same is known, however many copies a text has.
    """
    texts = forms.groupBy("form", "raw").agg(F.min(key).alias("text_key"))
    looks = texts.groupBy("form").agg(F.min("text_key").alias("look_key"))
    return forms.join(texts.join(looks, "form"), ["form", "raw"]).select(key, "text_key", "look_key")
