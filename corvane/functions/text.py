"""Tokens, entities, shingles, similarities and fingerprints of titles."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# English and Russian words that carry no topic.
STOPWORDS_EN = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might must can "
    "this that these those i you he she it we they what which who whom when where why how not no nor as if then than too very just about above after again "
    "all also am any because before between both each few more most other some such only own same so into over under until up out off down here there once during while its"
)
STOPWORDS_RU = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть "
    "был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет "
    "тогда кто этот того потому этого какой ним этом мой тем чтобы нее были куда зачем всех можно при об этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между"
)
STOPWORDS = f"{STOPWORDS_EN} {STOPWORDS_RU}"
# Publisher names that end a title.
PUBLISHERS = "the new york times|new york times|nyt|the washington post|washington post|wapo|the verge|verge|bbc|the guardian|guardian|reuters|financial times|ft|techcrunch|tech crunch|ars technica|wired|usa today|fox business|american banker|medium|time|vanity fair|the new yorker|new yorker|fox news"
# Beginnings of titles that say nothing of their own.
GENERIC_TITLES = ["opinion", "analysis", "live", "live updates", "latest news", "top stories", "morning briefing", "newsletter", "sign up", "methodology", "tech life", "tech now", "podcast", "breaking", "breaking news", "updated", "update", "exclusive"]
# Patterns of titles of listings, threads and newsletters.
LOW_SIGNAL = [
    r"^sign\s+up", r"^subscribe", r"^newsletter", r"\bmethodology\b", r"\bbest\s+(?:private\s+)?companies\s+\d{4}\b", r"^tech\s+life$", r"^tech\s+now$", r"^morning\s+briefing",
    r"\b(?:daily|weekly|monthly)\s+(?:[\w'-]+\s+){0,3}(?:questions?|thread|discussion)\b", r"^moronic\s+monday\b", r"^who's\s+hiring\b", r"^who\s+is\s+hiring\b", r"\bhiring\s+thread\b", r"\bopen\s+thread\b",
    r"^podcast", r"^live\s+updates?$", r"^latest\s+news$", r"^top\s+stories$", r"^top\b.*\bnews\b.*\btrends\b", r"^breaking\s+news?$",
]
# Fixed value: capitalised names, numbers with units, amounts of money, acronyms.
ENTITY = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)*|\b\d+(?:\.\d+)?(?:%|bn|mn|m|b|k)?\b|\$[\d,.]+(?:bn|mn|m|b)?\b|\b[A-Z]{2,}\b)"
# Entities that anchor nothing, and anchors that verify no story.
GENERIC_ENTITIES = "ai ceo cfo gop uk u.s u.s. us usa"
GENERIC_ANCHORS = ["ai", "agent", "agents", "open source", "startup", "tool", "model", "llm", "company", "app", "platform"]


def _composed(title: Column) -> Column:
    @pandas_udf("string")
    def composed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return composed(title)


def normalized_title(title: Column) -> Column:
    """Lower case, without a publisher's suffix, what follows a bar, addresses, punctuation, stopwords and words under three letters (but ai).

    Before a bar stands the title, unless that part is a generic beginning. A null title is empty.
    """
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), rf"(?:[\s\-–—|]\s*(?:{PUBLISHERS})\s*)+$", "")
    left, right = (F.trim(F.get(F.split(text, r"\|"), F.lit(k))) for k in (0, 1))
    text = F.when(left.isin(GENERIC_TITLES) & (right != ""), right).when(text.contains("|") & (left != ""), left).otherwise(text)
    text = F.regexp_replace(text, r"https?://\S+", "")
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")), " ")
    kept = F.filter(words, lambda w: ((F.char_length(w) >= 3) | (w == "ai")) & ~w.isin(STOPWORDS.split()))
    return F.array_join(kept, " ")


def is_generic(normalized: Column) -> Column:
    """A normalised title that is too general to be matched: a generic beginning or under three words."""
    return normalized.isin(GENERIC_TITLES) | (F.size(F.filter(F.split(normalized, " "), lambda w: w != "")) < 3)


def is_low_signal(title: Column) -> Column:
    """Titles of newsletters, listings, threads and podcasts."""
    return F.lower(F.trim(F.coalesce(title, F.lit("")))).rlike("|".join(LOW_SIGNAL))


def compatible_title(title: Column) -> Column:
    """normalized_title of the compatibility form; only titles outside ASCII travel to Python."""
    return normalized_title(F.when(title.rlike(r"[^\x00-\x7f]"), _composed(title)).otherwise(title))


def tokens(title: Column) -> Column:
    """Distinct informative words in order; empty for a title without any."""
    return F.array_distinct(F.filter(F.split(normalized_title(title), " "), lambda w: w != ""))


def canonical_key(title: Column) -> Column:
    """The first five informative words, in order."""
    return F.array_join(F.slice(F.split(normalized_title(title), " "), 1, 5), " ")


def entities(title: Column) -> Column:
    """Distinct names, numbers, amounts and acronyms in lower case; letters outside ASCII end a word."""
    plain = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\x00-\x7f]", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(ENTITY), F.lit(0)), lambda e: F.lower(e)))


def meaningful_entities(title: Column) -> Column:
    """Entities of two letters or more without those that anchor nothing."""
    return F.filter(entities(title), lambda e: (F.length(e) >= 2) & ~e.isin(GENERIC_ENTITIES.split()))


def is_anchor(entity: Column) -> Column:
    """Whether an entity can anchor a story."""
    return ~F.trim(F.lower(entity)).isin(GENERIC_ANCHORS)


def pulse_tokens(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9'_-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) > 1))


def stem(word: Column) -> Column:
    """ies becomes y, a plain plural loses its s."""
    cut = lambda n: F.substr(word, F.lit(1), F.length(word) - n)
    return F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(cut(3), F.lit("y"))).when(
        word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), cut(1)
    ).otherwise(word)


def shingles(words: Column, n: int) -> Column:
    """Runs of n words; none for shorter texts."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a."""
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for char in b:
        hit = state & where.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Similarity from 0 to 1 of two word sets by their sorted joined forms; 0 if either is empty, 1 if one holds the other."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    shared, only_a, only_b = left & right, left - right, right - left
    if shared and (not only_a or not only_b):
        return 1.0
    s, da, db = (len(" ".join(sorted(shared))), " ".join(sorted(only_a)), " ".join(sorted(only_b)))
    la, lb = s + (s > 0) + len(da), s + (s > 0) + len(db)
    ratio = 1 - (len(da) + len(db) - 2 * _lcs(da, db)) / (la + lb)
    return ratio if not s else max(ratio, 1 - (la - s) / (s + la), 1 - (lb - s) / (s + lb))


def fuzzy_udf():
    """token_set_ratio over Arrow batches, for pairs that blocking has left."""

    @pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def title_shingles(words: Column) -> Column:
    """Distinct runs of three words; of fewer words the words themselves."""
    return F.array_distinct(F.when(F.size(words) < 3, words).otherwise(shingles(words, 3)))


def near_features(words: Column) -> Column:
    """What a title's fingerprint sums: its distinct words and shingles."""
    return F.array_union(title_shingles(words), words)


def min_hashes(words: Column) -> Column:
    """Keys of the four smallest shingle hashes."""
    hashed = F.array_sort(F.transform(title_shingles(words), lambda s: F.xxhash64(s)))
    return F.transform(F.slice(hashed, 1, 4), lambda h: F.concat(F.lit("m:"), h.cast("string")))


def simhash(words: Column) -> Column:
    """64 sign bits of the summed word hashes as a bigint; 0 for no words. Summed over Arrow batches: 64 sums a row are slow as expressions."""

    @pandas_udf("bigint")
    def signs(hashed: pd.Series) -> pd.Series:
        lists = [np.asarray(h if h is not None else [], dtype=np.int64).view(np.uint64) for h in hashed]
        sizes = np.array([len(h) for h in lists])
        out, some = np.zeros(len(lists), dtype=np.uint64), np.flatnonzero(sizes)
        if len(some):
            flat = np.concatenate([lists[k] for k in some])
            bits = (flat[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            votes = np.add.reduceat(bits.astype(np.int32) * 2 - 1, np.r_[0, np.cumsum(sizes[some])[:-1]], axis=0)
            out[some] = ((votes > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return pd.Series(out.view(np.int64))

    return signs(F.transform(words, lambda w: F.xxhash64(w)))


def bands(fingerprint: Column) -> Column:
    """Four 16-bit pieces of a fingerprint, each with its position."""
    return F.array(*(F.concat(F.lit(f"{k}:"), F.pmod(F.shiftrightunsigned(fingerprint, 16 * k), F.lit(65536)).cast("string")) for k in range(4)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, cut at a blank, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", "")
    return F.when(F.char_length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def short_count(n: Column) -> Column:
    """1234 becomes 1.2k."""
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", F.floor(n / 100) / 10), F.lit("k"))).otherwise(n.cast("string"))


def lexical_vectors(rows: DataFrame, key: str, text: str, places: int = 384) -> DataFrame:
    """(key, position, value): hashed lexical vectors of unit length, places that aren't 0; texts without a feature give none.

    Words of two letters count 1, neighbouring different words 1.25, runs of three characters
    without a blank .35; a hash gives each its place and sign.
    """
    plain = F.array_join(F.split(F.trim(F.lower(text)), r"\s+"), " ")
    rows = rows.select(key, plain.alias("_n")).withColumn("_w", F.filter(F.regexp_extract_all("_n", F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2))
    feature = lambda name, weight: F.struct(name.alias("f"), F.lit(weight).alias("v"))
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    word = lambda k: F.get("_w", k - 1)
    twos = F.filter(upto(F.size("_w") - 1), lambda k: word(k) != word(k + 1))
    threes = F.filter(upto(F.char_length("_n") - 2), lambda k: ~F.substr("_n", k, F.lit(3)).contains(" "))
    found = F.concat(
        F.transform("_w", lambda w: feature(F.concat(F.lit("tok:"), w), 1.0)), F.transform(twos, lambda k: feature(F.concat(F.lit("bi:"), word(k), F.lit("_"), word(k + 1)), 1.25)),
        F.transform(threes, lambda k: feature(F.concat(F.lit("tri:"), F.substr("_n", k, F.lit(3))), 0.35)),
    )
    parts = rows.select(key, F.inline(found)).withColumn("h", F.sha2("f", 256))
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    sums = parts.groupBy(key, (F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % places).cast("int").alias("position")).agg(F.sum(sign * F.col("v")).alias("v"))
    lengths = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    return sums.join(lengths, key).where((F.col("l") > 0) & (F.abs("v") > 1e-9)).select(key, "position", (F.col("v") / F.col("l")).alias("value"))
