"""Problem 3: near-duplicate records with small edits.

Method: one-permutation hashing with optimal densification, banded buckets and star-shaped
candidate edges. Every word fills a bin of the signature with its rank, common words with a
later one (a weighted draw); an empty bin copies the bin that its own hash sequence meets
first. Bands of bins are bucket keys. A bucket of any size gives two edges per member: to
the bucket's hub, and to its neighbour in the order of further bins, so a bucket that many
unlike texts share still joins like ones. Edges are verified on the whole word sets; records
that share a verified neighbour are verified too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.components import component_labels
from corvane.runtime import Scratch, ship_package

_EMPTY = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Signature:
    """How word sets become band keys. Equal parameters and word weights give equal keys on any machine."""

    bands: int = 32
    rows: int = 3
    #: Words in more than this share of the texts are drawn less often, down to `least_weight`; none is left out.
    common_share: float = 0.002
    least_weight: float = 0.05
    seed: int = 20_251_104

    @property
    def bins(self) -> int:
        return self.bands * self.rows

    def weight(self, share: float) -> float:
        """Draws of a word in this share of the texts, against 1 for a rare one."""
        return 1.0 if share <= self.common_share else max(self.least_weight, float(np.log(share) / np.log(self.common_share)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _ranks(hashed: np.ndarray, words: np.ndarray, common: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A total order of all words, in which a word's chance to come first follows its weight."""
    low = hashed & np.uint64((1 << 40) - 1)
    waits = -np.log((low.astype(np.float64) + 0.5) / float(1 << 40))
    if len(common):
        at = np.minimum(np.searchsorted(common, words), len(common) - 1)
        waits /= np.where(common[at] == words, weight[at], 1.0)
    # Coarse steps, ties by hash: the last digits of a logarithm may differ between machines.
    return (np.minimum(waits * (1 << 15), (1 << 24) - 2).astype(np.uint64) << np.uint64(40)) | low


def signatures(owner: np.ndarray, words: np.ndarray, n: int, common: np.ndarray, weight: np.ndarray, how: Signature) -> np.ndarray:
    """Bins (n, bins) of n word sets, given as words (uint64) with the number of their set, ascending.

    common: sorted common words, weight: their weights. Every set has a word.
    """
    hashed = _mix(words ^ _mix(np.uint64([how.seed])))
    bins = ((hashed >> np.uint64(40)) % np.uint64(how.bins)).astype(np.int64)
    filled = np.full(n * how.bins, _EMPTY)
    np.minimum.at(filled, owner * how.bins + bins, _ranks(hashed, words, common, weight))
    filled = filled.reshape(n, how.bins)
    signature, step = filled.copy(), 0
    row, col = np.nonzero(filled == _EMPTY)
    while len(row) and step < 64 * how.bins:  # a set with any word ends long before
        step += 1
        probe = _mix(col.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(step)) % np.uint64(how.bins)
        found = filled[row, probe.astype(np.int64)]
        done = found != _EMPTY
        signature[row[done], col[done]] = found[done]
        row, col = row[~done], col[~done]
    return signature


def band_keys(signature: np.ndarray, how: Signature) -> np.ndarray:
    """Keys (n, bands): 40 bits of the band's bins, then 24 of two bins of the next band, in whose order a bucket lies."""
    n = len(signature)
    keys = np.broadcast_to(_mix(np.arange(1, how.bands + 1, dtype=np.uint64)), (n, how.bands)).copy()
    for r in range(how.rows):
        keys = _mix(keys ^ signature[:, r :: how.rows])
    further = np.zeros_like(keys)
    for r in range(min(2, how.rows)):
        further = _mix(further ^ np.roll(signature[:, r :: how.rows], -1, axis=1))
    return (keys & ~np.uint64((1 << 24) - 1)) | (further >> np.uint64(40))


#: Bits of a mark below its parities: the size of the set; sizes from MOST on aren't told apart.
MOST = (1 << 20) - 1


def parities(owner: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers a set, of 64 and 44 parities, the second with the set's size in its low 20 bits.

    Parity i tells whether an odd number of the set's words fall on i. Two sets differ in at
    most as many parities as in words, so a bound on differing words can be tested on them
    without losing any pair.
    """
    at, start = _mix(words + np.uint64(2)) % np.uint64(108), np.searchsorted(owner, np.arange(n))
    low, bit = at < np.uint64(64), np.uint64(1) << (at & np.uint64(63))
    size = np.minimum(np.bincount(owner, minlength=n), MOST).astype(np.uint64)
    second = np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit), start) << np.uint64(20)
    return np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0)), start), second | size


def mark_of(owner: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """64 parities a set, in one number."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (_mix(words + np.uint64(2)) & np.uint64(63)), np.searchsorted(owner, np.arange(n)))


def may_reach(mark_a: Column, size_a: Column, mark_b: Column, size_b: Column, shared: int, of: int) -> Column:
    """False only for sets that can't have shared/of of all their words in common: columns of mark_of and sizes."""
    alike = F.bit_count(mark_a.bitwiseXOR(mark_b)) * (of + shared) <= (size_a + size_b) * (of - shared)
    return alike & (F.least(size_a, size_b) * of >= F.greatest(size_a, size_b) * shared)


def words_of(text: Column) -> Column:
    """The distinct words of a text as sorted 64-bit hashes: lower-cased maximal runs of letters and digits."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))  # compiled, as array_sort is not


def set_digest(words: Column) -> tuple[Column, Column]:
    """Two 64-bit digests that together stand for a word set."""
    return F.xxhash64(words), F.xxhash64(F.lit("second"), words)


def word_weights(sets: DataFrame, words: str, total: int, how: Signature) -> list[tuple[int, float]]:
    """(word, weight) of the words in more than common_share of all sets, counted over all of them.

    At most mean set size / common_share words can be that common, at any size of the data.
    """
    counts = sets.select(F.explode(words).alias("word")).groupBy("word").count()
    rows = counts.where(F.col("count") > how.common_share * total).collect()
    return sorted((r["word"] % 2**64, how.weight(r["count"] / total)) for r in rows)


def unpacked(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, words, n) of a column of word lists."""
    lists = batch.column(at)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), flat, batch.num_rows


def _may_reach(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], shared: int, of: int) -> np.ndarray:
    """may_reach for arrays of parities."""
    low = np.uint64(MOST)
    size_x, size_y = ((v[1] & low).astype(np.int64) for v in (x, y))
    differ = np.bitwise_count(x[0] ^ y[0]).astype(np.int64) + np.bitwise_count((x[1] ^ y[1]) >> np.uint64(20))
    alike = (differ * (of + shared) <= (size_x + size_y) * (of - shared)) & (np.minimum(size_x, size_y) * of >= np.maximum(size_x, size_y) * shared)
    return alike | (np.maximum(size_x, size_y) == MOST)


def bucket_rows(sets: DataFrame, key: str, words: str, weights: list[tuple[int, float]], shared: int, of: int, how: Signature) -> DataFrame:
    """(bucket, a, first, second): a set in a bucket with its parities; or an edge from a to `first` found within an Arrow batch, second 0.

    Of the members of a bucket that meet in a batch, those whose parities are close to the
    hub's are linked to it and to each other here and stay out of the bucket, so a group
    of near-copies that holds a third of all sets sends few rows per batch.
    """
    context = ship_package(sets.sparkSession).sparkContext
    table = context.broadcast((np.array([w for w, _ in weights], dtype=np.uint64), np.array([c for _, c in weights])))  # see word_weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, flat, n = unpacked(batch, 1)
            bucket = band_keys(signatures(owner, flat, n, *table.value, how), how).ravel()
            sizes, (low, high), row = np.bincount(owner, minlength=n), parities(owner, flat, n), np.repeat(np.arange(n), how.bands)
            order = np.argsort(bucket)
            bucket, row = bucket[order], row[order]
            first = np.flatnonzero(np.r_[True, (bucket[1:] ^ bucket[:-1]) >> np.uint64(24) != 0])
            group = np.diff(np.r_[first, len(bucket)])
            hub = np.repeat(row[first], group)
            # Half the words that may differ, so that who stays out is near to the hub for sure.
            differ = np.bitwise_count(low[row] ^ low[hub]).astype(np.int64) + np.bitwise_count((high[row] ^ high[hub]) >> np.uint64(20))
            close = (differ * 2 * (of + shared) <= (sizes[row] + sizes[hub]) * (of - shared)) & (hub != row)
            near = np.flatnonzero(close)
            before = near[close[near - 1] & (hub[near] == hub[near - 1])]
            stay = np.flatnonzero(~close)
            a = np.r_[ids[row[stay]], ids[hub[near]], ids[row[before - 1]]]
            b = np.r_[ids[row[near]], ids[row[before]]].view(np.uint64)
            place = np.r_[bucket[stay], _mix(b)]  # edges need no bucket any more
            columns = [place, a.view(np.uint64), np.r_[low[row[stay]], b], np.r_[high[row[stay]], np.zeros(len(b), dtype=np.uint64)]]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["bucket", "a", "first", "second"])

    return sets.select(key, words).mapInArrow(run, "bucket bigint, a bigint, first bigint, second bigint")


def star_edges(buckets: DataFrame, shared: int, of: int) -> DataFrame:
    """Distinct (a, b), a < b, from the rows of bucket_rows: a member with its hub and with the one before it in the bucket's order.

    Pairs whose parities rule them out are left out. A bucket streams through one task in
    sorted order; only its hub and the last member are kept in mind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((4, 0), dtype=np.int64)  # the hub and the last member of the bucket under way
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            edge = rows[3] == 0
            found, rows = [rows[1:3, edge]], rows[:, ~edge]
            if rows.shape[1]:
                skip, rows = kept.shape[1], np.concatenate([kept, rows], axis=1)
                place = rows[0] >> 24
                first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                hub = np.repeat(first, np.diff(np.r_[first, len(place)]))
                marks = rows[2].view(np.uint64), rows[3].view(np.uint64)
                at = np.arange(skip, len(place))
                for other in (hub[at], np.maximum(at - 1, hub[at])):
                    near = _may_reach(tuple(m[at] for m in marks), tuple(m[other] for m in marks), shared, of) & (rows[1, at] != rows[1, other])
                    found.append(np.stack([rows[1, at[near]], rows[1, other[near]]]))
                kept = rows[:, [hub[-1], len(place) - 1]]
            a, b = np.concatenate(found, axis=1)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    by_place = buckets.repartition(F.shiftright("bucket", 24)).sortWithinPartitions("bucket", "a")
    return by_place.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(edges: DataFrame, sets: DataFrame, shared: int, of: int) -> DataFrame:
    """Edges (a, b) whose word sets (id, words) share at least shared/of of all their words."""
    at_a = sets.select(F.col("id").alias("a"), F.col("words").alias("words_a"))
    at_b = sets.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    both = edges.join(at_a, "a").join(at_b, "b")
    common = F.size(F.array_intersect("words_a", "words_b"))
    size_a, size_b = F.size("words_a"), F.size("words_b")
    may = F.least(size_a, size_b) * of >= F.greatest(size_a, size_b) * shared
    return both.where(may & (common * of >= (size_a + size_b - common) * shared)).select("a", "b")


#: Neighbours of a record that meet each other in one task; of more, blocks of them meet.
BLOCK = 256


def neighbours_met(links: DataFrame, known: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y), x < y: distinct pairs that share a neighbour in links (a, b) and aren't in known (a, b).

    The neighbours of a record are cut into blocks, and two blocks meet at a time, so a
    record with any number of neighbours is spread over many tasks.
    """
    both = links.union(links.select("b", "a"))
    many = both.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnRenamed("a", "middle")
    around = both.select(F.col("a").alias("middle"), F.col("b").alias("x")).join(many.where("blocks > 1"), "middle", "left")
    around = around.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    around = around.select("middle", "x", "own", pairs.alias("other"))
    left = around.select("middle", F.col("own").alias("i"), F.col("other").alias("j"), "x")
    right = around.select("middle", F.col("other").alias("i"), F.col("own").alias("j"), F.col("x").alias("y"))
    met = left.join(right, ["middle", "i", "j"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return met.distinct().join(known, ["a", "b"], "left_anti")


def similar_links(scratch: Scratch, sets: DataFrame, total: int, shared: int, of: int, how: Signature) -> tuple[DataFrame, DataFrame]:
    """(links, edges), both (a, b), a < b: verified candidate edges of word sets (id bigint, words), and all candidate edges."""
    weights = word_weights(sets, "words", total, how)
    edges = scratch.save(star_edges(bucket_rows(sets, "id", "words", weights, shared, of, how), shared, of), "edges")
    return scratch.save(verified(edges, sets, shared, of), "links"), edges


def similar_sets(scratch: Scratch, sets: DataFrame, total: int, shared: int, of: int, how: Signature) -> DataFrame:
    """(a, b), a < b: pairs of distinct, non-empty word sets (id bigint, words) with at least shared/of in common.

    Where two sets share a verified neighbour, they are verified too; what that costs follows
    the number of similar pairs, which are the result.
    """
    links, edges = similar_links(scratch, sets, total, shared, of, how)
    return links.union(verified(neighbours_met(links, edges), sets, shared, of))


#: Up to this many exact copies a text's records are paired one by one, beyond through the smallest id.
COPIES_PAIRED = 64


def _prepared(scratch: Scratch, items: DataFrame, key: str, title: str, excerpt: str) -> tuple[DataFrame, DataFrame]:
    """sets (id, words) and members (id, copy, key) of records: each distinct word set once, and who has it by which text."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(excerpt, F.lit("")))
    copy = F.xxhash64(F.coalesce(title, F.lit("")), F.coalesce(excerpt, F.lit("")))
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), copy.alias("copy"), words_of(text).alias("words"))
    first, second = set_digest(F.col("words"))
    dictionary = {"parquet.dictionary.page.size": str(16 << 20)}
    rows = scratch.save(rows.where(F.size("words") > 0).select("key", "copy", "words", first.alias("h1"), second.alias("h2")), "rows", **dictionary)
    sets = rows.groupBy("h1", "h2").agg(F.first("words").alias("words"))
    sets = scratch.save(sets.withColumn("id", F.monotonically_increasing_id()), "sets", **dictionary)
    members = rows.select("h1", "h2", "copy", "key").distinct().join(sets.select("h1", "h2", "id"), ["h1", "h2"])
    members = scratch.save(members.select("id", "copy", "key"), "members")
    scratch.drop("rows")
    return sets.select("id", "words"), members


def near_duplicate_pairs(
    items: DataFrame, key: str = "item_id", title: str = "title", excerpt: str = "excerpt", shared: int = 3, of: int = 5,
    how: Signature = Signature(), copies: int | None = COPIES_PAIRED,
) -> DataFrame:
    """(key_a, key_b), smaller first: different records whose words have at least shared/of in common.

    Words are the lower-cased maximal runs of letters and digits in title, a blank and
    excerpt, each counted once; a null title or excerpt is empty. A record delivered more
    than once counts with each of its texts. Records with a null key are ignored, texts
    without words match nothing, other columns don't matter, an empty table gives nothing.
    Records of one word set pair with each other and with those of similar sets; where a text
    (title and excerpt) has over `copies` records, they pair with its smallest key and with the
    smallest key (and few copies) of each other such text, so copies cost in proportion to their
    number. With copies=None every pair is given; near_duplicate_members gives the rest by membership.
    """
    scratch = Scratch(items.sparkSession, "neardup")
    sets, members = _prepared(scratch, items, key, title, excerpt)
    links = scratch.save(similar_sets(scratch, sets, sets.count(), shared, of, how), "similar")
    scratch.drop("sets", "edges", "links")
    return expand(links, members, key, copies)


def near_duplicate_members(
    items: DataFrame, key: str = "item_id", title: str = "title", excerpt: str = "excerpt", shared: int = 3, of: int = 5, how: Signature = Signature()
) -> DataFrame:
    """(key, text_key, group_key): one row for each record and text; its text's smallest key, and its group's.

    Records of one text share text_key, so with the pairs between text_keys every pair of
    records is known, however many copies a text has. A group holds all records that similar
    texts link directly or indirectly. Records without a similar one are groups of their own;
    null keys, texts without words, repeated rows and other columns as in near_duplicate_pairs.
    """
    scratch = Scratch(items.sparkSession, "neardup")
    sets, members = _prepared(scratch, items, key, title, excerpt)
    links, _ = similar_links(scratch, sets, sets.count(), shared, of, how)
    roots = component_labels(scratch, links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    texts = members.groupBy("id", "copy").agg(F.min("key").alias("text_key"))
    rooted = texts.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    groups = rooted.groupBy("root").agg(F.min("text_key").alias("group_key"))
    named = rooted.join(groups, "root").select("id", "copy", "text_key", "group_key")
    return members.join(named, ["id", "copy"]).select(F.col("key").alias(key), "text_key", "group_key")


def expand(links: DataFrame, members: DataFrame, key: str, copies: int | None = COPIES_PAIRED) -> DataFrame:
    """Pairs of records from links (a, b) between sets and the members (id, copy, key) of each set, copy standing for the text."""
    sizes = members.groupBy("id", "copy").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    sized = members.join(sizes, ["id", "copy"])
    chosen = sized if copies is None else sized.where((F.col("copies") <= copies) | (F.col("key") == F.col("least")))
    own = sizes.groupBy("id").agg(F.sum("copies").alias("members")).where("members > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    ways = links.union(links.select("b", "a")).union(own)
    pairs = ways.join(chosen.select(F.col("id").alias("a"), F.col("key").alias("x")), "a").join(
        members.select(F.col("id").alias("b"), F.col("key").alias("y")), "b"
    )
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
    return pairs.distinct()
