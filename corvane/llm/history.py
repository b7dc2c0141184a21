"""Problem 6: each new batch is deduplicated against all accepted history.

Method: the band keys of every text, with its parity signature and size, and the digests of
the accepted records' exact keys lie in tables that are partitioned by hash, in a folder that
any later session can open again. A batch writes its own keys to their buckets and meets the
matching ones there: the history is neither shuffled nor recomputed. Candidates whose
signatures allow it are verified on whole word sets; then the accepted records are appended.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.neardup import Signature, band_keys, mark_of, may_reach, set_digest, signatures, unpacked, word_weights, words_of
from corvane.runtime import Scratch, delete_path, is_empty, read_text, ship_package, write_text

#: Rows of the band table in one of its hash buckets, beyond which the tables get twice as many.
ROWS_PER_BUCKET = 4_000_000
#: Texts of a batch in one band bucket that a probe meets at once; it meets the rest only if these leave it open.
CROWDED = 1_024
#: The tables, with the column they are bucketed by. A text is named by the two digests of its word set.
TABLES = {
    "exact": ("bucket bigint, mark bigint, batch int", "bucket"),
    "bands": ("bucket bigint, mark bigint, size int, h1 bigint, rank int, batch int", "bucket"),
    "sets": ("h1 bigint, h2 bigint, words array<bigint>, batch int", "h1"),
    "refused": ("h1 bigint, h2 bigint, batch int", "h1"),
}


class History:
    """Keys of accepted records in a folder, and the probe of a batch against them.

    The folder holds the tables, the word weights of the first batch and a manifest. A batch
    counts once the manifest names it: one that broke off is taken again as if never begun.
    """

    def __init__(self, spark: SparkSession, path: str, shared: int = 3, of: int = 5, how: Signature = Signature(bands=28), buckets: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = {"shared": shared, "of": of, "how": asdict(how), "buckets": buckets, "generation": 0, "batches": 0, "begun": 0, "crowded": False, "bands": 0}
        found = read_text(spark, f"{self.path}/manifest.json")
        if found:  # the folder's own parameters hold: keys of other ones wouldn't meet
            self.state = json.loads(found)
        self.shared, self.of, self.how = self.state["shared"], self.state["of"], Signature(**self.state["how"])
        self.scratch = Scratch(spark, "history")
        self._define()

    def _define(self) -> None:
        """Names the tables of the folder's generation in this session's catalog."""
        self.name = "history_" + hashlib.md5(f"{self.path}/{self.state['generation']}".encode()).hexdigest()
        for table, (columns, by) in TABLES.items():
            plain = "options ('parquet.enable.dictionary#bucket' 'false')" if "bucket" in columns else ""  # random numbers
            self.spark.sql(
                f"create table if not exists {self.name}_{table} ({columns}) using parquet {plain} "
                f"clustered by ({by}) into {self.state['buckets']} buckets location '{self._place(table)}'"
            )

    def _place(self, table: str) -> str:
        return f"{self.path}/{table}-{self.state['generation']}"

    def _all(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def _kept(self, table: str) -> DataFrame:
        """Rows of the batches taken."""
        return self._all(table).where(F.col("batch") < self.state["batches"])

    def _own(self, table: str) -> DataFrame:
        """Rows of the batch under way, which don't count yet."""
        return self._all(table).where(F.col("batch") == self.state["batches"])

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.withColumn("batch", F.lit(self.state["batches"])).select(self._all(table).columns).write.insertInto(f"{self.name}_{table}")

    def _spread(self, rows: DataFrame, table: str) -> DataFrame:
        """Rows in the table's hash buckets: written and joined there without moving again."""
        return rows.repartition(self.state["buckets"], TABLES[table][1])

    def _commit(self, **changes) -> None:
        self.state |= changes
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))

    def close(self) -> None:
        """Forgets the tables in this session; the folder stays."""
        for table in TABLES:
            self.spark.sql(f"drop table if exists {self.name}_{table}")

    def _begin(self) -> None:
        """Notes that a batch is under way; drops what one of the same number left that broke off."""
        if self.state["begun"] > self.state["batches"]:
            self._rewrite(self.state["buckets"])
        self._commit(begun=self.state["batches"] + 1)

    def _grow(self) -> None:
        """Twice the buckets, as often as the bands ask for it; the tables are rewritten, so seldom."""
        buckets = self.state["buckets"]
        while self.state["bands"] > buckets * ROWS_PER_BUCKET:
            buckets *= 2
        if buckets > self.state["buckets"]:
            self._rewrite(buckets)

    def _rewrite(self, buckets: int) -> None:
        """The batches taken, in so many buckets, as the folder's next generation."""
        kept, old, name = {t: self._kept(t) for t in TABLES}, [self._place(t) for t in TABLES], self.name
        self.state |= {"buckets": buckets, "generation": self.state["generation"] + 1}
        for table in TABLES:
            delete_path(self.spark, self._place(table))
        self._define()
        for table, rows in kept.items():
            self._spread(rows, table).write.insertInto(f"{self.name}_{table}")
        self._commit()
        for table, place in zip(TABLES, old):
            self.spark.sql(f"drop table if exists {name}_{table}")
            delete_path(self.spark, place)

    def _weights(self) -> list[tuple[int, float]]:
        """Word weights: those of the first batch's texts, for good, so that keys of different batches agree."""
        place = f"{self.path}/weights"
        if not self.state["batches"]:
            sets = self._own("sets")
            weights = word_weights(sets, "words", sets.count(), self.how)
            table = self.spark.createDataFrame([(w - 2**64 if w >= 2**63 else w, v) for w, v in weights], "word bigint, weight double")
            table.coalesce(1).write.mode("overwrite").parquet(place)
            return weights
        return sorted((r["word"] % 2**64, r["weight"]) for r in self.spark.read.schema("word bigint, weight double").parquet(place).collect())

    def _banded(self, sets: DataFrame, weights: list[tuple[int, float]]) -> DataFrame:
        """(bucket, mark, size, h1): the band keys of every set, with its parities and size."""
        context = ship_package(self.spark).sparkContext
        how, table = self.how, context.broadcast((np.array([w for w, _ in weights], dtype=np.uint64), np.array([c for _, c in weights])))  # see word_weights

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    owner, flat, n = unpacked(batch, 1)
                    keys = band_keys(signatures(owner, flat, n, *table.value, how), how).view(np.int64)
                    of_set = mark_of(owner, flat, n).view(np.int64), np.bincount(owner, minlength=n).astype(np.int32), batch.column(0).to_numpy()
                    columns = keys.ravel(), *(np.repeat(c, how.bands) for c in of_set)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "mark", "size", "h1"])

        return sets.select("h1", "words").mapInArrow(run, "bucket bigint, mark bigint, size int, h1 bigint")

    def _verified(self, candidates: DataFrame) -> DataFrame:
        """(h1, h2) of the batch's sets with an accepted candidate (h1, kept) that shares enough words."""
        refused = self._kept("refused").select(F.col("h1").alias("kept"), F.col("h2").alias("kept_h2"))
        kept = self._kept("sets").select(F.col("h1").alias("kept"), F.col("h2").alias("kept_h2"), F.col("words").alias("kept_words"))
        both = candidates.join(kept, "kept").join(self._own("sets").select("h1", "h2", "words"), "h1")
        common = F.size(F.array_intersect("words", "kept_words"))
        enough = common * self.of >= (F.size("words") + F.size("kept_words") - common) * self.shared
        return both.where(enough).select("h1", "h2", "kept", "kept_h2").join(refused, ["kept", "kept_h2"], "left_anti").select("h1", "h2").distinct()

    def _near(self, crowded: bool) -> DataFrame:
        """(h1, h2) of the batch's sets that are near-duplicates of an accepted one.

        In a crowded bucket the first texts are met before all others, and only what they leave
        open meets the rest, in a join that splits crowded buckets. So many near-copies are
        settled by a few, and none is cut off. The batch's rows are hashed, at most CROWDED of a
        bucket and ROWS_PER_BUCKET in all in a task, so that the history needs no sort; those of
        the batch's own `crowded` buckets beyond that are sorted.
        """

        def met(stage: DataFrame, bands: DataFrame) -> DataFrame:
            reach = may_reach(F.col("s.mark"), F.col("s.size"), F.col("k.mark"), F.col("k.size"), self.shared, self.of)
            parts = (stage.where(F.col("rank") <= CROWDED).hint("shuffle_hash"), stage.where(F.col("rank") > CROWDED)) if crowded else (stage.hint("shuffle_hash"),)
            both = (s.alias("s").join(bands.alias("k"), "bucket").where(reach) for s in parts)
            return reduce(DataFrame.union, (b.select("s.h1", F.col("k.h1").alias("kept")) for b in both)).distinct()

        stage, number = self._own("bands").select("bucket", "mark", "size", "h1", "rank"), self.state["batches"]
        if not self.state["crowded"]:  # no row is beyond: none needs its rank read
            return self._verified(met(stage, self._kept("bands")))
        found = self._verified(met(stage, self._kept("bands").where(F.col("rank") <= CROWDED)))
        found = self.scratch.save(found, f"batch-{number}-first")
        rest = self.spark.read.schema(TABLES["bands"][0]).parquet(self._place("bands")).where((F.col("batch") < number) & (F.col("rank") > CROWDED))
        return found.union(self._verified(met(stage.join(found.select("h1"), "h1", "left_anti"), rest)))

    def take(self, items: DataFrame, key: str, texts: list[str], exact: list[Column]) -> DataFrame:
        """Probes a batch, appends what is new, and returns the (key) of the records already known.

        A record is known if one of its exact keys (strings; null is none) or its word set is
        that of an accepted record, or if its words and those of an accepted record have at
        least shared/of in common. Records of a batch aren't compared with each other; a
        record that is repeated in the batch is known if any of its rows is. Records with a
        null key are ignored, texts without words match no text.
        """
        number, scratch = self.state["batches"], self.scratch
        batch = f"batch-{number}"
        self._begin()
        h1, h2 = set_digest(F.col("words"))
        rows = items.where(F.col(key).isNotNull()).select(
            F.col(key).alias("record"), words_of(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))).alias("words"), F.array(*exact).alias("named")
        )
        worded = F.size("words") > 0
        rows = rows.withColumns({"h1": F.when(worded, h1), "h2": F.when(worded, h2)})
        digest = lambda i, k: F.when(k.isNotNull(), F.struct(F.xxhash64(F.lit(i), k).alias("bucket"), F.xxhash64(k, F.lit(i)).alias("mark")))
        named = [digest(i, F.col("named")[i]) for i in range(len(exact))]
        whole = F.when(worded, F.struct(F.col("h1").alias("bucket"), F.col("h2").alias("mark")))
        rows = rows.withColumn("digests", F.array(*named, whole)).drop("named")  # array_compact isn't compiled: nulls are left out where it is read
        rows = scratch.save(rows, f"{batch}-rows", **{"parquet.enable.dictionary": "false"})  # dropped with the batch
        digests = lambda of, *more: of.select(*more, F.inline("digests")).where("bucket is not null")
        hits = rows.select("record").limit(0)
        if number:
            keys = digests(rows, "record")
            asked = keys.select("bucket", "mark").distinct()  # a key of many records is asked for once
            met = asked.join(self._kept("exact").select("bucket", "mark"), ["bucket", "mark"], "left_semi")
            hits = scratch.save(keys.join(met, ["bucket", "mark"], "left_semi").select("record").distinct(), f"{batch}-exact")
        open_ = rows.where("h1 is not null").join(hits, "record", "left_anti")
        self._append(self._spread(open_.select("h1", "h2", "words"), "sets").groupBy("h1", "h2").agg(F.first("words").alias("words")), "sets")
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h1"))
        self._append(self._spread(self._banded(self._own("sets"), self._weights()), "bands").withColumn("rank", rank), "bands")
        crowded = not is_empty(self._own("bands").where(F.col("rank") > CROWDED))  # told by the files' statistics
        known = hits
        if number:
            near = scratch.save(self._near(crowded), f"{batch}-near")
            near_rows = rows.select("record", "h1", "h2").join(near, ["h1", "h2"], "left_semi")
            known = scratch.save(hits.union(near_rows.select("record")).distinct(), f"{batch}-known")
        new = rows.join(known, "record", "left_anti")
        self._append(self._spread(digests(new).distinct(), "exact"), "exact")
        if number:  # sets that only known records have aren't accepted
            taken = new.where("h1 is not null").select("h1", "h2").distinct()
            self._append(self._spread(self._own("sets").select("h1", "h2").join(taken, ["h1", "h2"], "left_anti"), "refused"), "refused")
        bands = self.state["bands"] + self._own("sets").count() * self.how.bands
        self._commit(batches=number + 1, crowded=self.state["crowded"] or crowded, bands=bands)
        self._grow()
        scratch.drop(*(f"{batch}-{t}" for t in ("rows", "exact", "near", "first") if t != "exact" or number))
        return known.select(F.col("record").alias(key))


def known_items(items: DataFrame, batch: str, key: str, texts: list[str], exact: list[Column], path: str | None = None) -> DataFrame:
    """(batch, key) of the records known when their batch came; batches are taken in ascending order, null ones ignored.

    With a path the history stays there, and a later call goes on from it; without one it
    lies in the shared folder until the session ends.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "known")
    history = History(spark, path or scratch.path("history"))
    batches = [r[0] for r in items.select(batch).distinct().where(F.col(batch).isNotNull()).orderBy(batch).collect()]  # one per delivery
    found = [history.take(items.where(F.col(batch) == b), key, texts, exact).select(F.lit(b).alias(batch), key) for b in batches]
    history.close()
    if not path:
        scratch.drop("history")
    return reduce(DataFrame.union, found) if found else items.select(batch, key).limit(0)
