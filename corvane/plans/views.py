"""Further read queries: shelves, samples, lifecycles, evidence, labels and stored reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import scores, text
from corvane.operators.diversify import capped_feed
from corvane.plans.base import I_SQL, P_SQL, day, day_sql, items_now, posts_now
from corvane.plans.texts import _WORDS_SQL
from corvane.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "items").where("dedupe_group_id <> ''").withColumnRenamed("dedupe_group_id", "story_id")


@query(f"with {P_SQL} select post_id, score from p where link_flair_text = 'News' and lower(subreddit) = 'cruhq' and title like '%a%'")
def f6_pulse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, section in any case, pattern of the title."""
    rule = (F.col("link_flair_text") == "News") & (F.lower("subreddit") == "cruhq") & F.col("title").like("%a%")
    return posts_now(spark, sf_dir).where(rule).select("post_id", "score")


@query("""with t as (select distinct unnest(domain_ids) as trend, dedupe_group_id as story_id, item_id from items where dedupe_group_id <> '')
select trend, story_id, count(*) as items from t group by 1, 2 having count(*) >= 2""")
def j4_trend_story_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends, their stories and items: bridge of bridges."""
    rows = _stories(spark, sf_dir).select(F.explode("domain_ids").alias("trend"), "story_id", "item_id").distinct()
    return rows.groupBy("trend", "story_id").agg(F.count("*").alias("items")).where("items >= 2")


@query("""with last as (select provider, max(snapshot_date) as d from items group by 1) select i.provider, i.snapshot_date, count(distinct i.item_id) as items from items i join last l on i.provider = l.provider and i.snapshot_date = l.d group by 1, 2""")
def j16_latest_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest batch of every provider, by a grouping, not a subquery per row."""
    days = table(spark, sf_dir, "items").groupBy("provider", "snapshot_date").agg(F.count_distinct("item_id").alias("items"))
    return days.groupBy("provider").agg(F.max(F.struct("snapshot_date", "items")).alias("m")).select("provider", "m.snapshot_date", "m.items")


@query(f"""with {P_SQL}, s as (select *, row_number() over (order by score desc nulls last, post_id) as r1, row_number() over (order by num_comments desc nulls last, post_id) as r2 from p)
select 'pulse' as shelf, post_id, r1 as place from s where r1 <= 10 union all select 'talk', post_id, r2 from s where r2 <= 10""")
def a12_pulse_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top lists by two measures."""
    posts, out = posts_now(spark, sf_dir).select("post_id", "score", "num_comments"), None
    for shelf, key in (("pulse", "score"), ("talk", "num_comments")):
        order = [F.desc_nulls_last(key), F.col("post_id")]
        top = posts.orderBy(*order).limit(10)
        top = top.select(F.lit(shelf).alias("shelf"), "post_id", F.row_number().over(Window.orderBy(*order)).alias("place"))  # ten rows
        out = top if out is None else out.union(top)
    return out


@query("""with x as (select lower(trim(unnest(domain_ids))) as theme, snapshot_date as day, source_cluster, coalesce(raw_engagement['score'], raw_engagement['points'], raw_engagement['votes']) as liked, item_id from items),
c as (select theme, day, count(distinct item_id) as n, count(distinct source_cluster) as sources, round(avg(liked), 4) as avg_score from x group by 1, 2), l as (select *, lag(n) over (partition by theme order by day) as before from c)
select theme, day, n, sources, avg_score, case when before is null then 'new' when n > before * 1.3 then 'growing' when n < before * 0.7 then 'fading' else 'stable' end as direction,
round(sources * (1 + ln(1 + n)) * case when before is null then 1.5 else 1 end, 4) as strength from l""")
def a22_theme_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes per day with direction and strength."""
    liked = F.coalesce(*(F.try_element_at("raw_engagement", F.lit(k)) for k in ("score", "points", "votes"))).alias("liked")
    rows = table(spark, sf_dir, "items").select(F.explode("domain_ids").alias("theme"), F.col("snapshot_date").alias("day"), "source_cluster", liked, "item_id")
    rows = rows.groupBy(F.lower(F.trim("theme")).alias("theme"), "day").agg(F.count_distinct("item_id").alias("n"), F.count_distinct("source_cluster").alias("sources"), F.round(F.avg("liked"), 4).alias("avg_score"))
    rows = rows.withColumn("before", F.lag("n").over(Window.partitionBy("theme").orderBy("day")))
    strength = F.col("sources") * (1 + F.log1p("n")) * F.when(F.col("before").isNull(), 1.5).otherwise(1.0)
    return rows.select("theme", "day", "n", "sources", "avg_score", scores.theme_direction(F.col("n"), F.col("before")).alias("direction"), F.round(strength, 4).alias("strength"))


@query("""with s as (select dedupe_group_id as story, count(distinct item_id) as n, count(distinct provider) as p, count(distinct snapshot_date) as d from items where dedupe_group_id <> '' group by 1)
select story as story_id, round(least(0.99, 0.4 * least(1, n / 10) + 0.3 * least(1, p / 3) + 0.3 * least(1, d / 5)), 4) as confidence from s""")
def a24_trend_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence from items, providers and dates."""
    rows = _stories(spark, sf_dir).groupBy("story_id").agg(*(F.count_distinct(c).alias(c) for c in ("item_id", "provider", "snapshot_date")))
    part = lambda c, full, w: w * F.least(F.lit(1.0), F.col(c) / full)
    total = part("item_id", 10, 0.4) + part("provider", 3, 0.3) + part("snapshot_date", 5, 0.3)
    return rows.select("story_id", F.round(F.least(F.lit(0.99), total), 4).alias("confidence"))


@query("""with e as (select dedupe_group_id as story, unnest(map_entries(raw_engagement)) as e from items where dedupe_group_id <> '' and raw_engagement is not null) select story as story_id, e.key as measure, max(e.value) as best from e group by 1, 2""")
def a26_map_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-wise maximum of maps."""
    rows = _stories(spark, sf_dir).select("story_id", F.explode("raw_engagement").alias("measure", "value"))
    return rows.groupBy("story_id", "measure").agg(F.max("value").alias("best"))


_SCOPE = "case content_scope when 'full' then 100 when 'excerpt' then 70 when 'abstract' then 60 else 40 end"


@query(f"""with s as (select dedupe_group_id as story, provider, max({_SCOPE}) as best from items where dedupe_group_id <> '' group by 1, 2), r as (select *, row_number() over (partition by story order by best desc, provider) as k, count(*) over (partition by story) as n from s)
select story as story_id, round(case when max(n) = 1 then least(60, avg(best)) else avg(best) end, 4) as evidence from r where k <= 2 group by 1""")
def a27_evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the best two providers' scope; one provider counts at most 60."""
    return _evidence(spark, sf_dir).select("story_id", F.round("evidence", 4).alias("evidence"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = F.when(F.col("content_scope") == "full", 100).when(F.col("content_scope") == "excerpt", 70).when(F.col("content_scope") == "abstract", 60).otherwise(40)
    rows = _stories(spark, sf_dir).groupBy("story_id", "provider").agg(F.max(scope).alias("best"))
    rows = rows.withColumns({"k": F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("best"), "provider")), "n": F.count("*").over(Window.partitionBy("story_id"))}).where("k <= 2")
    mean = F.avg("best")
    return rows.groupBy("story_id").agg(F.when(F.max("n") == 1, F.least(F.lit(60.0), mean)).otherwise(mean).alias("evidence"))


@query(f"""with s as (select distinct dedupe_group_id as story, provider, item_id, {_SCOPE} as q from items where dedupe_group_id <> ''), b as (select *, row_number() over (partition by story, provider order by q desc, item_id) as k from s),
r as (select *, row_number() over (partition by story order by q desc, item_id) as place from b where k = 1) select story as story_id, item_id, place from r where place <= 3""")
def w12_story_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per provider, best scope first, three a story."""
    scope = F.when(F.col("content_scope") == "full", 100).when(F.col("content_scope") == "excerpt", 70).when(F.col("content_scope") == "abstract", 60).otherwise(40)
    rows = _stories(spark, sf_dir).select("story_id", "provider", "item_id", scope.alias("q")).distinct()
    of = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("q"), "item_id"))
    rows = rows.withColumn("k", of("story_id", "provider")).where("k = 1").withColumn("place", of("story_id"))
    return rows.where("place <= 3").select("story_id", "item_id", "place")


@query(f"with {I_SQL} select item_id, (select count(*) from i) as total from i order by snapshot_date desc, item_id limit 20 offset 40")
def t4_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: one page with the total."""
    items = items_now(spark, sf_dir).select("item_id", "snapshot_date")
    total = items.count()
    return items.orderBy(F.desc("snapshot_date"), "item_id").offset(40).limit(20).select("item_id", F.lit(total).alias("total"))


@query(f"with {I_SQL} select item_id from i order by coalesce(discussed, 0) desc, item_id limit 30")
def t5_sort_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: sorted by a measure inside a map."""
    return items_now(spark, sf_dir).orderBy(F.desc(F.coalesce("discussed", F.lit(0.0))), "item_id").limit(30).select("item_id")


@query("""with l as (select item_id_a as a, item_id_b as b, max(score) as s from cluster_candidate_pairs where score is not null group by 1, 2), d as (select *, case when s >= 0.82 then 'auto' when s >= 0.62 then 'review' else 'reject' end as decision from l),
r as (select *, row_number() over (partition by decision order by sha256('7|' || a || '|' || b)) as k from d) select decision, a, b from r where k <= case decision when 'auto' then 50 when 'review' then 40 else 10 end""")
def t10_golden_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample by decision, 50, 40 and 10."""
    pairs = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null").groupBy(F.col("item_id_a").alias("a"), F.col("item_id_b").alias("b")).agg(F.max("score").alias("s"))
    decision = F.when(F.col("s") >= 0.82, "auto").when(F.col("s") >= 0.62, "review").otherwise("reject")
    order = F.sha2(F.concat(F.lit("7|"), "a", F.lit("|"), "b"), 256)
    ranked = pairs.withColumn("decision", decision).withColumn("k", F.row_number().over(Window.partitionBy("decision").orderBy(order)))
    quota = F.when(F.col("decision") == "auto", 50).when(F.col("decision") == "review", 40).otherwise(10)
    return ranked.where(F.col("k") <= quota).select("decision", "a", "b")


@query("""with g as (select distinct dedupe_group_id as g, item_id from items where dedupe_group_id <> ''), p as (select a.g, a.item_id as a, b.item_id as b, row_number() over (partition by a.g order by a.item_id, b.item_id) as k from g a join g b on a.g = b.g and a.item_id < b.item_id) select g as story_id, a, b from p where k <= 12""")
def t12_positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twelve positive pairs per group, from its first five items or more if needed for twelve."""
    rows = _stories(spark, sf_dir).select("story_id", "item_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("story_id").orderBy("item_id")))
    # Pairs are taken in id order, so the twelve come from the first item with its first twelve followers, and so on: thirteen items suffice.
    few = rows.where("n <= 13")
    a, b = few.select("story_id", F.col("item_id").alias("a")), few.select("story_id", F.col("item_id").alias("b"))
    pairs = a.join(b, "story_id").where("a < b").withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy("a", "b")))
    return pairs.where("k <= 12").select("story_id", "a", "b")


@query(f"""with {I_SQL}, s as (select item_id, title, provider, row_number() over (order by sha256('11|' || item_id)) as k from i), x as (select * from s where k <= 40), y as (select * from s where k > 40 and k <= 80)
select x.item_id as a, y.item_id as b from x join y on x.k = y.k - 40 where x.provider <> y.provider and lower(x.title) <> lower(y.title)""")
def t11_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random pairs that are surely different."""
    top = items_now(spark, sf_dir).select("item_id", "title", "provider", F.sha2(F.concat(F.lit("11|"), "item_id"), 256).alias("h")).orderBy("h").limit(80)
    ranked = top.withColumn("k", F.row_number().over(Window.orderBy("h")))  # eighty rows
    x = ranked.where("k <= 40").select("k", F.col("item_id").alias("a"), F.col("title").alias("ta"), F.col("provider").alias("pa"))
    y = ranked.where("k > 40").select((F.col("k") - 40).alias("k"), F.col("item_id").alias("b"), F.col("title").alias("tb"), F.col("provider").alias("pb"))
    return x.join(y, "k").where((F.col("pa") != F.col("pb")) & (F.lower("ta") != F.lower("tb"))).select("a", "b")


_THEMES = {"agents": ["robot", "agent", "prompt"], "money": ["mortgage", "pension", "loan", "refund"], "places": ["harbor", "railway", "campus", "studio"]}


@query(f"""with {I_SQL}, x as (select item_id, lower(concat_ws(' ', title, excerpt)) as t from i) """ + " union all ".join(f"select item_id, '{theme}' as theme from x where {' or '.join(f'''contains(t, '{w}')''' for w in words)}" for theme, words in _THEMES.items()))
def c17_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: themes of a catalogue by their keywords."""
    body = F.lower(F.concat_ws(" ", "title", "excerpt"))
    found = F.array_compact(F.array(*(F.when(body.rlike("|".join(words)), theme) for theme, words in _THEMES.items())))
    return items_now(spark, sf_dir).select("item_id", F.explode(found).alias("theme"))


@query(rf"""with {I_SQL}, n as (select item_id, unnest(list_distinct(regexp_extract_all(lower(title), '[$€£]?\d[\d,.]*\s?(?:%|percent|billion|million|bn|m|k)?'))) as n from i)
select item_id, trim(n) as number, case when regexp_matches(n, '^[$€£]') then 'currency' when regexp_matches(n, '(%|percent)') then 'percent' else 'count' end as kind from n""")
def c19_event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed numbers of a title."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[$€£]?\d[\d,.]*\s?(?:%|percent|billion|million|bn|m|k)?"), F.lit(0)))
    kind = F.when(F.col("n").rlike("^[$€£]"), "currency").when(F.col("n").rlike("(%|percent)"), "percent").otherwise("count")
    return items_now(spark, sf_dir).select("item_id", F.explode(found).alias("n")).select("item_id", F.trim("n").alias("number"), kind.alias("kind"))


@query(f"with {P_SQL} select post_id, case when length(title) > 40 then regexp_replace(substr(title, 1, 40), '\\s+\\S*$', '') || '…' else title end as short, case when score >= 1000 then printf('%.1f', floor(score / 100) / 10) || 'k' else score::varchar end as label from p where score is not null")
def c11_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: titles cut at a word, scores in short form."""
    posts = posts_now(spark, sf_dir).where("score is not null")
    return posts.select("post_id", text.shortened(F.col("title"), 40).alias("short"), text.short_count(F.col("score")).alias("label"))


@query(f"""with {P_SQL} select post_id, 256 * 0 + ('0x' || substr(sha256(lower(author)), 1, 8))::bigint % 256 as bucket from p where author is not null""")
def c28_hashed_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket of a hashed feature."""
    bucket = F.conv(F.substring(F.sha2(F.lower("author"), 256), 1, 8), 16, 10).cast("bigint") % 256
    return posts_now(spark, sf_dir).where("author is not null").select("post_id", bucket.alias("bucket"))


@query(f"""with s as (select dedupe_group_id as story, count(distinct source_cluster) as c, count(distinct item_id) as n, count(distinct provider) as p, min(snapshot_date) as first from items where dedupe_group_id <> '' group by 1),
v as (select *, case when c <= 0 then 0 when c = 1 then 25 when c = 2 then 55 when c = 3 then 75 when c = 4 then 90 else 100 end as cov, case when a <= 0 then 100 when a <= 1 then 80 when a <= 3 then 55 when a <= 7 then 30 else 10 end as nov from (select *, date_diff('day', cast(first as date), cast({day_sql()} as date)) as a from s)),
e as (select story, case when max(n) = 1 then least(60, avg(best)) else avg(best) end as ev from (select *, row_number() over (partition by story order by best desc, provider) as k, count(*) over (partition by story) as n from (select dedupe_group_id as story, provider, max({_SCOPE}) as best from items where dedupe_group_id <> '' group by 1, 2)) where k <= 2 group by 1),
m as (select story, list_sort(list(ep)) as q from (select distinct i.dedupe_group_id as story, i.item_id, o.ep from items i join (select item_id, max_by(engagement_percentile, observed_at) as ep from observations where engagement_percentile is not null group by 1) o using (item_id) where dedupe_group_id <> '') group by 1)
select v.story as story_id, round(0.30::double * 25 + 0.25::double * cov + 0.20 * (0.5 * coalesce(q[len(q) // 2 + 1], 50) + 25) + 0.15 * nov + 0.10 * ev, 2) as trend_score, case when p >= 3 and ev >= 70 then 'high' when p >= 2 or ev >= 60 then 'medium' else 'low' end as confidence from v join e using (story) left join m using (story)""")
def c30_trend_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted trend score and confidence: goals (25, as none is set), coverage, momentum (upper median of percentiles; counts before are unknown), novelty, evidence."""
    rows = _stories(spark, sf_dir).groupBy("story_id").agg(F.count_distinct("source_cluster").alias("c"), F.count_distinct("provider").alias("p"), F.min("snapshot_date").alias("first"))
    age = F.date_diff(F.lit(day(spark, sf_dir)).cast("date"), F.col("first").cast("date"))
    seen = table(spark, sf_dir, "observations").where("engagement_percentile is not null").groupBy("item_id").agg(F.max_by("engagement_percentile", "observed_at").alias("ep"))
    heard = _stories(spark, sf_dir).select("story_id", "item_id").distinct().join(seen, "item_id").groupBy("story_id").agg(scores.upper_median(F.collect_list("ep")).alias("median"))
    rows = rows.join(_evidence(spark, sf_dir), "story_id").join(heard, "story_id", "left")
    momentum = scores.weighted([(F.col("median"), 0.5), (F.lit(None), 0.3), (F.lit(None), 0.2)])
    score = scores.weighted([(F.lit(25.0), 0.30), (scores.coverage_score(F.col("c")), 0.25), (momentum, 0.20), (scores.novelty_by_age(age), 0.15), (F.col("evidence"), 0.10)])
    return rows.select("story_id", F.round(score, 2).alias("trend_score"), scores.confidence(F.col("p"), F.col("evidence")).alias("confidence"))


@query("""with g as (select dedupe_group_id as g, max(coalesce(raw_engagement['score'], raw_engagement['points'], raw_engagement['votes'], 0)) as best, count(distinct provider) as sources, count(distinct provider) filter (source_cluster = 'mainstream') as cov from items where dedupe_group_id <> '' group by 1),
a as (select 'mainstream' as kind, g, round(best / (cov + 1), 6) as gap from g where best >= 60 and cov < 2 order by gap desc, g limit 25), b as (select 'elite' as kind, g, round(sources / greatest(least(best, 100) / 100 + 0.1, 0.1), 6) as gap from g where sources >= 2 order by gap desc, g limit 25) select kind, g as story_id, gap from a union all select kind, g, gap from b""")
def c35_gap_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two gap lists, each cut before they are joined."""
    liked = F.coalesce(*(F.try_element_at("raw_engagement", F.lit(k)) for k in ("score", "points", "votes")), F.lit(0.0))
    rows = _stories(spark, sf_dir).groupBy("story_id").agg(F.max(liked).alias("best"), F.count_distinct("provider").alias("sources"), F.count_distinct(F.when(F.col("source_cluster") == "mainstream", F.col("provider"))).alias("cov"))
    of = lambda kind, rule, gap: rows.where(rule).select(F.lit(kind).alias("kind"), "story_id", F.round(gap, 6).alias("gap")).orderBy(F.desc("gap"), "story_id").limit(25)
    mainstream = of("mainstream", "best >= 60 and cov < 2", F.col("best") / (F.col("cov") + 1))
    return mainstream.union(of("elite", "sources >= 2", F.col("sources") / F.greatest(F.least("best", F.lit(100.0)) / 100 + 0.1, F.lit(0.1))))


@query(f"""with {I_SQL} select item_id, round(case when list_contains(domain_ids, 'ai') then 20 when list_contains(domain_ids, 'business') then 12 else 5 end + case source_cluster when 'mainstream' then 10 when 'developers' then 8 else 4 end
+ least(8, ln(1 + greatest(coalesce(liked, 0), 0))) + least(5, ln(1 + greatest(coalesce(discussed, 0), 0))) + case when snapshot_date = {day_sql()} then 8 else 0 end, 6) as reading_score from i""")
def c36_reading_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading score from domain, cluster, engagement and freshness."""
    has = lambda d: F.array_contains("domain_ids", d)
    log = lambda c: F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))
    domain = F.when(has("ai"), 20).when(has("business"), 12).otherwise(5)
    cluster = F.when(F.col("source_cluster") == "mainstream", 10).when(F.col("source_cluster") == "developers", 8).otherwise(4)
    score = domain + cluster + F.least(F.lit(8.0), log("liked")) + F.least(F.lit(5.0), log("discussed")) + F.when(F.col("snapshot_date") == day(spark, sf_dir), 8).otherwise(0)
    return items_now(spark, sf_dir).select("item_id", F.round(score, 6).alias("reading_score"))


@query("""with x as (select distinct unnest(domain_ids) || ':' || coalesce(source_section, '') as bucket, dedupe_group_id as story from items where dedupe_group_id <> ''), b as (select bucket, count(*) as stories from x group by 1 order by stories desc, bucket limit 30) select bucket, stories from b where stories >= 3""")
def o6_bucket_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest buckets first, then the size rule: the limit comes before the filter."""
    rows = _stories(spark, sf_dir).select(F.explode("domain_ids").alias("d"), F.coalesce("source_section", F.lit("")).alias("s"), "story_id").select(F.concat_ws(":", "d", "s").alias("bucket"), "story_id").distinct()
    return rows.groupBy("bucket").agg(F.count("*").alias("stories")).orderBy(F.desc("stories"), "bucket").limit(30).where("stories >= 3")


@query()
def o10_diversified_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of at most 60 with caps per provider and domain."""
    ranked = items_now(spark, sf_dir).select("item_id", "provider", F.coalesce(F.try_element_at("domain_ids", F.lit(1)), F.lit("other")).alias("domain"), F.coalesce("liked", F.lit(0.0)).alias("rank_score"))
    return capped_feed(ranked, {"provider": 4, "domain": 15}, 60)


@query("""with l as (select item_id_a as a, item_id_b as b, experiment_id as source, score >= 0.62 as label, case experiment_id when 'exp-hybrid-1d' then 1 when 'exp-hybrid-7d' then 2 when 'exp-dense-7d' then 3 else 4 end as trust, score from cluster_candidate_pairs where score is not null),
r as (select *, row_number() over (partition by a, b order by trust, score desc) as k from l) select a, b, source, label from r where k = 1""")
def o16_trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several labels of a pair the most trusted source's."""
    trust = F.when(F.col("experiment_id") == "exp-hybrid-1d", 1).when(F.col("experiment_id") == "exp-hybrid-7d", 2).when(F.col("experiment_id") == "exp-dense-7d", 3).otherwise(4)
    rows = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null")
    best = rows.groupBy(F.col("item_id_a").alias("a"), F.col("item_id_b").alias("b")).agg(F.min(F.struct(trust.alias("trust"), (-F.col("score")).alias("s"), F.col("experiment_id").alias("source"))).alias("m"))
    return best.select("a", "b", F.col("m.source").alias("source"), (-F.col("m.s") >= 0.62).alias("label"))


@query(f"""with {I_SQL}, t as (select item_id, sha256(coalesce(title, '') || chr(10) || coalesce(excerpt, '')) as h, snapshot_date as d from i), c as (select distinct h from t where d < {day_sql()})
select count(distinct h) as missing from t where h not in (select h from c)""")
def o20_missing_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of the last batch not yet in a content-addressed store."""
    key = F.sha2(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("excerpt", F.lit(""))), 256).alias("h")
    rows = items_now(spark, sf_dir).select(key, "snapshot_date")
    return rows.join(rows.where(F.col("snapshot_date") < day(spark, sf_dir)).select("h").distinct(), "h", "left_anti").agg(F.count_distinct("h").alias("missing"))


@query("""with g as (select dedupe_group_id as g, count(distinct item_id) as n, count(distinct provider) as p, bool_or(source_cluster = 'mainstream') as m from items where dedupe_group_id <> '' group by 1)
select g as story_id, p >= 2 and m as verified, case when p = 1 and n > 8 then 'same provider' when p > 1 and n > 15 then 'cross source' end as guard from g""")
def o21_verified_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified stories and size guards."""
    rows = _stories(spark, sf_dir).groupBy("story_id").agg(F.count_distinct("item_id").alias("n"), F.count_distinct("provider").alias("p"), F.bool_or(F.col("source_cluster") == "mainstream").alias("m"))
    guard = F.when((F.col("p") == 1) & (F.col("n") > 8), "same provider").when((F.col("p") > 1) & (F.col("n") > 15), "cross source")
    return rows.select("story_id", ((F.col("p") >= 2) & F.col("m")).alias("verified"), guard.alias("guard"))


@query(f"""with {I_SQL}, t as (select item_id, list_filter({_WORDS_SQL}, lambda x: x <> '') as w, provider from i), k as (select item_id, provider, unnest(list_distinct(w)) as word from t), c as (select word, count(*) as n, count(distinct provider) as p from k group by 1)
select word, n, p as providers, round(least(0.95::double, 0.45::double + 0.06::double * p + 0.015::double * n), 4) as confidence from c where n >= 3 and p >= 2""")
def x12_word_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of three items and two providers at least, with confidence."""
    rows = items_now(spark, sf_dir).select("item_id", "provider", F.explode(text.tokens(F.col("title"))).alias("word"))
    rows = rows.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("provider").alias("providers")).where("n >= 3 and providers >= 2")
    return rows.select("word", "n", "providers", F.round(F.least(F.lit(0.95), 0.45 + 0.06 * F.col("providers") + 0.015 * F.col("n")), 4).alias("confidence"))


@query(f"""with s as (select distinct item_id, snapshot_date, title from items where snapshot_date < {day_sql()} order by snapshot_date desc, item_id, title limit 500), r as (select *, row_number() over (partition by item_id order by snapshot_date desc, title) as k from s) select item_id, snapshot_date from r where k = 1""")
def x31_recent_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before the dedupe."""
    rows = table(spark, sf_dir, "items").where(F.col("snapshot_date") < day(spark, sf_dir)).select("item_id", "snapshot_date", "title").distinct().orderBy(F.desc("snapshot_date"), "item_id", "title").limit(500)
    return rows.groupBy("item_id").agg(F.max("snapshot_date").alias("snapshot_date"))
