"""Read queries: filters, joins, aggregates, windows, top-k and set operations over the content tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import scores
from corvane.operators.ranks import numbered
from corvane.plans.base import I_SQL, LABELLED_SQL, P_SQL, day, day_sql, items_now, labelled, posts_now, snapshot, snapshot_sql
from corvane.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _day(column: str):
    return F.to_date(F.substring(column, 1, 10))


@query(f"with {P_SQL} select post_id, subreddit, score from p where lower(subreddit) like '%hq%' and score >= 10 order by score desc, post_id limit 50 offset 5")
def f1_post_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: posts of a section above a score, by score, one page."""
    posts = posts_now(spark, sf_dir).where(F.lower("subreddit").contains("hq") & (F.col("score") >= 10))
    return posts.select("post_id", "subreddit", "score").orderBy(F.desc("score"), "post_id").offset(5).limit(50)


@query(f"""with {I_SQL} select item_id, provider, snapshot_date from i
where snapshot_date >= {day_sql(4)} and list_contains(domain_ids, 'ai') and source_cluster in ('developers', 'business') and lower(title) like '%a%'""")
def f2_story_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """combined filters on date, domain, cluster and text."""
    rows = items_now(spark, sf_dir).where((F.col("snapshot_date") >= day(spark, sf_dir, 4)) & F.array_contains("domain_ids", "ai"))
    rows = rows.where(F.col("source_cluster").isin("developers", "business") & F.lower("title").contains("a"))
    return rows.select("item_id", "provider", "snapshot_date")


@query(f"""with {I_SQL} select provider, count(*) as n from i
where exists (select 1 from observations o where o.item_id = i.item_id and o.engagement_percentile > 0.95) group by provider""")
def f3_exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """items with an observation near the top, as a semi-join."""
    top = table(spark, sf_dir, "observations").where("engagement_percentile > 0.95").select("item_id")
    return items_now(spark, sf_dir).join(top, "item_id", "left_semi").groupBy("provider").agg(F.count("*").alias("n"))


@query(f"with {I_SQL} select item_id from i where lower(concat_ws(' ', title, excerpt, provider)) like '%privacy%' or lower(concat_ws(' ', title, excerpt, provider)) like '%breach%'")
def f4_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case-insensitive substring search over several columns."""
    text = F.lower(F.concat_ws(" ", "title", "excerpt", "provider"))
    return items_now(spark, sf_dir).where(text.contains("privacy") | text.contains("breach")).select("item_id")


@query(f"""select distinct item_id, published_at from items
where (snapshot_date = {day_sql(3)} or starts_with(published_at, {day_sql(3)})) and len(domain_ids) > 0 and domain_ids[1] <> 'other'""")
def f5_news_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """news of a day, by batch or by publication date, with a domain."""
    chosen = day(spark, sf_dir, 3)
    on_day = (F.col("snapshot_date") == chosen) | F.col("published_at").startswith(chosen)
    rows = table(spark, sf_dir, "items").where(on_day & (F.size("domain_ids") > 0)).where(F.element_at("domain_ids", 1) != "other")
    return rows.select("item_id", "published_at").distinct()


@query(f"""with {P_SQL} select post_id, case when score is null then 'none' when score >= 100 and num_comments >= 20 then 'ready' else 'low' end as state from p""")
def f10_ready_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a readiness predicate over counts and score."""
    state = F.when(F.col("score").isNull(), "none").when((F.col("score") >= 100) & (F.col("num_comments") >= 20), "ready").otherwise("low")
    return posts_now(spark, sf_dir).select("post_id", state.alias("state"))


@query("select distinct item_id, case when regexp_matches(canonical_url, '^https?://') then canonical_url end as safe_url from items where canonical_url is not null")
def f14_safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """only web addresses survive."""
    rows = table(spark, sf_dir, "items").where("canonical_url is not null")
    return rows.select("item_id", F.when(F.col("canonical_url").rlike("^https?://"), F.col("canonical_url")).alias("safe_url")).distinct()


@query(f"""with {I_SQL} select i.item_id, s.tier, o.n, o.best from i left join sources s using (provider)
left join (select item_id, count(*) as n, max(engagement_percentile) as best from observations group by 1) o using (item_id) where s.tier = 1""")
def j2_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their source and their observations."""
    seen = table(spark, sf_dir, "observations").groupBy("item_id").agg(F.count("*").alias("n"), F.max("engagement_percentile").alias("best"))
    sources = table(spark, sf_dir, "sources").where("tier = 1").select("provider", "tier")
    return items_now(spark, sf_dir).select("item_id", "provider").join(sources, "provider").join(seen, "item_id", "left").select("item_id", "tier", "n", "best")


@query(f"""with {P_SQL}, c as (select distinct * from comments) select p.post_id, count(c.comment_id) as comments, max(c.score) as best from p left join c on c.post_id = p.post_id group by 1""")
def j3_posts_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with their comments counted, before the join, so a hot post is one row."""
    comments = table(spark, sf_dir, "comments").distinct().groupBy("post_id").agg(F.count("comment_id").alias("n"), F.max("score").alias("best"))
    joined = posts_now(spark, sf_dir).select("post_id").join(comments, "post_id", "left")
    return joined.select("post_id", F.coalesce("n", F.lit(0)).alias("comments"), "best")


@query("""select item_id, count(*) as runs from observations o where not exists (select 1 from items i where i.item_id = o.item_id and i.provider like '%forum%') group by 1 having count(*) > 2""")
def j6_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed items that no forum delivered."""
    forum = table(spark, sf_dir, "items").where(F.col("provider").contains("forum")).select("item_id")
    rest = table(spark, sf_dir, "observations").join(forum, "item_id", "left_anti")
    return rest.groupBy("item_id").agg(F.count("*").alias("runs")).where("runs > 2")


@query(f"""with o as (select distinct split_part(run_id, ':', 1) as day, item_id, engagement_percentile as ep from observations),
r as (select *, row_number() over (partition by item_id order by day desc, ep desc nulls last) as rn from o where day <= {day_sql(1)}) select item_id, day, ep from r where rn = 1""")
def j15_asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observation of each item up to a date."""
    rows = table(spark, sf_dir, "observations").select("item_id", F.substring_index("run_id", ":", 1).alias("day"), F.col("engagement_percentile").alias("ep"))
    best = rows.where(F.col("day") <= day(spark, sf_dir, 1)).groupBy("item_id").agg(F.max(F.struct("day", "ep")).alias("b"))
    return best.select("item_id", "b.day", "b.ep")


@query("""with l as (select experiment_id, least(item_id_a, item_id_b) as a, greatest(item_id_a, item_id_b) as b, max(score) as score from cluster_candidate_pairs where item_id_a <> item_id_b group by all)
select experiment_id, sum(case when score >= 0.62 then 1 else 0 end) as accepted, sum(case when score < 0.62 then 1 else 0 end) as rejected, sum(case when score is null then 1 else 0 end) as unknown from l group by 1""")
def j17_pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions per canonical pair, in either order."""
    pairs = table(spark, sf_dir, "cluster_candidate_pairs").where("item_id_a <> item_id_b")
    pairs = pairs.groupBy("experiment_id", F.least("item_id_a", "item_id_b").alias("a"), F.greatest("item_id_a", "item_id_b").alias("b")).agg(F.max("score").alias("score"))
    return pairs.groupBy("experiment_id").agg(F.count_if(F.col("score") >= 0.62).alias("accepted"), F.count_if(F.col("score") < 0.62).alias("rejected"), F.count_if(F.col("score").isNull()).alias("unknown"))


@query(f"with {P_SQL} select subreddit, count(*) as posts, round(avg(score), 4) as avg_score from p group by 1 order by posts desc, subreddit limit 10")
def a1_top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the ten largest sections with their average score."""
    rows = posts_now(spark, sf_dir).groupBy("subreddit").agg(F.count("*").alias("posts"), F.round(F.avg("score"), 4).alias("avg_score"))
    return rows.orderBy(F.desc("posts"), "subreddit").limit(10)


@query(f"""with {I_SQL} select count(*) as items, count(distinct provider) as providers, sum(case when coalesce(excerpt, '') = '' then 1 else 0 end) as bare,
round(sum(case when coalesce(excerpt, '') = '' then 1 else 0 end) / greatest(count(*), 1), 3) as bare_ratio from i""")
def a2_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: counts, conditional counts and a guarded ratio."""
    bare = F.count_if(F.coalesce("excerpt", F.lit("")) == "")
    return items_now(spark, sf_dir).agg(
        F.count("*").alias("items"), F.count_distinct("provider").alias("providers"), bare.alias("bare"), F.round(bare / F.greatest(F.count("*"), F.lit(1)), 3).alias("bare_ratio")
    )


@query("select provider, coalesce(nullif(source_section, ''), provider) as section, count(distinct item_id) as items from items group by 1, 2")
def a3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items per provider and section."""
    section = F.coalesce(F.nullif("source_section", F.lit("")), "provider")
    return table(spark, sf_dir, "items").groupBy("provider", section.alias("section")).agg(F.count_distinct("item_id").alias("items"))


@query(f"""with {I_SQL}, e as (select item_id, provider, liked, unnest(list_distinct(domain_ids)) as domain from i)
select domain, count(*) as items, count(distinct provider) as providers, max(liked) as best from e group by 1""")
def a4_domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: items, providers and best score per domain."""
    rows = items_now(spark, sf_dir).select("item_id", "provider", "liked", F.explode(F.array_distinct("domain_ids")).alias("domain")).where("domain is not null")
    return rows.groupBy("domain").agg(F.count("*").alias("items"), F.count_distinct("provider").alias("providers"), F.max("liked").alias("best"))


@query(f"""with {I_SQL}, e as (select unnest(list_distinct(domain_ids)) as domain, source_cluster from i)
select domain, count(*) filter (source_cluster = 'developers') as developers, count(*) filter (source_cluster = 'business') as business, count(*) filter (source_cluster = 'mainstream') as mainstream,
count(*) filter (source_cluster = 'voices') as voices from e group by 1""")
def a5_domain_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: domain by cluster, dense."""
    rows = items_now(spark, sf_dir).select(F.explode(F.array_distinct("domain_ids")).alias("domain"), "source_cluster").where("domain is not null")
    clusters = ["developers", "business", "mainstream", "voices"]
    return rows.groupBy("domain").agg(*(F.count_if(F.col("source_cluster") == c).alias(c) for c in clusters))


@query("""select experiment_id, coalesce(nullif(reason, ''), 'none') as reason, count(*) as n from cluster_candidate_pairs group by 1, 2""")
def a6_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by reason."""
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit("none"))
    return table(spark, sf_dir, "cluster_candidate_pairs").groupBy("experiment_id", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""with g as (select dedupe_group_id as g, count(distinct item_id) as n, min(provider) as provider from items where dedupe_group_id <> '' group by 1) select provider, count(*) as singles from g where n = 1 group by 1""")
def a7_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one item, by provider."""
    groups = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").groupBy("dedupe_group_id").agg(F.count_distinct("item_id").alias("n"), F.min("provider").alias("provider"))
    return groups.where("n = 1").groupBy("provider").agg(F.count("*").alias("singles"))


@query("""select dedupe_group_id as story_id, source_cluster, count(distinct item_id) as items from items where dedupe_group_id <> '' group by 1, 2""")
def a8_cluster_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the clusters make up a story."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''")
    return rows.groupBy(F.col("dedupe_group_id").alias("story_id"), "source_cluster").agg(F.count_distinct("item_id").alias("items"))


@query("""select dedupe_group_id as story_id, count(distinct provider || ':' || coalesce(nullif(source_section, ''), source_cluster)) as outlets from items
where dedupe_group_id <> '' and source_cluster in ('mainstream', 'business', 'developers') group by 1""")
def a9_mainstream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct outlets per story in the covering clusters."""
    rows = table(spark, sf_dir, "items").where(F.col("source_cluster").isin("mainstream", "business", "developers") & (F.col("dedupe_group_id") != ""))
    outlet = F.concat("provider", F.lit(":"), F.coalesce(F.nullif("source_section", F.lit("")), "source_cluster"))
    return rows.groupBy(F.col("dedupe_group_id").alias("story_id")).agg(F.count_distinct(outlet).alias("outlets"))


@query(f"""with {I_SQL}, e as (select source_cluster, unnest(list_distinct(domain_ids)) as domain from i), c as (select source_cluster, domain, count(*) as n from e group by 1, 2),
r as (select *, row_number() over (partition by source_cluster order by n desc, domain) as rn from c) select source_cluster, domain, n from r where rn <= 3""")
def a10_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the three commonest domains per cluster."""
    counts = items_now(spark, sf_dir).select("source_cluster", F.explode(F.array_distinct("domain_ids")).alias("domain")).groupBy("source_cluster", "domain").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("source_cluster").orderBy(F.desc("n"), "domain")))
    return ranked.where("rn <= 3").select("source_cluster", "domain", "n")


@query(f"""with {P_SQL} select coalesce(link_flair_text, 'none') as flair, count(*) as n, round(avg(score), 1) as avg_score, max(score) as best from p group by 1""")
def a11_flair_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and averages per flair."""
    return posts_now(spark, sf_dir).groupBy(F.coalesce("link_flair_text", F.lit("none")).alias("flair")).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("best")
    )


@query("""select dedupe_group_id as story_id, min(snapshot_date) as first_seen, max(snapshot_date) as last_seen, count(distinct item_id) as items, count(distinct provider) as providers,
array_to_string(list_sort(list_distinct(flatten(list(domain_ids)))), '|') as domains from items where dedupe_group_id <> '' group by 1""")
def a13_story_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story from its items: dates, counts, union of domains. The union is over a fixed set of domains, so it is bounded."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").withColumnRenamed("dedupe_group_id", "story_id")
    facts = rows.groupBy("story_id").agg(F.min("snapshot_date").alias("first_seen"), F.max("snapshot_date").alias("last_seen"), F.count_distinct("item_id").alias("items"), F.count_distinct("provider").alias("providers"))
    domains = rows.select("story_id", F.explode("domain_ids").alias("d")).distinct().groupBy("story_id").agg(F.array_join(F.array_sort(F.collect_set("d")), "|").alias("domains"))
    return facts.join(domains, "story_id", "left").withColumn("domains", F.coalesce("domains", F.lit("")))


@query("""with g as (select dedupe_group_id as g, count(distinct item_id) as n, count(distinct source_cluster) as c from items where dedupe_group_id <> '' group by 1)
select count(*) as stories, sum(n) as items, count(*) filter (n >= 2) as multi, count(*) filter (c >= 2) as cross_cluster, round(count(*) / greatest(sum(n), 1), 4) as compression from g""")
def a14_release_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories, multi-item and cross-cluster stories, compression."""
    stories = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").groupBy("dedupe_group_id").agg(F.count_distinct("item_id").alias("n"), F.count_distinct("source_cluster").alias("c"))
    return stories.agg(
        F.count("*").alias("stories"), F.sum("n").alias("items"), F.count_if(F.col("n") >= 2).alias("multi"), F.count_if(F.col("c") >= 2).alias("cross_cluster"),
        F.round(F.count("*") / F.greatest(F.sum("n"), F.lit(1)), 4).alias("compression"),
    )


@query(f"""with {LABELLED_SQL}, l as (select score >= 0.62 as predicted, label as truth from labelled)
select count(*) filter (predicted and truth) as tp, count(*) filter (predicted and not truth) as fp, count(*) filter (not predicted and truth) as fn, count(*) filter (not predicted and not truth) as tn,
round(count(*) filter (predicted and truth) / greatest(count(*) filter (predicted), 1), 4) as precision, round(count(*) filter (predicted and truth) / greatest(count(*) filter (truth), 1), 4) as recall from l""")
def a17_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix, precision and recall of a threshold against labels that don't come from the score."""
    pairs = labelled(spark, sf_dir).select((F.col("score") >= 0.62).alias("p"), F.col("label").alias("t"))
    p, t = F.col("p"), F.col("t")
    tp = F.count_if(p & t)
    return pairs.agg(
        tp.alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"),
        F.round(tp / F.greatest(F.count_if(p), F.lit(1)), 4).alias("precision"), F.round(tp / F.greatest(F.count_if(t), F.lit(1)), 4).alias("recall"),
    )


@query("""with q as (select quantile_cont(score, [0.05, 0.25, 0.5, 0.75, 0.95]) as v, count(*) filter (score >= 0.62) / count(*) as above from cluster_candidate_pairs where score is not null)
select round(v[1], 9) as p05, round(v[2], 9) as p25, round(v[3], 9) as p50, round(v[4], 9) as p75, round(v[5], 9) as p95, round(above, 6) as above from q""")
def a20_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of pair scores and the share above the threshold."""
    pairs = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null")
    v = F.percentile("score", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("v")
    rows = pairs.agg(v, (F.count_if(F.col("score") >= 0.62) / F.count("*")).alias("above"))
    return rows.select(*(F.round(F.col("v")[i], 9).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))), F.round("above", 6).alias("above"))


@query(f"""with {P_SQL}, t as (select lower(trim(title)) as t, count(distinct lower(subreddit)) as sections, max(score) as best, sum(score) as total from p where length(title) > 20 group by 1)
select post_id, 'score' as kind, score as strength from p where score >= 1000 union all
select min(p.post_id) as post_id, 'repeated' as kind, any_value(t.total) as strength from t join p on lower(trim(p.title)) = t.t and p.score = t.best where t.sections >= 2 group by t.t""")
def a21_virality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viral by score, or by one headline in several sections."""
    posts = posts_now(spark, sf_dir)
    high = posts.where("score >= 1000").select("post_id", F.lit("score").alias("kind"), F.col("score").cast("bigint").alias("strength"))
    titled = posts.where(F.length("title") > 20).groupBy(F.lower(F.trim("title")).alias("t"))
    titled = titled.agg(
        F.count_distinct(F.lower("subreddit")).alias("sections"), F.sum("score").alias("total"), F.min(F.struct(-F.col("score"), "post_id")).alias("best"), F.max("score").alias("top")
    )
    best = posts.where("score is not null").groupBy(F.lower(F.trim("title")).alias("t")).agg(F.min(F.struct((-F.col("score")).alias("s"), "post_id")).alias("first"))
    repeated = titled.where("sections >= 2 and top is not null").join(best, "t").select(F.col("first.post_id"), F.lit("repeated").alias("kind"), F.col("total").alias("strength"))
    return high.union(repeated)


@query(f"""with {I_SQL}, d as (select provider, canonical_url, count(distinct item_id) as n from i where canonical_url <> '' group by 1, 2) select provider, count(*) as shared_urls, max(n) as most from d where n > 1 group by 1""")
def a30_split_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that several items share."""
    shared = items_now(spark, sf_dir).where("canonical_url <> ''").groupBy("provider", "canonical_url").agg(F.count_distinct("item_id").alias("n")).where("n > 1")
    return shared.groupBy("provider").agg(F.count("*").alias("shared_urls"), F.max("n").alias("most"))


@query(f"with {P_SQL} select post_id, round(100 * cume_dist() over (partition by lower(subreddit) order by score), 4) as percentile from p where score is not null")
def w1_section_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the section's posts with at most this score."""
    posts = posts_now(spark, sf_dir).where("score is not null").select("post_id", F.lower("subreddit").alias("section"), "score")
    return scores.with_percentile(posts, "section", "score", "percentile").select("post_id", F.round("percentile", 4).alias("percentile"))


@query(f"""with {I_SQL}, v as (select *, ln(1 + greatest(coalesce(liked, 0), 0)) + 0.5 * ln(1 + greatest(coalesce(discussed, 0), 0)) as e0 from i), u as (select *, round(e0, 9) as e from v),
r as (select item_id, provider, e, rank() over (partition by provider order by e) - 1 + (count(*) over (partition by provider, e) - 1) / 2 as r, count(*) over (partition by provider) as n,
min(e) over (partition by provider) as lo, max(e) over (partition by provider) as hi from u)
select item_id, round(case when lo = hi then 50 else 100 * r / greatest(n - 1, 1) end, 4) as percentile from r""")
def w2_provider_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement percentile within the provider, ties at their average rank."""
    rows = items_now(spark, sf_dir).withColumn("e", F.round(scores.engagement(F.col("liked"), F.col("discussed")), 9))
    rows = scores.with_percentile(rows.select("item_id", "provider", "e"), "provider", "e", "percentile", average=True)
    return rows.select("item_id", F.round("percentile", 4).alias("percentile"))


@query("""with o as (select item_id, list_sort(list(engagement_percentile)) as v from observations where engagement_percentile is not null group by 1) select item_id, v[len(v) // 2 + 1] as upper_median from o""")
def w3_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of an item's percentiles. An item has a value per run, so the list is short."""
    rows = table(spark, sf_dir, "observations").where("engagement_percentile is not null").groupBy("item_id").agg(F.collect_list("engagement_percentile").alias("v"))
    return rows.select("item_id", scores.upper_median(F.col("v")).alias("upper_median"))


@query("""with c as (select i.dedupe_group_id as story, split_part(o.run_id, ':', 1) as day, count(distinct o.item_id) as n, count(distinct i.provider) as p from observations o join (select distinct item_id, dedupe_group_id, provider from items where dedupe_group_id <> '') i using (item_id) group by 1, 2),
l as (select *, lag(n) over w as n0, lag(p) over w as p0, date_diff('day', cast(lag(day) over w as date), cast(day as date)) as gap, min(day) over (partition by story) as first from c window w as (partition by story order by day)),
g as (select *, case when n0 > 0 then (n - n0) / n0 else 1 end as gn, case when p0 > 0 then (p - p0) / p0 else 1 end as gp from l)
select story, day, n as items, p as sources, n0 as items_before, p0 as sources_before, gap::int as gap_days, case when gap >= 14 then 'resurfacing' when first = day then 'new' when n0 is not null and (gn >= 0.3 or gp >= 0.3) then 'growing' when n0 is not null and gn <= -0.3 and gp <= -0.3 then 'fading' else 'stable' end as direction from g""")
def w4_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story's items and sources against the run before it was last seen in."""
    items = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").select("item_id", F.col("dedupe_group_id").alias("story"), "provider").distinct()
    rows = table(spark, sf_dir, "observations").select("item_id", F.substring_index("run_id", ":", 1).alias("day")).join(items, "item_id")
    rows = rows.groupBy("story", "day").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("provider").alias("sources"))
    runs = Window.partitionBy("story").orderBy("day")
    rows = rows.withColumns({
        "items_before": F.lag("items").over(runs), "sources_before": F.lag("sources").over(runs), "first": F.min("day").over(Window.partitionBy("story")),
        "gap_days": F.date_diff(F.to_date("day"), F.to_date(F.lag("day").over(runs))),
    })
    way = scores.direction(*(F.col(c) for c in ("first", "day", "items", "sources", "items_before", "sources_before", "gap_days")))
    return rows.select("story", "day", "items", "sources", "items_before", "sources_before", "gap_days", way.alias("direction"))


@query("""with c as (select unnest(domain_ids) as trend, snapshot_date as day, count(distinct dedupe_group_id) as n from items where dedupe_group_id <> '' group by 1, 2),
l as (select *, lag(n) over w as n0, coalesce(date_diff('day', cast(lag(day) over w as date), cast(day as date)), 0) as gap, dense_rank() over (order by day) as release from c window w as (partition by trend order by day))
select trend, day, n as stories, n0 as before, gap::int as gap_days, case when release <= 7 then 'insufficient_history' when n0 is null then 'new' when gap >= 7 and n >= 2 then 'resurfacing' when n / greatest(n0, 1) >= 1.5 then 'growing' when n / greatest(n0, 1) < 0.75 and gap >= 2 then 'fading' else 'stable' end as lifecycle from l""")
def w7_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trend of stories against its last release; the first seven releases are too short a history."""
    rows = table(spark, sf_dir, "items").where("dedupe_group_id <> ''").select(F.explode("domain_ids").alias("trend"), F.col("snapshot_date").alias("day"), "dedupe_group_id")
    rows = rows.groupBy("trend", "day").agg(F.count_distinct("dedupe_group_id").alias("stories"))
    days = [r["day"] for r in rows.select("day").distinct().orderBy("day").limit(8).collect()]
    ready = F.col("day") > F.lit(days[6]) if len(days) > 7 else F.lit(False)
    runs = Window.partitionBy("trend").orderBy("day")
    rows = rows.withColumns({"before": F.lag("stories").over(runs), "gap_days": F.coalesce(F.date_diff(F.to_date("day"), F.to_date(F.lag("day").over(runs))), F.lit(0))})
    return rows.select("trend", "day", "stories", "before", "gap_days", scores.lifecycle(ready, F.col("stories"), F.col("before"), F.col("gap_days")).alias("lifecycle"))


@query("""with d as (select distinct lower(subreddit) as s, cast(snapshot_date as date) as day from posts),
w as (select s, day, (select max(e.day) from d e where e.s = d.s and e.day < d.day and e.day >= d.day - 7) as seen from d) select s as section, cast(day as varchar) as day, seen is null as novel from w""")
def w6_seven_day_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a section was absent in the seven days before."""
    days = table(spark, sf_dir, "posts").select(F.lower("subreddit").alias("section"), _day("snapshot_date").alias("d")).distinct()
    week = Window.partitionBy("section").orderBy(F.unix_date("d")).rangeBetween(-7, -1)
    return days.select("section", F.col("d").cast("string").alias("day"), F.max("d").over(week).isNull().alias("novel"))


@query("""with d as (select item_id, list_sort(list_distinct(list(split_part(run_id, ':', 1)))) as days from observations group by 1)
select item_id, days[len(days) // 2 + 1] as middle, len(list_filter(days, lambda x: x < days[len(days) // 2 + 1])) as early, len(list_filter(days, lambda x: x >= days[len(days) // 2 + 1])) as late from d where len(days) >= 2""")
def w8_early_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs before and from the middle date. The dates of a record are few."""
    rows = table(spark, sf_dir, "observations").groupBy("item_id").agg(F.array_sort(F.collect_set(F.substring_index("run_id", ":", 1))).alias("days"))
    rows = rows.where(F.size("days") >= 2).withColumn("middle", F.element_at("days", (F.floor(F.size("days") / 2) + 1).cast("int")))
    early = F.size(F.expr("filter(days, x -> x < middle)"))
    return rows.select("item_id", "middle", early.alias("early"), (F.size("days") - early).alias("late"))


@query(f"""with {P_SQL}, r as (select post_id, lower(subreddit) as section, score, row_number() over (partition by lower(subreddit) order by score desc nulls last, post_id) as rn from p) select post_id, section, score from r where rn <= 3""")
def w9_top_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best posts of each section."""
    rows = posts_now(spark, sf_dir).select("post_id", F.lower("subreddit").alias("section"), "score")
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc_nulls_last("score"), "post_id"))
    return rows.withColumn("rn", rank).where("rn <= 3").select("post_id", "section", "score")


@query(f"""with {I_SQL}, n as (select item_id, date_diff('day', cast(snapshot_date as date), cast({day_sql()} as date)) as d from i)
select item_id, case when d <= 0 then 100 when d <= 1 then 80 when d <= 3 then 55 when d <= 7 then 30 else 10 end as novelty from n""")
def w11_novelty_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty by age in days."""
    days = F.date_diff(F.lit(day(spark, sf_dir)).cast("date"), F.col("snapshot_date").cast("date"))
    return items_now(spark, sf_dir).select("item_id", scores.novelty_by_age(days).alias("novelty"))


@query(f"with {I_SQL} select item_id, liked, discussed from i order by liked desc nulls last, discussed desc nulls last, item_id limit 100")
def t1_multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several keys, each with its direction, ties by id."""
    return items_now(spark, sf_dir).select("item_id", "liked", "discussed").orderBy(F.desc_nulls_last("liked"), F.desc_nulls_last("discussed"), "item_id").limit(100)


@query("""with l as (select experiment_id, item_id_a, item_id_b, max(score) as score from cluster_candidate_pairs where score is not null group by all) select experiment_id, item_id_a, item_id_b, score from l
order by round(abs(score - 0.82), 9), experiment_id, item_id_a, item_id_b limit 60""")
def t3_nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs nearest the decision boundary."""
    pairs = table(spark, sf_dir, "cluster_candidate_pairs").where("score is not null").groupBy("experiment_id", "item_id_a", "item_id_b").agg(F.max("score").alias("score"))
    return pairs.orderBy(F.round(F.abs(F.col("score") - 0.82), 9), "experiment_id", "item_id_a", "item_id_b").limit(60)


@query(f"""with {I_SQL}, r as (select item_id, provider, row_number() over (partition by provider order by sha256(item_id), item_id) as rn from i) select item_id, provider, rn from r order by rn, provider limit 120""")
def t6_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata in turn, each in hashed order."""
    order = Window.partitionBy("provider").orderBy(F.sha2("item_id", 256), "item_id")
    return items_now(spark, sf_dir).select("item_id", "provider", F.row_number().over(order).alias("rn")).orderBy("rn", "provider").limit(120)


@query(f"""with s as (select distinct snapshot_id, post_id from posts), a as (select post_id from s where snapshot_id = {snapshot_sql(1)}), b as (select post_id from s where snapshot_id = {snapshot_sql()})
select 'gone' as side, post_id from (select post_id from a except select post_id from b) union all select 'kept', post_id from (select post_id from a intersect select post_id from b)""")
def u4_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference and intersection of two snapshots."""
    of = lambda k: table(spark, sf_dir, "posts").where(F.col("snapshot_id") == k).select("post_id")
    old, new = of(snapshot(spark, sf_dir, 1)), of(snapshot(spark, sf_dir))
    gone, kept = old.subtract(new), old.intersect(new)
    return gone.select(F.lit("gone").alias("side"), "post_id").unionByName(kept.select(F.lit("kept").alias("side"), "post_id"))


@query("""with a as (select item_id, list_sort(list_distinct(flatten(list(domain_ids)))) as d from items group by 1)
select item_id, len(list_intersect(d, ['ai', 'science', 'business'])) as shared, len(list_filter(d, lambda x: not list_contains(['ai', 'science', 'business'], x))) = 0 as inside from a""")
def u3_array_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered-distinct union of lists, intersection size and subset test."""
    rows = table(spark, sf_dir, "items").groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("domain_ids")))).alias("d"))
    some = F.array(F.lit("ai"), F.lit("science"), F.lit("business"))
    return rows.select("item_id", F.size(F.array_intersect("d", some)).alias("shared"), (F.size(F.array_except("d", some)) == 0).alias("inside"))


@query(f"""with {P_SQL}, n as (select count(*) as other from p where lower(subreddit) not like '%hq%'),
r as (select post_id, subreddit, row_number() over (order by score desc nulls last, post_id) as rn from p where lower(subreddit) like '%hq%')
select post_id from p where lower(subreddit) not like '%hq%' union all select post_id from r, n where rn <= floor(other * 3 / 7)""")
def o12_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of source is held to 30 % of the list; its best rows stay."""
    posts = posts_now(spark, sf_dir)
    is_kind = F.lower("subreddit").contains("hq")
    other = posts.where(~is_kind | F.col("subreddit").isNull())
    allowed = int(other.count() * 3 / 7)
    ranked = numbered(posts.where(is_kind).select("post_id", "score"), [F.desc_nulls_last("score"), F.col("post_id")])
    return other.select("post_id").union(ranked.where(F.col("n") <= allowed).select("post_id"))


@query(f"""with {P_SQL}, s1 as (select post_id, 'hot' as shelf from p where score >= 100 order by score desc, post_id limit 6),
s2 as (select post_id, 'talk' as shelf from p where num_comments >= 10 and post_id not in (select post_id from s1) order by num_comments desc, post_id limit 6),
s3 as (select post_id, 'liked' as shelf from p where upvote_ratio >= 0.9 and post_id not in (select post_id from s1) and post_id not in (select post_id from s2) order by upvote_ratio desc, post_id limit 6)
select * from s1 union all select * from s2 union all select * from s3""")
def o13_shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered shelves of at most six, no post on two."""
    rest, out = posts_now(spark, sf_dir), None
    for shelf, rule, key in (("hot", "score >= 100", "score"), ("talk", "num_comments >= 10", "num_comments"), ("liked", "upvote_ratio >= 0.9", "upvote_ratio")):
        chosen = rest.where(rule).orderBy(F.desc(key), "post_id").limit(6).select("post_id")
        out = chosen.withColumn("shelf", F.lit(shelf)) if out is None else out.union(chosen.withColumn("shelf", F.lit(shelf)))
        rest = rest.join(chosen, "post_id", "left_anti")
    return out
