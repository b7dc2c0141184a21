"""Queries of the scalar functions: text, addresses, classification, hashes, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import classify, ids, scores, text, urls
from corvane.plans.base import I_SQL, P_SQL, items_now, posts_now
from corvane.operators.similar import distinct_sets, jaccard_pairs, repetition, seen_before
from corvane.runtime import Scratch, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_CASES = " ".join(
    [f"when lower(coalesce(subreddit, '')) in ({_quoted(s.split())}) then '{k}'" for k, s in classify.SIGNAL_SECTIONS]
    + ["when regexp_matches(t, '" + p.replace("'", "''") + f"') then '{k}'" for k, p in classify.SIGNAL_PATTERNS]
)
_BARE_SQL = rf"""regexp_replace(lower(coalesce(title, '')), '(?:[\s\-–—|]\s*(?:{text.PUBLISHERS})\s*)+$', '')"""
_PART_SQL = f"(case when trim(split_part({_BARE_SQL}, '|', 1)) in ({_quoted(text.GENERIC_TITLES)}) and trim(split_part({_BARE_SQL}, '|', 2)) <> '' then trim(split_part({_BARE_SQL}, '|', 2)) when contains({_BARE_SQL}, '|') and trim(split_part({_BARE_SQL}, '|', 1)) <> '' then trim(split_part({_BARE_SQL}, '|', 1)) else {_BARE_SQL} end)"
_TITLE_SQL = rf"""trim(regexp_replace(regexp_replace({_PART_SQL}, 'https?://\S+', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"""
_WORDS_SQL = f"list_filter(string_split({_TITLE_SQL}, ' '), lambda w: (length(w) >= 3 or w = 'ai') and w not in ({_quoted(text.STOPWORDS.split())}))"


@query(f"with {P_SQL} select post_id, array_to_string({_WORDS_SQL}, ' ') as normalized from p")
def c1_normalized_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised titles."""
    return posts_now(spark, sf_dir).select("post_id", text.normalized_title(F.col("title")).alias("normalized"))


@query(f"with {P_SQL} select post_id, array_to_string({_WORDS_SQL}[1:5], ' ') as raw_key from p")
def c7_canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five informative words."""
    return posts_now(spark, sf_dir).select("post_id", text.canonical_key(F.col("title")).alias("raw_key"))


@query(rf"""with {P_SQL}, e as (select post_id, unnest(list_distinct(list_transform(regexp_extract_all(regexp_replace(title, '[^\x00-\x7f]', ' ', 'g'), '{text.ENTITY}'), lambda x: lower(x)))) as entity from p) select entity, count(*) as n from e group by 1""")
def c3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of titles, counted."""
    rows = posts_now(spark, sf_dir).select("post_id", F.explode(text.entities(F.col("title"))).alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("n"))


PULSE_SQL = "list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9''_-]*'), lambda x: length(x) > 1))"


@query(f"""with {P_SQL}, t as (select distinct list_sort({PULSE_SQL}) as w from p), s as (select w, array_to_string(w, ' ') as k from t where len(w) > 0),
j as (select x.k as a, y.k as b, len(list_intersect(x.w, y.w)) as n, len(x.w) + len(y.w) as m from s x join s y on x.k < y.k and len(x.w) * 10 >= len(y.w) * 3 and len(y.w) * 10 >= len(x.w) * 3)
select a as words_a, b as words_b, round(n / (m - n), 6) as jaccard from j where n * 10 >= (m - n) * 3""")
def c4_title_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct titles, as word sets, with a Jaccard similarity of .3 or more."""
    sets = distinct_sets(posts_now(spark, sf_dir).select(text.pulse_tokens(F.col("title")).alias("w")), "w")
    named = sets.select("set_id", F.array_join("words", " ").alias("k"))
    pairs = jaccard_pairs(sets, 3, 10).join(named.toDF("a", "ka"), "a").join(named.toDF("b", "kb"), "b")
    return pairs.select(F.least("ka", "kb").alias("words_a"), F.greatest("ka", "kb").alias("words_b"), F.round("jaccard", 6).alias("jaccard"))


@query(f"with {P_SQL}, t as (select post_id, {_WORDS_SQL} as w from p) select post_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) as shingle from t where len(w) >= 3")
def c10_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles of titles."""
    words = F.filter(F.split(text.normalized_title(F.col("title")), " "), lambda w: w != "")
    return posts_now(spark, sf_dir).select("post_id", F.explode(F.array_distinct(text.shingles(words, 3))).alias("shingle"))


SIGNAL_SQL = f"with {P_SQL}, x as (select *, lower(concat_ws(' ', title, selftext)) as t from p) select post_id, case {_CASES} when coalesce(url, '') <> '' and not starts_with(url, 'https://forum.example/') then 'news_link' when coalesce(is_self, false) then 'discussion' else 'other' end as signal_type from x"


@query(SIGNAL_SQL)
def c12_signal_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of every post."""
    kind = classify.signal_type(F.col("title"), F.col("selftext"), F.col("subreddit"), F.col("url"), F.col("is_self"))
    return posts_now(spark, sf_dir).select("post_id", kind.alias("signal_type"))


def _domain_sql() -> str:
    score = lambda ks: " + ".join(f"(case when list_contains(w, '{k}') then 1 else 0 end)" if " " not in k else f"(case when contains(s, '{k}') then 2 else 0 end)" for k in ks)
    parts = []
    for n, (domain, keywords) in enumerate(classify.DOMAINS.items()):
        more = " + (case when regexp_matches(s, 'nba|nfl|mlb|nhl|fifa|uefa|soccer|tennis') then 3 else 0 end)" if domain == "sports" else ""
        parts.append(f"select item_id, {n} as o, '{domain}' as d, {score(keywords.split(', '))}{more} as v from w")
    return f"""with {I_SQL}, t as (select item_id, regexp_extract_all(lower(concat_ws(' ', title, excerpt)), '[a-zа-я0-9$%.-]+') as k from i),
w as (select item_id, list_concat(k, list_transform(list_filter(k, lambda x: length(x) > 4 and ends_with(x, 's') and not regexp_matches(x, '(ss|us|is|news)$')), lambda x: x[:-2])) as w, array_to_string(k, ' ') as s from t),
v as ({' union all '.join(parts)}), r as (select *, row_number() over (partition by item_id order by v desc, o) as rn from v where v > 0)
select i.item_id, coalesce(string_agg(r.d, '|' order by r.rn), 'other') as domains from i left join r on r.item_id = i.item_id and r.rn <= 3 group by 1"""


DOMAIN_SQL = _domain_sql()


@query(DOMAIN_SQL)
def c13_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three domains of every item."""
    return classify.with_domains(items_now(spark, sf_dir), "title", "excerpt", "found").select("item_id", F.array_join("found", "|").alias("domains"))


_PAIN_SQL = ", ".join(f"case when contains(t, '{t}') then '{label}' end" for t, label in classify.PAINS)


@query(f"""with {I_SQL}, x as (select item_id, lower(concat_ws(' ', title, excerpt)) as t from i), l as (select item_id, list_filter([{_PAIN_SQL}], lambda x: x is not null) as v from x),
e as (select item_id, v, unnest(list_distinct(v)) as pain from l), r as (select item_id, pain, row_number() over (partition by item_id order by list_position(v, pain)) as k from e) select item_id, pain, k from r where k <= 5""")
def c16_pain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pain points of an item, with their place."""
    pains = classify.pain_points(F.concat_ws(" ", "title", "excerpt"))
    return items_now(spark, sf_dir).select("item_id", F.posexplode(pains).alias("k", "pain")).withColumn("k", F.col("k") + 1)


_ACTION_SQL = "case " + " ".join(f"when regexp_matches(' ' || lower({{0}}) || ' ', ' ({w}) ') then '{a}'" for a, w in classify.ACTIONS) + " end"
_PLACE_SQL = "list_sort(list_distinct(list_filter([" + ", ".join(rf"case when regexp_matches(lower({{0}}), '\b{h.replace('.', chr(92) + '.')}\b') then '{p}' end" for h, p in classify.PLACES.items()) + "], lambda x: x is not null)))[1:8]"


@query(f"with {I_SQL}, x as (select item_id, concat_ws('. ', title, excerpt) as t from i) select item_id, {_ACTION_SQL.format('t')} as action, array_to_string({_PLACE_SQL.format('t')}, '|') as places from x")
def c18_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action and the places that an item's title and excerpt name."""
    body = F.concat_ws(". ", "title", "excerpt")
    return items_now(spark, sf_dir).select("item_id", classify.action_hint(body).alias("action"), F.array_join(classify.places(body), "|").alias("places"))


@query()
def c19_typed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of titles by kind, amount and unit."""
    return items_now(spark, sf_dir).select("item_id", F.inline(classify.typed_numbers(F.col("title"))))


@query(f"with {I_SQL} select item_id, lower(trim(coalesce(source_section, ''))) in ({_quoted(classify.ROUTINE_SECTIONS.split())}) or regexp_matches(lower(title), '{classify.ROUTINE}') as routine from i")
def f8_routine_beat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: routine material."""
    return items_now(spark, sf_dir).select("item_id", classify.is_routine(F.col("title"), F.col("source_section")).alias("routine"))


_LOW_SQL = "|".join(text.LOW_SIGNAL).replace("'", "''")


@query(f"with {I_SQL}, t as (select item_id, trim(lower(coalesce(title, ''))) as low, {_WORDS_SQL} as w from i) select item_id, array_to_string(w, ' ') in ({_quoted(text.GENERIC_TITLES)}) or len(list_filter(w, lambda x: x <> '')) < 3 as generic, regexp_matches(low, '{_LOW_SQL}') as low_signal from t")
def f7_generic_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles too general to match by, and titles of listings, threads and newsletters."""
    return items_now(spark, sf_dir).select("item_id", text.is_generic(text.normalized_title(F.col("title"))).alias("generic"), text.is_low_signal(F.col("title")).alias("low_signal"))


@query(rf"with {I_SQL} select item_id, len(list_filter(string_split_regex(lower(title), '\s+'), lambda x: regexp_matches(x, '\p{{L}}'))) < 3 or regexp_matches(lower(title), '{'|'.join(classify.QUEUE_MARKERS)}') as low_signal from i")
def f9_low_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles of under three words with letters, or of recurring threads."""
    return items_now(spark, sf_dir).select("item_id", classify.is_housekeeping(F.col("title")).alias("low_signal"))


@query(rf"with {I_SQL}, t as (select item_id, list_distinct(list_transform(regexp_extract_all(regexp_replace(title, '[^\x00-\x7f]', ' ', 'g'), '{text.ENTITY}'), lambda x: lower(x))) as e from i) select item_id, array_to_string(list_sort(list_filter(e, lambda x: length(x) >= 2 and x not in ({_quoted(text.GENERIC_ENTITIES.split())}) and x not in ({_quoted(text.GENERIC_ANCHORS)}))), '|') as anchors from t")
def f11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a title that can anchor a story."""
    found = F.filter(text.meaningful_entities(F.col("title")), text.is_anchor)
    return items_now(spark, sf_dir).select("item_id", F.array_join(F.array_sort(found), "|").alias("anchors"))


_PROMPT_SQL = " or ".join(f"starts_with(t, '{x.replace(chr(39), chr(39) * 2)}')" for x in classify.PROMPTS)


@query(f"with {I_SQL}, t as (select item_id, ltrim(replace(lower(title), '’', chr(39))) as t from i) select item_id, {_PROMPT_SQL} as prompt from t")
def f12_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles that prompt a discussion."""
    return items_now(spark, sf_dir).select("item_id", classify.is_prompt(F.col("title")).alias("prompt"))


_RUBRIC_SQL = "case " + " ".join(f"when split_part(domains, '|', 1) in ({_quoted(ids)}) then '{name}'" for name, ids in classify.RUBRICS) + " else 'other' end"


@query(f"""with d as ({_domain_sql()}), {I_SQL}, x as (select item_id, title, source_section, lower(concat_ws(' ', title, excerpt)) as t, concat_ws('. ', title, excerpt) as b from i), l as (select *, list_filter([{_PAIN_SQL}], lambda x: x is not null) as v from x)
select l.item_id, d.domains, {_RUBRIC_SQL} as rubric, array_to_string(list_filter(v, lambda x, k: list_position(v, x) = k)[1:5], '|') as pains, {_ACTION_SQL.format('b')} as action, array_to_string({_PLACE_SQL.format('b')}, '|') as places,
lower(trim(coalesce(source_section, ''))) in ({_quoted(classify.ROUTINE_SECTIONS.split())}) or regexp_matches(lower(title), '{classify.ROUTINE}') as routine from l join d using (item_id)""")
def o19_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facets of an item in one pass."""
    rows = classify.with_domains(items_now(spark, sf_dir), "title", "excerpt", "found")
    body = F.concat_ws(". ", "title", "excerpt")
    return rows.select(
        "item_id", F.array_join("found", "|").alias("domains"), classify.rubric(F.col("found")).alias("rubric"), F.array_join(classify.pain_points(F.concat_ws(" ", "title", "excerpt")), "|").alias("pains"),
        classify.action_hint(body).alias("action"), F.array_join(classify.places(body), "|").alias("places"), classify.is_routine(F.col("title"), F.col("source_section")).alias("routine"),
    )


_URL = r"'^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
_HOSTS = "case h " + " ".join(f"when '{a}' then '{b}'" for a, b in urls.HOSTS.items()) + " else h end"


@query(rf"""with u as (select distinct canonical_url as url from items where canonical_url is not null),
x as (select url, regexp_extract(url, {_URL}, 1) as s, lower(trim(regexp_extract(url, {_URL}, 2))) as h, regexp_extract(url, {_URL}, 3) as p, regexp_extract(url, {_URL}, 4) as q from u),
y as (select *, array_to_string(list_filter(string_split(q, '&'), lambda z: regexp_matches(z, '^[^=]+=.') and not regexp_matches(lower(z), '^(?:{'|'.join(urls.TRACKING.split())})=')), '&') as k from x)
select url, case when s = '' then '' else 'https://' || {_HOSTS} || case when p = '/' then p else regexp_replace(p, '/+$', '') end || case when k <> '' then '?' || k else '' end end as canonical from y""")
def c23_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical addresses."""
    rows = table(spark, sf_dir, "items").where("canonical_url is not null").select(F.col("canonical_url").alias("url")).distinct()
    return rows.select("url", urls.canonical_url(F.col("url")).alias("canonical"))


@query(rf"""with {I_SQL} select item_id, case when regexp_extract(coalesce(canonical_url, ''), '^https?://([^/?#]+)', 1) <> '' then lower(regexp_extract(canonical_url, '^https?://([^/?#]+)', 1) || regexp_replace(regexp_extract(canonical_url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')) else substr(lower(trim(title)), 1, 120) end as reading_key from i""")
def c22_reading_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key by which a reader has seen an item."""
    return items_now(spark, sf_dir).select("item_id", urls.reading_key(F.col("canonical_url"), F.col("title")).alias("reading_key"))


@query(rf"""with {I_SQL}, p as (select item_id, lower(regexp_extract(coalesce(canonical_url, ''), '^https?://([^/?#:]*)', 1)) as h, list_filter(string_split(regexp_extract(coalesce(canonical_url, ''), '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda z: z <> '') as p from i)
select item_id, len(p) = 0 or (h in ({_quoted(urls.CODE_HOSTS)}) and len(p) <= 2) or (h in ({_quoted(urls.MODEL_HOSTS)}) and (len(p) <= 2 or (len(p) <= 3 and p[1] in ('datasets', 'spaces')))) as lasting, h in ({_quoted(urls.MODEL_HOSTS)}) and len(p) = 2 as model from p""")
def f13_lasting_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses that tell no event, and those of models."""
    url = F.coalesce("canonical_url", F.lit(""))
    return items_now(spark, sf_dir).select("item_id", urls.is_lasting(url).alias("lasting"), urls.is_model(url).alias("model"))


@query(rf"""with {I_SQL}, u as (select item_id, list_distinct(list_filter([regexp_replace(coalesce(canonical_url, ''), '/+$', ''), regexp_replace(coalesce(target_url, ''), '/+$', '')], lambda z: z <> '' and not contains(z, '://forum.example/'))) as s from i) select item_id, len(s) as outside from u""")
def x21_url_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside addresses of an item."""
    return items_now(spark, sf_dir).select("item_id", F.size(urls.url_set(F.col("canonical_url"), F.col("target_url"))).alias("outside"))


@query(f"with {I_SQL} select item_id, substr(sha256(coalesce(provider, '') || '|' || coalesce(title, '')), 1, 20) as stable_id from i")
def c24_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids."""
    return items_now(spark, sf_dir).select("item_id", ids.stable_id(F.col("provider"), F.col("title")).alias("stable_id"))


def _near_keys(titles: DataFrame) -> DataFrame:
    """(post_id, mark, band): fingerprint of a title's words and shingles (t), with each of its near-duplicate keys."""
    marked = titles.withColumn("mark", text.simhash(text.near_features(F.split("t", " "))))
    keys = F.concat(text.bands(F.col("mark")), text.min_hashes(F.split("t", " ")))
    return marked.select("post_id", "mark", F.explode(keys).alias("band"))


@query()
def c26_fingerprint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that share a band of the fingerprint or one of the four least shingle hashes and differ in at most 18 bits; identical titles count once."""
    titles = posts_now(spark, sf_dir).groupBy(text.normalized_title(F.col("title")).alias("t")).agg(F.min("post_id").alias("post_id")).where("t <> ''")
    keyed = _near_keys(titles)
    a = keyed.select("band", F.col("post_id").alias("post_a"), F.col("mark").alias("x"))
    b = keyed.select("band", F.col("post_id").alias("post_b"), F.col("mark").alias("y"))
    near = text.hamming(F.col("x"), F.col("y"))
    return a.join(b, "band").where("post_a < post_b").where(near <= 18).select("post_a", "post_b", near.alias("distance")).distinct()


@query(f"with {I_SQL} select item_id, round(ln(1 + greatest(coalesce(liked, 0), 0)) + 0.5 * ln(1 + greatest(coalesce(discussed, 0), 0)), 6) as engagement from i")
def c29_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement."""
    return items_now(spark, sf_dir).select("item_id", F.round(scores.engagement(F.col("liked"), F.col("discussed")), 6).alias("engagement"))


_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


@query(f"""with {P_SQL}, t as (select *, lower(subreddit) as s, {PULSE_SQL} as w, case when regexp_matches(created_utc, '{_ISO}') and try_cast(created_utc as timestamptz) is not null then greatest(1, (epoch(cast(snapshot_date || 'T23:59:59Z' as timestamptz)) - epoch(try_cast(created_utc as timestamptz))) / 3600) else 24 end as h from p),
o as (select distinct {PULSE_SQL} as w from posts where snapshot_id < (select max(snapshot_id) from posts) and cast(snapshot_date as date) >= (select max(cast(snapshot_date as date)) from posts) - 7 and title is not null),
r as (select a.post_id, least(4, count(distinct b.s)) * 0.25 as repetition from t a join t b on a.s <> b.s and len(a.w) > 0 and len(list_intersect(a.w, b.w)) * 2 >= len(list_distinct(list_concat(a.w, b.w))) group by 1),
n as (select distinct a.post_id from t a join o on len(a.w) > 0 and len(list_intersect(a.w, o.w)) * 5 >= len(list_distinct(list_concat(a.w, o.w))) * 3),
x as (select t.post_id, 100 * cume_dist() over (partition by s order by coalesce(score, 0)) as pct, coalesce(num_comments, 0) / h as v, case when coalesce(upvote_ratio, 0.5) < 0.5 then 0 else ln(1 + coalesce(num_comments, 0)) * least(coalesce(upvote_ratio, 0.5), 1) end as d,
coalesce(repetition, 0) as repetition, case when len(w) = 0 then 0.5 when n.post_id is not null then 0 else 1 end as novelty from t left join r using (post_id) left join n using (post_id))
select post_id, round(pct, 4) as percentile, round(v, 4) as velocity, round(d, 4) as depth, repetition::double as repetition, novelty::double as novelty, round(least(100, 0.3 * pct + 0.25 * least(v * 10, 100) + 0.2 * least(d * 10, 100) + 0.15 * repetition * 100 + 0.1 * novelty * 100), 4) as pulse from x""")
def c32_pulse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse of every post of the last snapshot and its parts.

    The age ends with the snapshot's day; a time not written in ISO form counts as 24 hours.
    Repetition: similar titles in other sections; novelty: none like it in the seven days before.
    """
    posts = posts_now(spark, sf_dir).withColumn("w", text.pulse_tokens(F.col("title"))).withColumn("s", F.lower("subreddit"))
    posts = Scratch(spark, "pulse").save(posts, "posts")  # read for each part
    last = table(spark, sf_dir, "posts").agg(F.max("snapshot_id").alias("id"), F.max("snapshot_date").alias("day")).first()
    history = table(spark, sf_dir, "posts").where((F.col("snapshot_id") < last["id"]) & (F.to_date("snapshot_date") >= F.date_sub(F.lit(last["day"]).cast("date"), 7)) & F.col("title").isNotNull())
    repeated = repetition(posts.select("post_id", "s", "w"), "post_id", "s", "w").withColumn("repetition", F.col("sections") * 0.25)
    seen = seen_before(posts.select("post_id", "w"), history.select(text.pulse_tokens(F.col("title")).alias("w")), "post_id", "w").withColumn("seen", F.lit(True))
    posts = posts.join(repeated.select("post_id", "repetition"), "post_id", "left").join(seen, "post_id", "left")
    zero = F.lit(0)
    posts = scores.with_percentile(posts.withColumn("score", F.coalesce("score", zero)), "s", "score", "percentile").withColumns({
        "repetition": F.coalesce("repetition", F.lit(0.0)),
        "velocity": scores.velocity(F.coalesce("num_comments", zero), scores.age_hours(F.col("created_utc"), F.col("snapshot_date"), _ISO)),
        "depth": scores.discussion_depth(F.col("num_comments"), F.coalesce("upvote_ratio", F.lit(0.5))), "novelty": F.when(F.size("w") == 0, 0.5).when(F.col("seen"), 0.0).otherwise(1.0),
    })
    pulse = scores.pulse_score(*(F.col(c) for c in ("percentile", "velocity", "depth", "repetition", "novelty")))
    parts = [F.round(c, 4).alias(c) for c in ("percentile", "velocity", "depth")]
    return posts.select("post_id", *parts, "repetition", "novelty", F.round(pulse, 4).alias("pulse"))


_GAP_OK = "(select count(*) filter (source_cluster = 'voices') > 0 and count(*) filter (source_cluster = 'mainstream') >= greatest(100, 0.2 * count(*) filter (source_cluster = 'voices')) from (select distinct item_id, source_cluster from items))"


@query(f"""with g as (select dedupe_group_id as g, max(coalesce(raw_engagement['score'], raw_engagement['points'], raw_engagement['votes'], 0)) as best, count(distinct provider) filter (source_cluster = 'mainstream') as cov from items where dedupe_group_id <> '' group by 1)
select g as story_id, round(case when {_GAP_OK} then least(best, 100) / 100 * (1 - least(cov, 5) / 5) else 0 end, 4) as gap from g""")
def c34_perspective_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud stories without mainstream coverage; 0 where the collection has too few mainstream items to tell."""
    liked = F.coalesce(*(F.try_element_at("raw_engagement", F.lit(k)) for k in ("score", "points", "votes")), F.lit(0.0))
    items = table(spark, sf_dir, "items")
    voices, mainstream = items.select("item_id", "source_cluster").distinct().agg(F.count_if(F.col("source_cluster") == "voices"), F.count_if(F.col("source_cluster") == "mainstream")).first()
    rows = items.where("dedupe_group_id <> ''").groupBy(F.col("dedupe_group_id").alias("story_id"))
    rows = rows.agg(F.max(liked).alias("best"), F.count_distinct(F.when(F.col("source_cluster") == "mainstream", F.col("provider"))).alias("cov"))
    gap = scores.perspective_gap(F.least("best", F.lit(100.0)), F.col("cov")) if scores.gap_available(voices, mainstream) else F.lit(0.0)
    return rows.select("story_id", F.round(gap, 4).alias("gap"))


@query("""with n as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as k, label from embeddings), c as (select label, k, avg(x) as m from n group by 1, 2),
s as (select label, sqrt(sum(m * m)) as l from c group by 1) select c.label, c.k as position, round(c.m / s.l, 6) as value from c join s using (label)""")
def a25_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised mean vector of each label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    means = rows.groupBy("label", (F.col("k") + 1).alias("position")).agg(F.avg(F.col("x").cast("double")).alias("m"))
    norms = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return means.join(norms, "label").select("label", "position", F.round(F.col("m") / F.col("norm"), 6).alias("value"))


@query("""select item_id, json_valid(metadata) as valid, coalesce(try_cast(metadata as json) ->> '$.is_self', 'none') as is_self from (select distinct item_id, metadata from items where metadata is not null) where json_valid(metadata)""")
def c39_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path in JSON text with a default; broken texts are left out."""
    rows = table(spark, sf_dir, "items").where("metadata is not null").select("item_id", "metadata").distinct()
    rows = rows.where(F.try_parse_json("metadata").isNotNull())
    return rows.select("item_id", F.lit(True).alias("valid"), F.coalesce(F.get_json_object("metadata", "$.is_self"), F.lit("none")).alias("is_self"))
