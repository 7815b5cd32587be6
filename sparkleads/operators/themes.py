"""Recurring title themes: terms that leads share more than the rest of the corpus, and scores of items by them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite, fixed, item_url, normal_category, parent_url, safe_ratio
from ..functions.text import STOPWORD_LISTS, ngrams, signature, stopwords_for, tokens
from .latest import best_per_key, collapse_titles, fold_saturated
from .ranking import medians, quantiles
from .settle import settled, small

THEME_COLUMNS = ["term", "ngram_size", "lead_count", "lead_share", "background_share", "lift", "burst", "median_views", "median_views_per_sub", "distinct_channels", "channel_hhi", "effective_channels", "example_titles", "example_video_ids"]
SATURATION_COLUMNS = ["category_id", "category_name", "distinct_channels", "outlier_channels", "total_videos", "outlier_videos", "outlier_rate", "median_outlier_subscribers", "saturation_score"]
SCORE_COLUMNS = ["video_id", "score", "reason", "title", "channel_name", "subscribers", "views", "matched_terms", "theme_lift", "theme_burst", "category_name", "video_url", "channel_url"]
#: What scores of topics need to know of a lead.
_IDENTITY = ("channel_id", "title", "channel_name", "subscribers", "views", "category_id")

# Names of the categories by id.
CATEGORIES = {"1": "Film & Animation", "2": "Autos & Vehicles", "10": "Music", "15": "Pets & Animals", "17": "Sports", "19": "Travel & Events", "20": "Gaming", "22": "People & Blogs", "23": "Comedy", "24": "Entertainment", "25": "News & Politics", "26": "Howto & Style", "27": "Education", "28": "Science & Technology", "29": "Nonprofits & Activism"}


@dataclass(frozen=True)
class ThemeParams:
    least_words: int = 1
    most_words: int = 2
    min_lead_count: int = 3
    min_distinct_channels: int = 2
    #: A caller's limit on terms, by leads; by default there is none.
    max_terms: int | None = None
    smoothing: float = 1.0
    dedupe_titles: bool = True
    max_hhi: float | None = None
    burst_days: float = 7
    baseline_days: float = 28
    burst_weight: float = 0.5
    top_terms: int = 5
    max_term_repeats: int | None = 3
    saturation_weight: float = 0.35
    #: None: those of the languages that the frames' channel_language names.
    stopwords: tuple[str, ...] | None = None


def resolved(p: ThemeParams, *frames: DataFrame | None) -> ThemeParams:
    """The parameters with stopwords: those given, else the English ones and those of all languages in the frames."""
    if p.stopwords is not None:
        return p
    found: set[str] = set()
    for df in frames:
        if df is not None and "channel_language" in df.columns:
            found |= {r[0] for r in df.select("channel_language").distinct().filter(F.lower(F.substring("channel_language", 1, 2)).isin(list(STOPWORD_LISTS))).collect()}
    return replace(p, stopwords=tuple(stopwords_for(found)))


def category_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(F.coalesce(F.element_at(names, c), F.concat(F.lit("Unknown ("), c, F.lit(")"))))


def with_words(df: DataFrame, p: ThemeParams, dedupe: bool, order: list[Column]) -> DataFrame:
    """Adds `_words` of the title; with `dedupe`, of titles with the same words only the first in `order` stays. `df` is cheap to read."""
    ascii_only = df.filter(F.col("title").rlike("[^\\x00-\\x7F]")).isEmpty()
    words = tokens(F.col("title"), list(p.stopwords or ()), ascii_only)
    if dedupe:  # titles are compared without their words, which are made again for those that stay
        df = collapse_titles(df.withColumn("_sig", signature(words)), "_sig", order).drop("_sig")
    return df.withColumn("_words", words)


def with_terms(df: DataFrame, p: ThemeParams, dedupe: bool, order: list[Column]) -> DataFrame:
    """As `with_words`, with `terms`, the distinct n-grams of the words, in their place."""
    return with_words(df, p, dedupe, order).withColumn("terms", ngrams(F.col("_words"), p.least_words, p.most_words)).drop("_words")


def frequent_terms(docs: DataFrame, keys: list[str], p: ThemeParams) -> DataFrame:
    """(keys, _d, term) of the terms of each row of `docs` (keys, _d, _words) that may be in enough rows: words that are, then longer terms made of such words
    alone, as a term isn't in more rows than any of its words. Rare words, most of a vocabulary, never become longer terms."""
    single = docs.select(*keys, "_d", F.explode(F.array_distinct("_words")).alias("term"))
    known = settled(single.groupBy(*keys, "term").agg(F.count("*").alias("_n")).filter(F.col("_n") >= p.min_lead_count).drop("_n"))
    words = single.join(small(known), [*keys, "term"])
    if p.most_words < 2:
        return words
    placed = docs.select(*keys, "_d", F.posexplode("_words").alias("_at", "term")).join(small(known), [*keys, "term"])
    runs = placed.groupBy(*keys, "_d").agg(F.array_sort(F.collect_list(F.struct("_at", "term"))).alias("_run"))

    def of(n: int) -> Column:
        starts = F.when(F.size("_run") >= n, F.sequence(F.lit(0), F.size("_run") - n)).otherwise(F.array().cast("array<int>"))
        unbroken = F.filter(starts, lambda i: F.get("_run", i + (n - 1))["_at"] - F.get("_run", i)["_at"] == n - 1)
        return F.transform(unbroken, lambda i: F.array_join(F.slice(F.col("_run.term"), i + 1, F.lit(n)), " "))

    longer = runs.select(*keys, "_d", F.explode(F.array_distinct(F.concat(*[of(n) for n in range(max(2, p.least_words), p.most_words + 1)]))).alias("term"))
    return (words.select(*longer.columns).unionByName(longer)) if p.least_words < 2 else longer


def concentration(df: DataFrame, keys: list[str], parent: str = "channel_id") -> DataFrame:
    """(keys, count, channel_hhi, effective_channels, distinct_channels): rows, and the sum of squared shares of parents, null parents left out."""
    by_parent = df.groupBy(*keys, parent).agg(F.count("*").alias("n"))
    n = F.when(F.col(parent).isNotNull(), F.col("n"))
    hhi = F.sum(n * n) / (F.sum(n) * F.sum(n))
    return by_parent.groupBy(*keys).agg(F.sum("n").alias("lead_count"), hhi.alias("channel_hhi"), (1 / hhi).alias("effective_channels"), F.count(n).alias("distinct_channels"))


def background_counts(background: DataFrame, candidates: DataFrame, p: ThemeParams) -> tuple[DataFrame, DataFrame]:
    """(term, counts over all, recent and earlier titles) of the candidate terms, and one row of the numbers of titles.

    A title that comes again in other order of words counts at its earliest time. Recent is the last `burst_days` before the
    latest time, earlier the `baseline_days` before those. Equal titles of one time are counted before they are split into words.
    """
    day = 86_400_000_000
    timed = settled(background.groupBy("title", "published_at").agg(F.count("*").alias("_rows")))
    latest = timed.agg(F.max("published_at").alias("_latest"))
    titles = with_words(timed, p, p.dedupe_titles, [F.asc_nulls_last("published_at"), F.asc_nulls_last("title")]).crossJoin(F.broadcast(latest))
    recent_from = F.unix_micros("_latest") - F.lit(int(p.burst_days * day))
    at = F.unix_micros("published_at")
    prior_from = recent_from - F.lit(int(p.baseline_days * day)) if p.baseline_days > 0 else F.lit(-(2**62))
    if p.dedupe_titles:  # of titles with words one row stays, of others all
        titles = titles.withColumn("_rows", F.when(F.size("_words") > 0, F.lit(1)).otherwise(F.col("_rows")))
    split = titles.withColumns({"_recent": F.coalesce(at >= recent_from, F.lit(False)), "_prior": F.coalesce((at < recent_from) & (at >= prior_from), F.lit(False))})
    split = settled(split.select(ngrams(F.col("_words"), p.least_words, p.most_words).alias("terms"), "_rows", "_recent", "_prior"))  # read twice, its titles split and compared once

    def rows(*names: str) -> list[Column]:
        return [F.coalesce(F.sum(F.when(of, F.col("_rows"))), F.lit(0)).cast("long").alias(name) for name, of in zip(names, (F.lit(True), F.col("_recent"), F.col("_prior")), strict=True)]

    whole = split.agg(*rows("docs", "recent_docs", "prior_docs"))
    wanted = small(settled(candidates.select("term").distinct()))
    exploded = split.select(F.explode_outer("terms").alias("term"), "_rows", "_recent", "_prior").filter("term IS NOT NULL").join(wanted, "term", "left_semi")
    counts = exploded.groupBy("term").agg(*rows("bc", "rc", "pc"))
    return counts, whole


def extract_themes(leads: DataFrame, background: DataFrame | None = None, params: ThemeParams | None = None, by_category: bool = False) -> DataFrame:
    """Terms of at least `min_lead_count` leads and `min_distinct_channels` parents with share, lift, burst and concentration.

    All of them, unless the caller sets `max_terms`. Order of the result: lift * ln(1 + leads) * ln(1 + effective parents) * burst^weight. Columns are THEME_COLUMNS, after
    category_id and category_name with `by_category`. Example titles are the first three by item id.
    """
    p = resolved(params or ThemeParams(), leads, background)
    keys = ["category_id"] if by_category else []
    rows = leads.withColumn("category_id", normal_category(F.col("category_id"))) if by_category else leads
    rows = settled(rows.select(*keys, "video_id", "channel_id", "title", "views", "subscribers"))
    order = [F.asc_nulls_last("video_id")]
    worded = with_words(rows, p, p.dedupe_titles, order).select(*keys, "video_id", "channel_id", F.col("views").cast("double").alias("views"), safe_ratio(F.col("views"), F.col("subscribers")).alias("vps"), "title", "_words")
    docs = settled(worded.withColumn("_d", F.monotonically_increasing_id()))
    totals = docs.groupBy(*keys).agg(F.count("*").alias("total"))
    found_in = frequent_terms(docs.select(*keys, "_d", "_words"), keys, p)
    exploded = settled(found_in.join(docs.select("_d", "video_id", "channel_id", "views", "vps"), "_d").drop("_d"))
    stats = concentration(exploded, [*keys, "term"]).filter(F.col("lead_count") >= p.min_lead_count)
    if p.max_terms:
        stats = stats.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lead_count"), "term"))).filter(F.col("_k") <= p.max_terms).drop("_k")
    stats = settled(stats.filter(F.col("distinct_channels") >= p.min_distinct_channels))
    held = settled(exploded.join(small(stats.select(*keys, "term")), [*keys, "term"], "left_semi"))
    for more in (medians(held, [*keys, "term"], {"views": "median_views", "vps": "median_views_per_sub"}), settled(best_n(held, docs, [*keys, "term"], 3))):
        stats = stats.join(small(more), [*keys, "term"], "left")
    stats = settled(stats)
    stats = stats.join(small(totals), keys) if keys else stats.crossJoin(F.broadcast(totals))  # one row without keys
    s, half = p.smoothing, max(p.smoothing, 0.0) / 2
    if background is None:
        stats = stats.withColumns({"background_share": F.lit(None).cast("double"), "lift": F.col("lead_count") / F.col("total"), "burst": F.lit(1.0)})
    else:
        counts, whole = background_counts(background, stats, p)
        stats = stats.join(small(settled(counts)), "term", "left").crossJoin(F.broadcast(whole)).fillna(0, ["bc", "rc", "pc"])
        share = (F.col("bc") + s) / (F.col("docs") + 2 * s)
        lift = F.when(F.col("docs") > 0, F.when(share > 0, ((F.col("lead_count") + s) / (F.col("total") + 2 * s)) / share)).otherwise(F.col("lead_count") / F.col("total"))
        burst = safe_ratio((F.col("rc") + half) / (F.col("recent_docs") + s), (F.col("pc") + half) / (F.col("prior_docs") + s), 1.0)
        usable = (F.col("recent_docs") > 0) & (F.col("prior_docs") > 0)
        stats = stats.withColumns({"background_share": F.when(F.col("docs") > 0, share), "lift": F.coalesce(finite(lift), F.lit(0.0)), "burst": F.when(usable, burst).otherwise(1.0) if p.burst_weight else F.lit(1.0)})
    found = stats.withColumns({"ngram_size": F.size(F.split("term", " ")), "lead_share": F.col("lead_count") / F.col("total")})
    if p.max_hhi is not None:
        found = found.filter(F.col("channel_hhi").isNull() | (F.col("channel_hhi") <= p.max_hhi))
    rank = F.col("lift") * F.log1p("lead_count") * F.log1p(F.coalesce("effective_channels", F.lit(0.0))) * F.pow(F.greatest(F.col("burst"), F.lit(0.0)), F.lit(p.burst_weight))
    ordered = found.orderBy(F.desc(F.coalesce(finite(rank), F.lit(0.0))), F.desc("lift"), F.desc("lead_count"), F.desc("distinct_channels"), "term")
    head = [F.col("category_id"), category_name(F.col("category_id")).alias("category_name")] if by_category else []
    return ordered.select(*head, *THEME_COLUMNS)


def best_n(exploded: DataFrame, docs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, example_titles, example_video_ids) of the first `n` items of each key by id; titles come from `docs` (video_id, title), the first of
    an id that comes again."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("video_id"))
    picked = exploded.select(*keys, "video_id", k.alias("_k")).filter(F.col("_k") <= n)
    wanted = settled(picked.select("video_id").distinct())
    titles = docs.join(small(wanted), "video_id", "left_semi").groupBy("video_id").agg(F.min("title").alias("title"))
    named = picked.join(titles, "video_id", "left")
    listed = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_k", F.coalesce("title", F.lit("")).alias("t"), F.coalesce("video_id", F.lit("")).alias("v")))).alias("x"))
    return listed.select(*keys, F.array_join("x.t", " | ").alias("example_titles"), F.array_join("x.v", " | ").alias("example_video_ids"))


def niche_saturation(corpus: DataFrame, leads: DataFrame) -> DataFrame:
    """Supply and outliers by category: outlier rate over ln(1 + parents), best first. A null category is one of its own."""
    cat = normal_category(F.col("category_id"))
    total = corpus.groupBy(cat.alias("category_id")).agg(F.countDistinct("channel_id").alias("distinct_channels"), F.countDistinct("video_id").alias("total_videos"))
    out = leads.groupBy(cat.alias("o_category")).agg(F.countDistinct("channel_id").alias("outlier_channels"), F.countDistinct("video_id").alias("outlier_videos"))
    middle = medians(leads.select(cat.alias("o_category"), "subscribers"), ["o_category"], {"subscribers": "median_outlier_subscribers"}).withColumnRenamed("o_category", "m_category")
    out = out.join(middle, F.col("o_category").eqNullSafe(F.col("m_category")), "left").drop("m_category")
    both = total.join(out, total["category_id"].eqNullSafe(out["o_category"]), "full_outer").withColumn("category_id", F.coalesce("category_id", "o_category"))
    both = both.fillna(0, ["distinct_channels", "total_videos", "outlier_channels", "outlier_videos"])
    both = both.withColumn("outlier_rate", safe_ratio(F.col("outlier_videos"), F.col("total_videos"), 0.0))
    both = both.withColumns({"saturation_score": safe_ratio(F.col("outlier_rate"), F.log1p(F.greatest("distinct_channels", F.lit(1))), 0.0), "category_name": category_name(F.col("category_id"))})
    return both.select(*SATURATION_COLUMNS).orderBy(F.desc("saturation_score"), F.desc("outlier_videos"), F.desc("outlier_rate"), "category_id")


def fallback_leads(df: DataFrame, min_views: float = 50_000, quantile: float = 0.99, most: int = 2_000) -> DataFrame:
    """Leads without scorers: items of many views at or above the quantile of views per subscriber, the best `most`."""
    popular = df.filter(F.col("views") >= min_views)
    cut = quantiles(popular, [], "views_per_sub", {"_q": quantile}).drop("n")
    return popular.crossJoin(F.broadcast(cut)).filter(F.col("views_per_sub") >= F.col("_q")).drop("_q").orderBy(F.desc("views_per_sub"), "video_id").limit(most)


def attach_missing(leads: DataFrame, corpus: DataFrame, key: str = "video_id", columns: tuple[str, ...] = ("channel_id", "title", "channel_name", "subscribers", "views", "category_id", "published_at")) -> DataFrame:
    """The leads with each column from the corpus where they have none; a lead's own value wins. Of the corpus only the rows of leads that lack something are
    compared. Both are settled or cheap to read."""
    wanted = [c for c in columns if c in corpus.columns]
    lacking = leads.filter(F.greatest(*[F.col(c).isNull() if c in leads.columns else F.lit(True) for c in wanted], F.lit(False)))
    asked = corpus.select(key, *wanted).join(small(lacking.select(key).distinct()), key, "left_semi")
    known = best_per_key(asked, [key], [F.desc_nulls_last(wanted[0])]).select(key, *[F.col(c).alias(f"_b_{c}") for c in wanted])
    out = leads.join(known, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) if c in leads.columns else F.col(f"_b_{c}") for c in wanted})
    return out.drop(*[f"_b_{c}" for c in wanted])


def score_topics(df: DataFrame, leads: DataFrame | None = None, params: ThemeParams | None = None) -> DataFrame:
    """Leads by the themes of their titles: up to `top_terms` matched terms by lift, boosted in unsaturated categories; a row goes once
    all its terms were shown `max_term_repeats` times, counted over all rows; rows without terms stay. Scores are rounded, so that equal ones tie whatever the
    order of their sums."""
    p = resolved(params or ThemeParams(), df, leads)
    chosen = fallback_leads(df) if leads is None else best_per_key(leads, ["video_id"], [F.desc_nulls_last("score") if "score" in leads.columns else F.col("video_id")])
    chosen = settled(chosen.select("video_id", *[c for c in _IDENTITY if c in chosen.columns]))
    lead = settled(attach_missing(chosen, df, columns=_IDENTITY).withColumn("category_id", normal_category(F.col("category_id"))))
    themes = settled(extract_themes(lead, df, p).select("term", "lift", "burst", "lead_count"))
    matched = with_terms(lead.select("video_id", "title"), p, False, []).select("video_id", F.explode_outer("terms").alias("term")).filter("term IS NOT NULL").join(small(themes), "term")
    best = matched.withColumn("_k", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("lift"), "term"))).filter(F.col("_k") <= p.top_terms)
    strength = F.log1p("lift") * F.log1p("lead_count") * F.pow(F.greatest(F.col("burst"), F.lit(0.0)), F.lit(p.burst_weight))
    per_item = best.groupBy("video_id").agg(F.sum(strength).alias("_strength"), F.avg("lift").alias("theme_lift"), F.avg("burst").alias("theme_burst"), F.array_sort(F.collect_list(F.struct("_k", "term"))).alias("_terms"))
    saturation = settled(niche_saturation(df, lead).select("category_id", "saturation_score"))
    most = saturation.agg(F.max("saturation_score").alias("_most"))
    sat = saturation.withColumnRenamed("category_id", "_cat")
    out = lead.join(per_item, "video_id", "left").join(small(sat), F.col("category_id").eqNullSafe(F.col("_cat")), "left").crossJoin(F.broadcast(most))
    boost = F.when(F.col("_most") > 0, 1 + p.saturation_weight * F.coalesce("saturation_score", F.lit(0.0)) / F.col("_most")).otherwise(1.0)
    terms = F.coalesce(F.col("_terms.term"), F.array().cast("array<string>"))
    out = out.withColumns({
        "score": F.round(F.coalesce(finite(F.coalesce("_strength", F.lit(0.0)) * boost), F.lit(0.0)), 9), "_list": terms, "matched_terms": F.array_join(terms, " | "),
        "theme_lift": F.coalesce("theme_lift", F.lit(0.0)), "theme_burst": F.coalesce("theme_burst", F.lit(1.0)), "category_name": category_name(F.col("category_id")),
        "video_url": item_url(F.col("video_id")), "channel_url": parent_url(F.col("channel_id")),
    })
    out = out.withColumn("reason", F.when(F.size("_list") > 0, F.concat(F.lit("themes "), F.col("matched_terms"), F.lit(" (lift "), fixed(F.col("theme_lift"), 1, 12), F.lit(")"))).otherwise(F.lit("no recurring theme")))
    if p.max_term_repeats:
        place = F.struct((-F.col("score")).alias("s"), F.col("views").isNull().alias("n"), (-F.col("views")).alias("v"), F.col("video_id").alias("i"))
        out = fold_saturated(out, "video_id", place, "_list", p.max_term_repeats)
    return out.select(*SCORE_COLUMNS)
