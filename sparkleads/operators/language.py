"""Languages of parents: a cascade of tags, scripts and learnt markers, and how markers are learnt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_western_english, primary_language
from ..functions.text import carries_foreign_script, marker_tokens
from .latest import top_per_key

SCRIPT_SHARE, MARKER_SHARE = 0.10, 0.04


def _tag_counts(items: DataFrame, tag: str, name: str) -> DataFrame:
    """(channel_id, usable, foreign, most common foreign tag) of one kind of tag; ties go to the first in order."""
    primary = items.select("channel_id", primary_language(F.col(tag)).alias("p")).filter("p IS NOT NULL")
    by_tag = primary.groupBy("channel_id", "p").agg(F.count("*").alias("n"))
    foreign = F.when(F.col("p") != "en", F.struct((-F.col("n")).alias("k"), F.col("p").alias("p")))
    return by_tag.groupBy("channel_id").agg(F.sum("n").alias(f"{name}_n"), F.sum(F.when(F.col("p") != "en", F.col("n")).otherwise(0)).alias(f"{name}_foreign"), F.min(foreign)["p"].alias(f"{name}_top"))


def marker_share(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(channel_id, marker_share): the share of title tokens that the lexicon (token) holds."""
    exploded = items.select("channel_id", F.explode_outer(marker_tokens(F.col("title"))).alias("token")).filter("token IS NOT NULL")
    counted = exploded.groupBy("channel_id", "token").agg(F.count("*").alias("n"))
    known = counted.join(lexicon.select("token", F.lit(1).alias("_m")).distinct(), "token", "left")
    return known.groupBy("channel_id").agg((F.sum(F.when(F.col("_m") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("marker_share"))


def script_share(items: DataFrame) -> DataFrame:
    titled = items.filter(F.trim("title") != "")
    return titled.groupBy("channel_id").agg(F.avg(carries_foreign_script(F.col("title")).cast("double")).alias("script_share"))


def parent_languages(items: DataFrame, lexicon: DataFrame | None = None, detector: Callable[[Column], Column] | None = None) -> DataFrame:
    """(channel_id, channel_language, language_confidence, language_source): the first tier that fires decides.

    Foreign audio tags, foreign text tags, English of another region, foreign scripts, markers, English audio, English text,
    then the detector: a function from a column of pooled titles to a struct (tag, confidence). Without one, parents without
    tags are und, 0, unavailable, and scripts and markers decide only with one.
    """
    parents = items.select("channel_id").filter("channel_id IS NOT NULL").distinct()
    audio, text = _tag_counts(items, "default_audio_language", "a"), _tag_counts(items, "default_language", "t")
    tags = items.select("channel_id", F.explode(F.array("default_audio_language", "default_language")).alias("tag")).filter("tag IS NOT NULL")
    other = tags.filter((primary_language(F.col("tag")) == "en") & ~is_western_english(F.col("tag"))).groupBy("channel_id", F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))
    region = other.groupBy("channel_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "tag")).alias("r")).select("channel_id", F.col("r.tag").alias("region_tag"), (-F.col("r.k")).alias("region_n"))
    out = parents.join(audio, "channel_id", "left").join(text, "channel_id", "left").join(region, "channel_id", "left")
    usable = F.coalesce("a_n", F.lit(0)) + F.coalesce("t_n", F.lit(0))

    def tier(tag: Column, confidence: Column, source: str) -> Column:
        return F.struct(tag.alias("tag"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"))

    none = F.lit("und")
    chain = F.when(F.col("a_foreign") > 0, tier(F.col("a_top"), F.col("a_foreign") / F.col("a_n"), "audio"))
    chain = chain.when(F.col("t_foreign") > 0, tier(F.col("t_top"), F.col("t_foreign") / F.col("t_n"), "text"))
    chain = chain.when(F.col("region_tag").isNotNull(), tier(F.col("region_tag"), F.col("region_n") / F.greatest(usable, F.lit(1)), "region"))
    if detector is not None:
        first = top_per_key(items.filter(F.trim("title") != "").select("channel_id", "title").distinct(), ["channel_id"], [F.asc("title")], 500)
        pooled = first.groupBy("channel_id").agg(F.substring(F.array_join(F.array_sort(F.collect_list("title")), " "), 1, 5000).alias("_pooled"))
        out = out.join(script_share(items), "channel_id", "left").join(pooled, "channel_id", "left").withColumn("_d", detector(F.col("_pooled")))
        if lexicon is not None:
            out = out.join(marker_share(items, lexicon), "channel_id", "left")
        else:
            out = out.withColumn("marker_share", F.lit(None).cast("double"))
        foreign = F.when(F.coalesce(F.col("_d.tag"), none) == "en", none).otherwise(F.coalesce(F.col("_d.tag"), none))
        chain = chain.when(F.col("script_share") > SCRIPT_SHARE, tier(foreign, F.col("script_share"), "script"))
        chain = chain.when(F.col("marker_share") > MARKER_SHARE, tier(none, F.col("marker_share"), "markers"))
    chain = chain.when(F.col("a_n") > 0, tier(F.lit("en"), F.lit(1.0), "audio")).when(F.col("t_n") > 0, tier(F.lit("en"), F.lit(1.0), "text"))
    last = tier(F.coalesce(F.col("_d.tag"), none), F.coalesce(F.col("_d.confidence"), F.lit(0.0)), "detected") if detector is not None else tier(none, F.lit(0.0), "unavailable")
    decided = out.select("channel_id", chain.otherwise(last).alias("x"))
    return decided.select("channel_id", F.col("x.tag").alias("channel_language"), F.col("x.confidence").alias("language_confidence"), F.col("x.source").alias("language_source"))


def annotate(df: DataFrame, languages: DataFrame) -> DataFrame:
    return df.join(languages, "channel_id", "left")


def filter_english(annotated: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """Rows of parents whose language is western English; unlabelled ones with `keep_unknown`, unless region, script or markers decided."""
    language = F.coalesce("channel_language", F.lit("und"))
    decided = F.coalesce("language_source", F.lit("")).isin("region", "script", "markers")
    return annotated.filter(F.coalesce(is_western_english(language), F.lit(False)) | (F.lit(keep_unknown) & (language == "und") & ~decided))


def breakdown(annotated: DataFrame) -> DataFrame:
    by = annotated.groupBy(F.coalesce("channel_language", F.lit("und")).alias("channel_language")).agg(F.count("*").alias("videos"), F.countDistinct("channel_id").alias("channels"))
    total = by.agg(F.sum("videos").alias("_t"))
    return by.crossJoin(F.broadcast(total)).select("channel_language", "videos", "channels", (F.col("videos") / F.col("_t")).alias("share")).orderBy(F.desc("videos"), "channel_language")


def unanimous(items: DataFrame, tag: str = "default_audio_language") -> DataFrame:
    """(channel_id, label) of parents whose usable audio tags all say one language."""
    tagged = items.select("channel_id", primary_language(F.col(tag)).alias("p")).filter("p IS NOT NULL")
    return tagged.groupBy("channel_id").agg(F.min("p").alias("label"), F.max("p").alias("_other")).filter("label = _other").drop("_other")


def learn_markers(items: DataFrame, labelled: DataFrame, min_lift: float = 50, min_parents: int = 4, negative: str = "en") -> DataFrame:
    """(token, foreign, english, lift): tokens of at least `min_parents` foreign parents whose share of them is `min_lift` times that of English ones.

    `labelled`: (channel_id, label). Shares of English parents are add-one smoothed.
    """
    pairs = items.join(labelled, "channel_id").select("channel_id", (F.col("label") != negative).alias("foreign"), F.explode_outer(marker_tokens(F.col("title"))).alias("token")).filter("token IS NOT NULL").distinct()
    totals = labelled.agg(F.count_if(F.col("label") != negative).alias("_f"), F.count_if(F.col("label") == negative).alias("_e"))
    counts = pairs.groupBy("token").agg(F.count_if("foreign").alias("foreign"), F.count_if(~F.col("foreign")).alias("english"))
    lift = (F.col("foreign") / F.col("_f")) / ((F.col("english") + 1) / (F.col("_e") + 1))
    scored = counts.filter(F.col("foreign") >= min_parents).crossJoin(F.broadcast(totals)).withColumn("lift", lift)
    return scored.filter(F.col("lift") >= min_lift).select("token", "foreign", "english", "lift").orderBy("token")

