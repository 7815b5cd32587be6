"""Scalar column functions: safe casts and ratios, parsing and formatting of counts, times and identifiers.

No function returns NaN or infinity: both become null, so that nothing outranks real numbers by being invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
MONTH_DAYS = 30.44

# Peer classes by parent size and by number of items, each bin closed on the left.
SUB_CLASSES = [(1_000, "<1k"), (10_000, "1k-10k"), (50_000, "10k-50k"), (200_000, "50k-200k"), (1_000_000, "200k-1M"), (None, "1M+")]
COUNT_CLASSES = [(50, "<50"), (300, "50-300"), (1_000, "300-1000"), (None, "1000+")]
UNKNOWN_CLASS = "unknown"

# Seconds of each unit in relative ages.
AGE_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def number(c: Column) -> Column:
    """Text or number to double; junk to null."""
    return finite(c.cast("string").try_cast("double"))


def instant(c: Column) -> Column:
    """ISO text to timestamp; junk to null."""
    return c.cast("string").try_cast("timestamp")


def typed(df: DataFrame, numbers: list[str], times: list[str], texts: list[str] = ()) -> DataFrame:
    """Each named column that exists in its type; bad values are null."""
    kinds = {**{c: number for c in numbers}, **{c: instant for c in times}, **{c: lambda x: x.cast("string") for c in texts}}
    return df.withColumns({c: f(F.col(c)) for c, f in kinds.items() if c in df.columns})


def safe_ratio(numerator: Column, denominator: Column, fill: float | None = None) -> Column:
    """The quotient, or `fill` where the denominator is 0 or null or the result isn't finite."""
    quotient = finite(F.try_divide(numerator.cast("double"), denominator.cast("double")))
    return quotient if fill is None else F.coalesce(quotient, F.lit(float(fill)))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_MICROS))


def binned(c: Column, bins: list[tuple[int | None, str]]) -> Column:
    """The label of the first bin whose upper bound is above the value; `unknown` for null."""
    label = F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(UNKNOWN_CLASS))
    for bound, name in bins:
        label = label.when(c < bound, F.lit(name)) if bound is not None else label.otherwise(F.lit(name))
    return label


def bin_order(c: Column, bins: list[tuple[int | None, str]]) -> Column:
    """Position of a bin's label, the unknown last."""
    order = F.lit(len(bins))
    for k, (_, name) in enumerate(bins):
        order = F.when(c == name, k).otherwise(order)
    return order


def log_compress(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """sign(x) * log(1 + |x|), clipped; null counts as 0."""
    value = F.coalesce(finite(F.signum(c) * F.log1p(F.abs(c))), F.lit(0.0))
    value = F.greatest(value, F.lit(float(low))) if low is not None else value
    return F.least(value, F.lit(float(high))) if high is not None else value


def acceleration_curve(ratio: Column, age_days: Column, min_age_days: float = 30.0) -> Column:
    """100 * (1 - exp(-log2(max(ratio, 1)))); 0 for young items and unknown ratios."""
    value = 100 * (1 - F.exp(-F.log2(F.greatest(ratio, F.lit(1.0)))))
    return F.when((age_days >= min_age_days) & ratio.isNotNull(), value).otherwise(F.lit(0.0))


def weighted_mean(parts: list[tuple[Column, float]], at_least: int = 1) -> Column:
    """Mean of the parts that aren't null by their weights; null with fewer than `at_least`."""
    top, bottom, present = F.lit(0.0), F.lit(0.0), F.lit(0)
    for c, weight in parts:
        top = top + F.coalesce(c * weight, F.lit(0.0))
        bottom = bottom + F.when(c.isNotNull(), F.lit(float(weight))).otherwise(F.lit(0.0))
        present = present + c.isNotNull().cast("int")
    return F.when(present >= at_least, safe_ratio(top, bottom))


def fixed(c: Column, decimals: int = 1, digits: int = 8) -> Column:
    """The number with so many decimals, as text. It is brought to `digits` decimals first, so that a quotient an ulp below a half, which it
    is in exact numbers, still rounds up; numbers too large for that are formatted as they are."""
    exact = F.round(c.cast("double").try_cast(f"decimal(38,{digits})"), decimals).cast(f"decimal(38,{decimals})").cast("string")
    return F.coalesce(exact, F.format_string(f"%.{decimals}f", c.cast("double")))


def compact_number(c: Column, decimals: int = 1, strip: bool = True, unknown: str = "unknown") -> Column:
    """1234567 -> 1.2M. `strip` removes trailing zeros; halves round up."""
    def scaled(divisor: float, suffix: str) -> Column:
        text = fixed(c.cast("double") / divisor, decimals)
        if strip and decimals:
            text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
        return F.concat(text, F.lit(suffix))

    size = F.abs(c)
    return F.when(c.isNull(), F.lit(unknown)).when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(scaled(1.0, ""))


def parse_compact_number(c: Column) -> Column:
    """"1.2M", "1,234" -> whole number, cut off; null without digits."""
    plain = F.upper(F.regexp_replace(c, ",", ""))
    digits = F.regexp_extract(plain, "([0-9]+(?:\\.[0-9]+)?)\\s*([KMB]?)", 1)
    unit = F.regexp_extract(plain, "([0-9]+(?:\\.[0-9]+)?)\\s*([KMB]?)", 2)
    factor = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)
    return F.when(digits != "", (digits.cast("decimal(20,6)") * factor).cast("long"))


def iso_duration_seconds(c: Column) -> Column:
    """PT#H#M#S -> seconds; null without a full match."""
    pattern = "^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?$"
    def part(k: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).try_cast("long"), F.lit(0))
    return F.when(c.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def relative_age_to_time(text: Column, observed_at: Column) -> Column:
    """"3 weeks ago" -> observed_at less that; texts that aren't such ages give observed_at."""
    pattern = "(?i)([0-9]+)\\s+(second|minute|hour|day|week|month|year)s?\\s+ago"
    count = F.regexp_extract(text, pattern, 1).try_cast("long")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    seconds = F.lit(None).cast("long")
    for name, size in AGE_UNITS.items():
        seconds = F.when(unit == name, F.lit(size)).otherwise(seconds)
    return F.coalesce(F.timestamp_micros(F.unix_micros(observed_at) - count * seconds * 1_000_000), observed_at)


def parent_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def is_canonical_id(c: Column) -> Column:
    return c.rlike("^UC[\\w-]{20,}$")


def identifiers(handle: Column, canonical: Column, handle_first: bool = True) -> Column:
    """The identifiers to try, in order, without nulls and duplicates."""
    pair = [handle, canonical] if handle_first else [canonical, handle]
    return F.array_compact(F.array_distinct(F.array(*pair)))


def content_digest(columns: list[str]) -> Column:
    """sha256 of the compact JSON of the named columns in order of their names; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def local_day(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def hash_pool(key: Column, warm_share: float = 0.35) -> Column:
    """WARM or SEED by the first four bytes of the key's sha256; null and empty keys are SEED."""
    bucket = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 1000
    return F.when((F.coalesce(key, F.lit("")) != "") & (bucket < int(warm_share * 1000)), F.lit("WARM")).otherwise(F.lit("SEED"))


def primary_language(tag: Column) -> Column:
    """The primary subtag of a language tag; null for none, zxx, und, mul and mis."""
    primary = F.lower(F.regexp_extract(F.trim(tag), "^([A-Za-z]{2,8})(?:[-_]|$)", 1))
    return F.when((primary != "") & ~primary.isin("zxx", "und", "mul", "mis"), primary)


def language_region(tag: Column) -> Column:
    region = F.upper(F.regexp_extract(F.trim(tag), "^[A-Za-z]{2,8}(?:[-_][A-Za-z]{4})?[-_]([A-Za-z]{2}|[0-9]{3})(?:[-_]|$)", 1))
    return F.nullif(region, F.lit(""))


# Regions whose English counts as western.
WESTERN_REGIONS = ["US", "GB", "CA", "AU", "NZ", "IE", "ZA"]


def is_western_english(tag: Column) -> Column:
    return (primary_language(tag) == "en") & (language_region(tag).isNull() | language_region(tag).isin(WESTERN_REGIONS))


def after_label(lines: Column, label: str) -> Column:
    """The line after the first line equal to `label`; null without it; "--" is null."""
    at = F.array_position(lines, label)
    return F.when(at > 0, F.nullif(F.get(lines, at.cast("int")), F.lit("--")))


def before_label(lines: Column, label: str) -> Column:
    at = F.array_position(lines, label)
    return F.when(at > 1, F.nullif(F.get(lines, (at - 2).cast("int")), F.lit("--")))


def between_labels(lines: Column, first: str, last: str) -> Column:
    """The lines between two labels; null unless both are there in that order."""
    a, b = F.array_position(lines, first), F.array_position(lines, last)
    return F.when((a > 0) & (b > a), F.slice(lines, (a + 1).cast("int"), (b - a - 1).cast("int")))


def daily_metric_row(cells: Column) -> Column:
    """A row of text cells (date, ..., "low - high") as a struct; null unless it has eight cells and begins with a date."""
    earnings = F.split(F.get(cells, 7), "\\s+-\\s+", 2)
    made = F.struct(
        F.get(cells, 0).try_cast("date").alias("day"), parse_compact_number(F.get(cells, 2)).alias("followers_change"), parse_compact_number(F.get(cells, 3)).alias("followers"),
        parse_compact_number(F.get(cells, 4)).alias("views_change"), parse_compact_number(F.get(cells, 5)).alias("views"), F.get(earnings, 0).alias("earnings_low"), F.get(earnings, 1).alias("earnings_high"),
    )
    return F.when((F.size(cells) >= 8) & F.get(cells, 0).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), made)


def item_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), F.coalesce(video_id, F.lit("")))


def parent_url(channel_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/channel/"), F.coalesce(channel_id, F.lit("")))


def normal_category(c: Column) -> Column:
    """"22.0" -> "22"; other text and null stay."""
    whole = c.try_cast("double")
    return F.coalesce(F.when(whole == F.floor(whole), whole.cast("long").cast("string")), c)


def json_or_raw(c: Column, schema: str) -> Column:
    """The JSON text as a struct with `raw` set where it can't be parsed."""
    parsed = F.from_json(c, schema)
    return F.struct(parsed.alias("record"), F.when(F.try_parse_json(c).isNull(), c).alias("raw"))


# Columns of a parent's profile, whichever source it is from.
PROFILE_COLUMNS = {
    "source": "string", "channel_id": "string", "channel_name": "string", "subscribers_total": "string", "subscribers_change": "string", "subscribers_change_percentage": "string",
    "views_total": "string", "views_change": "string", "views_change_percentage": "string", "earnings_low": "string", "earnings_high": "string", "engagement": "string",
    "upload_frequency": "string", "average_length": "string", "source_url": "string", "raw_rendered_text": "array<string>",
}


def channel_profile(df: DataFrame, source: str) -> DataFrame:
    """The common columns of a profile from `source`: null where the source has none, an empty list for no text. Other columns go."""
    made = [F.lit(source).alias("source")]
    for name, kind in PROFILE_COLUMNS.items():
        if name != "source":
            made.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    out = df.select(*made)
    return out.withColumn("raw_rendered_text", F.coalesce("raw_rendered_text", F.array().cast("array<string>")))
