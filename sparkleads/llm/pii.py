"""Personal data by fixed patterns and bootstrapped contexts (DataFrame functions only).

Spans of the fixed patterns seed a graph of patterns and instances. An instance is a fixed span or a stretch that looks
like an identifier: a token with an at sign or digits, or groups of digits with spaces, brackets, dots or hyphens between. The lexical patterns
of an occurrence are the one or two words before and after it, each with the sort of the instance (with an at sign, digits, mixed), and of the instance itself its
coarse and its exact shape, its first characters with the shape, and what follows its at sign. Rounds score
patterns by the share of known instances among all they hold, and instances by the best pattern of each side and of the
instance itself; instances above a threshold are known from then on, until a round finds no more. All occurrences of instances so found
are spans of kind `context`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import left_join_any, scratch, small, text_key, written
from .spans import SpanRule, attach, digest, hits

# The base patterns. Possessive forms and look-behinds find the same matches in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


BASE_KINDS = ["email", "ip", "card", "phone"]
BASE_RULES = [
    SpanRule("email", f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    SpanRule("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]", lambda hit: hit.rlike("^" + "\\.".join(["0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"] * 4) + "$")),
    SpanRule("card", "[0-9](?:[\\x20-]?+[0-9]){11,}+", "[0-9](?:[\\x20-]?[0-9]){11}", lambda hit: F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", F.left(_digits(hit), F.lit(19)))),
    SpanRule("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]", lambda hit: F.length(_digits(hit)).between(9, 15)),
]
#: Stretches that may be identifiers: groups of digits, else tokens; with at least four digits or an at sign.
CANDIDATES = SpanRule(
    "context", "(?<![^\\s\\p{Punct}])[+(]?[0-9](?:[\\x20().-]{0,3}+[0-9])++(?![^\\s\\p{Punct}])(?![@.,:/_-][^\\s])|(?<!\\S)[^\\s0-9@]*+[0-9@]\\S*+", "[0-9@]",
    lambda hit: F.contains(hit, F.lit("@")) | (F.length(_digits(hit)) >= 4),
)

#: Characters before and after an occurrence in which its words are looked for.
CONTEXT_CHARS = 64
#: Known instances that a pattern needs, its least score, and that of an instance.
SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 0.6, 0.8
_CELL = 64


def occurrences(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, kind_order, start, end, hit, instance, patterns) of the fixed spans and of the candidates, these without punctuation around
    them and of kind `context`. A pattern is (side, name), a side being L, R or I for the instance itself."""
    found = hits(texts, key, text, [*BASE_RULES, CANDIDATES], CONTEXT_CHARS)
    bare = F.regexp_replace("hit", "^(?:(?![+(]+[0-9])\\p{Punct})+", "")
    core = F.when(F.col("kind") == "context", F.regexp_replace(bare, "[\\p{Punct}]+$", "")).otherwise(F.col("hit"))
    placed = found.withColumns({"core": core, "start": F.col("start") + F.when(F.col("kind") == "context", F.char_length("hit") - F.char_length(bare)).otherwise(0)})
    placed = placed.filter("core <> ''").withColumns({"end": F.col("start") + F.char_length("core"), "instance": F.lower("core")})
    exact = F.regexp_replace(F.regexp_replace("instance", "[0-9]", "9"), "\\p{L}", "a")
    coarse = F.regexp_replace(F.regexp_replace("instance", "[0-9]+", "9"), "\\p{L}+", "a")

    def word(side: str, pattern: str) -> Column:
        return F.regexp_replace(F.lower(F.regexp_extract(side, pattern, 1)), "^[\\p{Punct}]+|[\\p{Punct}]+$", "")

    kind = F.when(F.contains("instance", F.lit("@")), "at").when(F.col("instance").rlike("^[0-9\\s\\p{Punct}]+$"), "digits").otherwise("mixed")
    named = [
        ("L", "1", word("before", "(\\S+)\\s*$"), kind), ("L", "2", word("before", "(\\S+\\s+\\S+)\\s*$"), kind),
        ("R", "1", word("after", "^\\s*(\\S+)"), kind), ("R", "2", word("after", "^\\s*(\\S+\\s+\\S+)"), kind),
        ("I", "coarse", coarse, kind), ("I", "exact", exact, kind), ("I", "first", F.left("instance", F.lit(3)), coarse),
        ("I", "domain", F.when(F.contains("instance", F.lit("@")), F.substring_index("instance", "@", -1)), kind),
    ]
    patterns = [F.when(c != "", F.struct(F.lit(side).alias("side"), F.concat_ws("|", F.lit(side + width), c, shape).alias("pattern"))) for side, width, c, shape in named]
    return placed.select(key, "kind", "kind_order", "start", "end", "hit", "instance", F.array_compact(F.array(*patterns)).alias("patterns"))


def _cells(df: DataFrame) -> DataFrame:
    return df.withColumn("cell", F.explode(F.expr(f"sequence(start div {_CELL}, (end - 1) div {_CELL})")))


def overlapping(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of `left` (key, start, end, ...) that overlap a span of `right`, once each; `left` must hold no row twice."""
    r = right.select(F.col(key).alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    r = r.withColumn("r_cell", F.explode(F.expr(f"sequence(r_start div {_CELL}, (r_end - 1) div {_CELL})")))
    near = (F.col(key) == F.col("r_key")) & (F.col("cell") == F.col("r_cell")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    return _cells(left).join(r, near, "left_semi").drop("cell").dropDuplicates([key, "start", "end"])


def bootstrap(seen: DataFrame, known: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and of instances after as many rounds as find new instances.

    `seen`: (instance, patterns) of all occurrences; `known`: (instance) of the seeds. A pattern's score is the sum of its
    known instances' scores over the number of its instances and one; it counts with `SUPPORT` known instances and `PATTERN_SCORE`. An
    instance's score is 1 minus the product of what its best pattern of each side lacks of 1, as patterns of one side say much the same;
    seeds keep 1, and what is known stays known with the score that made it so, so the rounds end.
    """
    edges = written(seen.select("instance", F.explode("patterns").alias("x")).select("instance", "x.*").distinct(), folder, "graph")
    scores = written(known.select("instance", F.lit(1.0).alias("score")).distinct(), folder, "instances-0")
    k, total = 0, scores.count()
    while True:
        k += 1
        scored = edges.join(scores, "instance", "left")
        patterns = scored.groupBy("pattern").agg((F.sum(F.coalesce("score", F.lit(0.0))) / (F.count("*") + 1)).alias("confidence"), F.count("score").alias("support"))
        patterns = written(patterns.filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= PATTERN_SCORE)).select("pattern", "confidence"), folder, f"patterns-{k}")
        best = edges.join(small(patterns), "pattern").groupBy("instance").agg(*[F.max(F.when(F.col("side") == side, F.col("confidence"))).alias(side) for side in "LRI"])
        lack = F.lit(1.0)
        for side in "LRI":
            lack = lack * (1 - F.coalesce(side, F.lit(0.0)))
        fresh = best.select("instance", (1 - lack).alias("score")).filter(F.col("score") >= INSTANCE_SCORE).join(scores, "instance", "left_anti")
        scores = written(scores.unionByName(fresh), folder, f"instances-{k}")
        before, total = total, scores.count()
        if total == before:
            return patterns, scores


def personal_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, kind, kind_order, start, end, hit) of all personal data in the texts of `docs`; equal texts count once.

    Null and empty texts have none, and an empty table gives no rows. Spans of kind `context` don't overlap
    base spans; base spans of different kinds may overlap.
    """
    folder = scratch(docs.sparkSession)
    texts = docs.select(F.col(f"`{text}`").alias("_text")).filter("_text RLIKE '[0-9@]'").select(text_key(F.col("_text")).alias("text_key"), "_text")
    seen = written(occurrences(texts, "text_key", "_text"), folder, "seen")
    base, others = seen.filter(F.col("kind") != "context"), seen.filter(F.col("kind") == "context")
    covered = overlapping(others, base, "text_key").select("text_key", "start", "end")
    others = written(others.join(covered, ["text_key", "start", "end"], "left_anti"), folder, "others")
    columns = ["text_key", "kind", "kind_order", "start", "end", "hit"]
    _, scores = bootstrap(base.select("instance", "patterns").unionByName(others.select("instance", "patterns")), base, folder)
    more = others.join(small(scores.select("instance")), "instance", "left_semi").withColumn("hit", F.col("instance"))
    return base.select(*columns).unionByName(more.select(*columns))


def with_digest(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Every row of `docs` with counts, digest and spans of its text; repeated rows stay."""
    rows = docs.withColumn("_key", text_key(F.col(f"`{text}`")))
    return attach(rows, found.withColumnRenamed("text_key", "_key"), "_key", BASE_KINDS).drop("_key", "found_spans")


def redacted(docs: DataFrame, found: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """`docs` with each span of personal data replaced by its kind in angle brackets; of overlapping spans the first names
    the gap that all of them leave. `length` names a column to hold the new length. Null texts stay null."""
    lists = digest(found, "text_key", BASE_KINDS).select(F.col("text_key").alias("_key"), F.col("found_spans").alias("_spans"))
    lists = written(lists, scratch(docs.sparkSession), "lists")
    rows = left_join_any(docs.withColumn("_key", text_key(F.col(f"`{text}`"))), lists, "_key")
    c = F.col(f"`{text}`")

    def step(state: Column, span: Column) -> Column:
        kept = F.concat(state["out"], F.substring(c, state["at"] + 1, (span["start"] - state["at"]).cast("int")), F.lit("<"), F.upper(span["kind"]), F.lit(">"))
        apart = F.struct(span["end"].cast("int").alias("at"), kept.alias("out"))
        return F.when(span["start"] >= state["at"], apart).otherwise(F.struct(F.greatest(state["at"], span["end"].cast("int")).alias("at"), state["out"].alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring(c, s["at"] + 1, F.lit(2**31 - 1))))
    out = rows.withColumn(text, F.when(F.col("_spans").isNull(), c).otherwise(rebuilt))
    if length:
        out = out.withColumn(length, F.when(F.col("_spans").isNull(), F.col(f"`{length}`")).otherwise(F.char_length(F.col(f"`{text}`")).cast(docs.schema[length].dataType)))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])
