"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

A window of a document is as long as a benchmark item; a document shorter than an item is one window. Documents and items that share
one of the item's rarest five-grams are brought together: so many of them that a similar window must hold one. Of such a document, windows
with enough five-grams of the item, found from the sorted positions of these, get a 128-bit SimHash of their
five-grams; no other window can be similar. A multi-index by item and block finds the windows near an item: fingerprints are cut into more
blocks than the radius has bits, so any two within the radius agree on a block. Candidates are then verified by the exact
weighted Jaccard similarity of their five-grams, a gram's weight being its number of occurrences. An item
of one to four words is a single gram, so its windows are found by an equal join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, small, text_id, words, written

WIDTH = 5
SIMILARITY = 0.8
#: Differing bits of 128 up to which a window is a candidate. At similarity 0.8 a window differs in 19 bits on average, with a deviation of 4
#: to 5: 42 is five deviations away, so that the radius loses next to nothing.
RADIUS = 42
BLOCKS = RADIUS + 1
#: Texts with seeds (16 bytes each) up to which their keys are broadcast and no text is shuffled.
SEEDED = 1_000_000
#: By counters in a long: its factor to spread so many bits over them, and their lowest bits. Four count to 2^14, two to 2^30.
_SPREAD = {4: (0x0000200040008001, 0x0001000100010001), 2: (0x0000000080000001, 0x0000000100000001)}


def grams(word_list: Column, width: int = WIDTH) -> Column:
    """Hashes of the windows of `width` words; none for shorter lists."""
    starts = F.when(F.size(word_list) >= width, F.sequence(F.lit(1), F.size(word_list) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(word_list, i + k) for k in range(width)]))


def fingerprints(df: DataFrame, key: list[str], hashes: str, most: int) -> DataFrame:
    """(key, a, b): the 128-bit SimHash of each row's list of at most `most` hashes, as two longs. Keys are unique.

    Each hash and its second hash count their bits in sums of several counters each, as wide as `most` needs.
    Bits with as many ones as zeros are 0. Rows with an empty list are left out.
    """
    lanes = 4 if most < 1 << 14 else 2
    width, (spread, lowest) = 64 // lanes, _SPREAD[lanes]
    rows = df.select(*key, F.explode_outer(hashes).alias("h")).filter("h IS NOT NULL").withColumn("h2", F.xxhash64("h"))
    parts = range(64 // lanes)
    sums = [F.expr(f"sum(((shiftrightunsigned({h}, {lanes * k}) & {(1 << lanes) - 1}) * {spread}L) & {lowest}L)").alias(f"{h}_{k}") for h in ("h", "h2") for k in parts]
    counted = rows.groupBy(*key).agg(F.count("*").alias("n"), *sums)
    top = width - 2

    def bits(h: str) -> Column:
        # Adding 2^top - (n div 2 + 1) to each counter carries into its bit `top` if it counts more than half.
        carried = [f"(shiftrightunsigned({h}_{k} + ({(1 << top) - 1} - n div 2) * {lowest}L, {top}) & {lowest}L)" for k in parts]
        packed = ["((" + " | ".join(f"shiftrightunsigned({y}, {(width - 1) * i})" for i in range(lanes)) + f") & {(1 << lanes) - 1})" for y in carried]
        return F.expr(" | ".join(f"shiftleft({x}, {lanes * k})" for k, x in enumerate(packed)))

    return counted.select(*key, bits("h").alias("a"), bits("h2").alias("b"))


def blocks(a: Column, b: Column) -> Column:
    """The fingerprint's blocks as (index, value) in one int each: half of them, more or less, from either long."""
    made = []
    for half, count, first in ((a, BLOCKS // 2, 0), (b, BLOCKS - BLOCKS // 2, BLOCKS // 2)):
        cuts = [64 * k // count for k in range(count + 1)]
        for k in range(count):
            value = F.shiftrightunsigned(half, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))
            made.append((value + F.lit((first + k) << 16)).cast("int"))
    return F.array(*made)


def rare_grams(bench: DataFrame, similarity: float, folder: str) -> DataFrame:
    """(h, item_id): of each item its rarest grams among all items, so many that a window without any of them lacks too many
    to be similar: a similar window holds at least the share `similarity` of the item's grams."""
    each = bench.select("item_id", F.size("item_grams").alias("n"), F.explode("item_grams").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("c"))
    ranked = each.join(common, "h").withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("c", "h")))
    return written(ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).select("h", "item_id").distinct(), folder, "rare")


def starts_with_enough(positions: Column, grams_of_text: Column, grams_of_item: Column, similarity: float) -> tuple[Column, Column]:
    """(length in grams, starts) of the windows that hold enough of an item's grams to be similar, from the sorted positions of these.

    A window of w grams that shares weight c with an item of n has similarity c / (w + n - c), so it needs c >= s (w + n) / (1 + s),
    and its positions are at least as many. A start belongs to the first position that is not before it.
    """
    width = F.least(grams_of_item, grams_of_text)
    least = F.greatest(F.lit(1), F.ceil(F.lit(similarity / (1 + similarity)) * (width + grams_of_item) - 1e-9).cast("int"))

    def of(p: Column, k: Column) -> Column:
        first = F.greatest(F.lit(0), F.get(positions, k + least - 1) - width + 1, F.when(k > 0, F.get(positions, k - 1) + 1).otherwise(0))
        last = F.least(p, grams_of_text - width)
        return F.when((k + least <= F.size(positions)) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return width, F.flatten(F.transform(positions, of))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, item_id, window_start, n_words, similarity): the best window of each text and item at `similarity` or more.

    window_start counts words from 0; of equally similar windows the first is given. n_words is the window's number of
    words: the item's, or the text's if that is shorter. Equal texts count once here, by their key. Null and empty texts, and
    items with a null id or without words, have no leaks. Item ids are unique. Empty tables give no rows.
    """
    folder = scratch(docs.sparkSession)
    split = items.select(F.col(f"`{item_id}`").alias("item_id"), words(F.col(f"`{item_text}`")).alias("w")).filter("size(w) > 0 AND item_id IS NOT NULL")
    split = written(split.select("item_id", F.size("w").alias("n_words"), "w"), folder, "items")
    bench = written(split.filter(F.col("n_words") >= WIDTH).select("item_id", F.size(grams(F.col("w"))).alias("n_grams"), grams(F.col("w")).alias("item_grams")), folder, "bench")
    rare = small(rare_grams(bench, similarity, folder))
    c = F.col(f"`{text}`")
    # The outer forms of explode: for the others Spark adds a filter that computes the whole array once more.
    texts = docs.select(text_id(c).alias("text_key"), words(c).alias("w"))
    seeds = texts.select("text_key", F.explode_outer(F.array_distinct(grams(F.col("w")))).alias("h")).filter("h IS NOT NULL").join(rare, "h")
    pairs = written(seeds.select("text_key", "item_id").distinct(), folder, "pairs")
    held = texts.join(small(pairs.select("text_key").distinct(), SEEDED), "text_key", "left_semi").dropDuplicates(["text_key"])
    held = written(held.select("text_key", grams(F.col("w")).alias("g")), folder, "held")
    weights = written(bench.select("item_id", F.explode("item_grams").alias("h")).groupBy("item_id", "h").agg(F.count("*").alias("weight")), folder, "weights")
    placed = pairs.join(held, "text_key").select("text_key", "item_id", F.size("g").alias("total"), F.posexplode("g").alias("pos", "h")).join(small(weights), ["item_id", "h"])
    at = placed.groupBy("text_key", "item_id").agg(F.first("total").alias("total"), F.array_sort(F.collect_list("pos")).alias("at")).join(small(bench.select("item_id", "n_grams")), "item_id")
    width, starts = starts_with_enough(F.col("at"), F.col("total"), F.col("n_grams"), similarity)
    starts = written(at.select("text_key", "item_id", width.alias("width"), F.explode(starts).alias("start")), folder, "starts")
    windows = starts.join(held, "text_key").select("text_key", "item_id", "width", "start", F.slice("g", F.col("start") + 1, F.col("width")).alias("grams"))
    most = bench.agg(F.max("n_grams")).first()[0] or 0
    prints = fingerprints(bench, ["item_id"], "item_grams", most).select("item_id", F.col("a").alias("ia"), F.col("b").alias("ib"))
    index = small(written(prints.withColumn("block", F.explode(blocks(F.col("ia"), F.col("ib")))), folder, "index"))
    probe = fingerprints(windows, ["text_key", "item_id", "width", "start"], "grams", most).withColumn("block", F.explode(blocks(F.col("a"), F.col("b"))))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("ia"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("ib")))
    close = probe.join(index, ["item_id", "block"]).filter(distance <= RADIUS)
    close = written(close.select("text_key", "item_id", "width", "start").distinct(), folder, "close")
    counted = close.join(held, "text_key").select("text_key", "item_id", "width", "start", F.explode(F.slice("g", F.col("start") + 1, F.col("width"))).alias("h"))
    counted = counted.groupBy("text_key", "item_id", "width", "start", "h").agg(F.count("*").alias("c")).join(small(weights), ["item_id", "h"])
    scored = counted.groupBy("text_key", "item_id", "width", "start").agg(F.sum(F.least("c", "weight")).alias("lesser")).join(small(bench.select("item_id", "n_grams")), "item_id")
    scored = scored.withColumn("greater", F.col("width") + F.col("n_grams") - F.col("lesser")).withColumn("similarity", F.col("lesser") / F.col("greater"))
    passed = scored.filter(F.col("lesser") >= F.lit(similarity) * F.col("greater") - 1e-9)
    best = passed.groupBy("text_key", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "width", "similarity")).alias("x"))
    best = best.select("text_key", "item_id", F.col("x.start").alias("window_start"), (F.col("x.width") + (WIDTH - 1)).alias("n_words"), "x.similarity")
    short = split.filter(F.col("n_words") < WIDTH)
    for n in range(1, WIDTH):
        whole = small(short.filter(F.col("n_words") == n).select("item_id", F.element_at(grams(F.col("w"), n), 1).alias("h")))
        at = texts.select("text_key", F.posexplode_outer(grams(F.col("w"), n)).alias("pos", "h")).filter("h IS NOT NULL").join(whole, "h")
        found = at.groupBy("text_key", "item_id").agg(F.min("pos").alias("window_start"))
        best = best.unionByName(found.select("text_key", "item_id", "window_start", F.lit(n).alias("n_words"), F.lit(1.0).alias("similarity")))
    return written(best, folder, "leaks")


def leaks_by_document(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The leaks of every document row; repeated rows and copies each have theirs."""
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_id(F.col(f"`{text}`")).alias("text_key"))
    return keyed.join(found, "text_key").drop("text_key")


def decontaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """`docs` without the rows whose text holds a window at `similarity` or more to an item."""
    found = leaks(docs, items, similarity, text=text).select(F.col("text_key").alias("_key")).distinct()
    return docs.withColumn("_key", text_id(F.col(f"`{text}`"))).join(found, "_key", "left_anti").drop("_key")
