"""Each operator against brute force on small rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkleads.llm import common, components, decontamination, language_id, ngram_join, packing, page_labels, pii, quality_model, quality_rules, secret_scan, sharding, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, blob string, n_email long, n_words long, shard int"


def words_of(rng, n, kinds=4000):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def changed(rng, text, k):
    parts = text.split(" ")
    for _ in range(k):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [None, "", "", None, " \n\t ", "one", "one", "two words", words_of(rng, 40000), "é ü ß 日本 \U0001f600 " * 30]
    for _ in range(12):
        base = words_of(rng, rng.randrange(60, 160))
        out += [base] * rng.randrange(1, 5) + [changed(rng, base, k) for k in (1, 1, 2, 4, 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k if k % 11 else None, t, "en", "s", None, 0.5, "b", 3, 4, 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:6], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def grams(text, width=5):
    w = (text or "").split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_ngram_join_finds_all_links_and_classes(spark, texts, empty):
    ids = list(range(len(texts)))
    frame = spark.createDataFrame([(k, t, "en") for k, t in zip(ids, texts)], "doc_id long, text string, root string")
    got = {r["row_id"]: (r["class_id"], r["links"]) for r in ngram_join.joined(frame, limit=4).collect()}
    sets = [grams(t) for t in texts]
    near = {k: set() for k in ids}
    for a in ids:
        for b in ids:
            same = (texts[a] or "") == (texts[b] or "")
            both = len(sets[a] & sets[b])
            if a != b and (same or (both and 5 * both >= 4 * len(sets[a] | sets[b]))):
                near[a].add(b)
    label = {k: k for k in ids}
    for _ in ids:
        for a in ids:
            label[a] = min([label[a], *[label[b] for b in near[a]]])
    assert got == {k: (label[k], len(near[k])) for k in ids}
    assert ngram_join.joined(empty).count() == 0


@pytest.mark.parametrize("part", [2048, 32])
def test_ngram_join_splits_a_large_group_without_losing_links(spark, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "PART_TEXTS", part)
    rng = random.Random(3)
    base = words_of(rng, 120)
    rows = [(k, changed(rng, base, 1)) for k in range(150)]
    got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), limit=16).collect()
    sets = {k: grams(t) for k, t in rows}
    for r in got:
        want = sum(5 * len(sets[r["row_id"]] & s) >= 4 * len(sets[r["row_id"]] | s) for k, s in sets.items() if k != r["row_id"])
        assert r["links"] == want and r["class_id"] == 0


def test_runs_follow_the_target_recall():
    assert ngram_join.runs_needed(0.8, 0.9) < ngram_join.runs_needed(0.8, 0.999)


def test_ngram_join_keeps_its_recall_in_nodes_that_are_split_often(spark):
    rng, pairs = np.random.default_rng(9), 10_000
    left = rng.integers(0, 4, size=(pairs, ngram_join.COORDINATES))
    apart = rng.random(left.shape) >= 0.8
    right = np.where(apart, (left + rng.integers(1, 4, size=left.shape)) % 4, left)
    rows = [(str(2 * k + side).encode(), x[k].tolist()) for side, x in enumerate((left, right)) for k in range(pairs)]
    texts = spark.createDataFrame(rows, "text_id binary, signature array<int>").repartition(4)
    nodes = ngram_join.chosen_paths(texts, ngram_join.runs_needed(0.8, 0.9995), common.scratch(spark), limit=24)
    pair = F.floor(F.col("text_id").cast("string").cast("long") / 2)
    met = nodes.groupBy("node", pair.alias("pair")).agg(F.count("*").alias("n")).filter("n = 2").select("pair").distinct().count()
    assert pairs - met <= 0.0005 * pairs


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1), (3, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges, common.scratch(spark)).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8}


def test_decontamination_equals_brute_force(spark, empty):
    rng = random.Random(1)
    items = [(k, words_of(rng, 20 + k)) for k in range(6)] + [(90, "too short here"), (91, None), (None, words_of(rng, 30)), (92, "a a a a a a a a a a a")]
    docs = []
    for k in range(40):
        before, after = words_of(rng, rng.randrange(0, 30)), words_of(rng, rng.randrange(0, 30))
        item = items[k % 6][1]
        docs.append((k, f"{before} {changed(rng, item, k % 3)} {after}".strip()))
    docs += [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1]), (103, "a " * 40), (None, items[3][1])]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["window_start"], round(r["similarity"], 9)) for r in decontamination.leaks_by_document(frame, decontamination.leaks(frame, bench)).collect()}
    want = {}
    for d, text in docs:
        w = (text or "").split()
        for i, t in items:
            n = len((t or "").split())
            if i is None or n < 5:
                continue
            own = Counter(tuple(t.split()[k : k + 5]) for k in range(n - 4))
            for s in range(len(w) - n + 1):
                seen = Counter(tuple(w[s + k : s + k + 5]) for k in range(n - 4))
                both = sum((own & seen).values())
                share = both / sum((own | seen).values())
                if 5 * both >= 4 * sum((own | seen).values()) and share > want.get((d, i), (0, 0))[1]:
                    want[d, i] = (s, share)
    assert got == {k: (s, round(x, 9)) for k, (s, x) in want.items()}
    kept = decontamination.decontaminated(frame, bench)
    assert kept.count() == len([d for d in docs if not any(k[0] == d[0] for k in want)])
    assert decontamination.leaks(empty, bench).count() == 0 and decontamination.leaks(frame, bench.limit(0)).count() == 0


def test_decontamination_finds_texts_and_items_shorter_than_a_window(spark):
    rng = random.Random(2)
    item, other = words_of(rng, 59).split(), words_of(rng, 50).split()
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, "three little words"), (4, "four")]
    docs = [(1, " ".join(item[:55])), (2, " ".join(item[:45])), (3, " ".join(other[:25] + other[26:])), (4, " ".join(item[4:])), (5, "x three little words y three little words"), (6, "three little"), (7, "four"), (8, None)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["window_start"], r["n_words"], round(r["similarity"], 9)) for r in decontamination.leaks_by_document(frame, decontamination.leaks(frame, bench)).collect()}
    part = round(51 / 55, 9)
    want = {(1, 1): (0, 55, part), (4, 1): (0, 55, part), (3, 2): (0, 49, round(len(grams(docs[2][1]) & grams(items[1][1])) / len(grams(docs[2][1]) | grams(items[1][1])), 9)), (5, 3): (1, 3, 1.0), (7, 4): (0, 1, 1.0)}
    assert got == want
    assert {r["doc_id"] for r in decontamination.decontaminated(frame, bench).collect()} == {2, 6, 8}


@pytest.mark.parametrize("most", [100, 1 << 14])
def test_fingerprints_count_bits_with_either_width(spark, most):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(-(2**63), 2**63 - 1, size=n).tolist()) for k, n in enumerate([1, 2, 3, 40, 97])]
    frame = spark.createDataFrame(rows, "k long, h array<long>")
    got = {r["k"]: (r["a"], r["b"]) for r in decontamination.fingerprints(frame, ["k"], "h", most).collect()}
    second = {r["h"]: r["s"] for r in frame.select(F.explode("h").alias("h")).select("h", F.xxhash64("h").alias("s")).collect()}
    for k, hashes in rows:
        for half, values in zip(got[k], (hashes, [second[h] for h in hashes]), strict=True):
            bits = [sum(v >> b & 1 for v in values) * 2 > len(values) for b in range(64)]
            assert half & (2**64 - 1) == sum(1 << b for b, x in enumerate(bits) if x)


def test_blocks_cover_the_fingerprint_and_meet_within_the_radius(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(50):
        a, b = (rng.getrandbits(64) for _ in range(2))
        c, d = a, b
        for bit in rng.sample(range(128), decontamination.RADIUS):
            c, d = (c ^ 1 << bit, d) if bit < 64 else (c, d ^ 1 << bit - 64)
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b, c, d)))
    frame = spark.createDataFrame(rows, "a long, b long, c long, d long")
    made = frame.select(decontamination.blocks(F.col("a"), F.col("b")).alias("x"), decontamination.blocks(F.col("c"), F.col("d")).alias("y"))
    assert made.filter(~F.arrays_overlap("x", "y")).count() == 0 and made.filter(F.size("x") != decontamination.BLOCKS).count() == 0


def test_decontamination_of_long_items_and_shared_passages(spark):
    rng = random.Random(11)
    long, passage = words_of(rng, 1200), words_of(rng, 30)
    items = [(1, long)] + [(10 + k, f"{passage} {words_of(rng, 30)}") for k in range(8)]
    docs = [(1, f"{words_of(rng, 900)} {changed(rng, long, 20)} {words_of(rng, 900)}", 1.0), (2, f"{words_of(rng, 50)} {passage} {words_of(rng, 50)}", None), (3, f"{words_of(rng, 9)} {items[4][1]}", 0.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, similarity double").withColumns({"text_key": F.lit(1), "item_id": F.lit("x"), "start": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks_by_document(frame, decontamination.leaks(frame, bench)).collect()}
    assert got == {(1, 1), (3, 13)}
    kept = decontamination.decontaminated(frame, bench)
    assert kept.columns == frame.columns and [r["doc_id"] for r in kept.collect()] == [2]


def spans_by_hand(text, kinds):
    found = []
    for order, (kind, pattern, keep) in enumerate(kinds):
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if keep(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m.group(0))


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group(0).split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(1)) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group(0)) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group(0)) >= 32),
]
TRICKY = [
    None, "", "a@b.c.d@e.f", "a@b.c_d@e.f", "x@y", "@@a@b.co.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.001", "4111 1111-1111 1111 and 4111111111111112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
    "+1 (988) 555-2485 +44 20 7946 0958. +1 2", "😀😀 ü a.b@c-d.example 10.0.0.1", "token = token=abcdefgh123", "token=secret: abcdefghij", "PASSWORD: 'abcdefgh' passwd=short api_key==longer.value/x", "AKIAAKIA1234567890 AKIAshort",
    "f" * 31 + " " + "f" * 32 + "g" + "0" * 70, "9" * 5000, "a" * 20000 + "@" + "b" * 100, "x@y.z " * 400,
]


def generated(seed, alphabet, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_personal_data_spans(spark, empty):
    texts = TRICKY + generated(1, ["a", "1", "22", "@", ".", "-", " ", "+", "(", "255", "😀", "_", "4111111111111111"], 300)
    frame = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, n_email long")
    for r in pii.with_digest(frame, pii.personal_spans(frame)).collect():
        want = spans_by_hand(texts[r["doc_id"]], PERSONAL)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k, _, _ in PERSONAL] == [want.count(f"{k}:") for k, _, _ in PERSONAL]
        assert set(want.split(",")) - {""} <= set(r["spans"].split(","))
    assert pii.with_digest(empty, pii.personal_spans(empty)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(k, f"please write to mail: u{k}@mail.example.org or stay") for k in range(12)]
    rows += [(50, "please write to mail: user77@localhost or stay"), (51, "we saw room 1234567 there"), (52, "write to mail: user77@localhost")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.with_digest(frame, pii.personal_spans(frame)).collect()}
    assert got[51] == "" and got[50] == "context:22:38" and got[52] == "context:15:31"
    assert all("email" in got[k] for k in range(12))


def test_contexts_reach_over_spaces_and_every_occurrence_counts(spark):
    rows = [(k, f"so call us: +1 (01{k % 10}) 555-77{k:02} at once") for k in range(12)]
    rows += [(50, "so call us: (212) 555-0101 at once"), (51, "Number (212) 555-0101, twice (212) 555-0101."), (52, "in 1999 2000 and 2001 there were 12 345 678 of them"), (53, "item " + "9" * 300)]
    frame = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.with_digest(frame, pii.personal_spans(frame)).collect()}
    assert got[50] == "context:12:26" and got[51] == "context:7:21,context:29:43" and got[52] == got[53] == ""
    assert all(got[k] == "phone:12:29" for k in range(12))


def test_bootstrap_finds_withheld_seeds(spark):
    rng = random.Random(12)
    texts = [f"{rng.choice(['a', 'b', 'c'])}{rng.randrange(9)} mail{rng.randrange(10**6)}@m{rng.randrange(9)}.example.com {rng.choice(['x', 'y'])} +1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} z" for _ in range(300)]
    frame = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc string, t string")
    seen = pii.occurrences(frame, "doc", "t").filter("kind <> 'context'").select("instance", "patterns").cache()
    all_of_them = {r[0] for r in seen.select("instance").collect()}
    kept = seen.filter("xxhash64(instance) % 10 <> 0").select("instance")
    seeds = {r[0] for r in kept.collect()}
    _, scores = pii.bootstrap(seen, kept, common.scratch(spark))
    found = {r["instance"]: r["score"] for r in scores.collect()}
    withheld = all_of_them - seeds
    assert len(withheld) > 20 and len(withheld & set(found)) >= 0.95 * len(withheld) and all(found[x] == 1 for x in seeds)


def test_bootstrap_equals_a_plain_version(spark):
    rng = random.Random(13)
    edges = sorted({(f"i{rng.randrange(60)}", rng.choice("LRI"), f"p{rng.randrange(25)}") for _ in range(260)})
    edges = sorted({(i, side, f"{side}{p}") for i, side, p in edges})
    seeds = {f"i{k}" for k in range(45)}
    score, held = dict.fromkeys(seeds, 1.0), {}
    for i, _, p in edges:
        held.setdefault(p, set()).add(i)
    while True:
        conf = {p: sum(score.get(i, 0) for i in members) / (len(members) + 1) for p, members in held.items() if sum(i in score for i in members) >= pii.SUPPORT}
        conf = {p: c for p, c in conf.items() if c >= pii.PATTERN_SCORE}
        fresh = {}
        for i in {i for i, _, _ in edges} - score.keys():
            lack = 1.0
            for side in "LRI":
                lack *= 1 - max([conf[p] for j, s, p in edges if j == i and s == side and p in conf], default=0.0)
            if 1 - lack >= pii.INSTANCE_SCORE:
                fresh[i] = 1 - lack
        if not fresh:
            break
        score |= fresh
    rows = [(i, [(s, p) for j, s, p in edges if j == i]) for i in {i for i, _, _ in edges}]
    seen = spark.createDataFrame(rows, "instance string, patterns array<struct<side:string,pattern:string>>")
    _, got = pii.bootstrap(seen, spark.createDataFrame([(i,) for i in seeds], "instance string"), common.scratch(spark))
    assert {r["instance"]: round(r["score"], 9) for r in got.collect()} == {i: round(x, 9) for i, x in score.items()}


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "é a@b.co and 10.0.0.1!", 9), (2, None, None), (3, "none", 4), (1, "é a@b.co and 10.0.0.1!", 9)], "doc_id long, text string, n_chars long")
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in pii.redacted(frame, pii.personal_spans(frame), length="n_chars").filter("doc_id <> 2").collect())
    out = "é <EMAIL> and <IP>!"
    assert got == [(1, out, len(out)), (1, out, len(out)), (3, "none", 4)]


def test_secret_ledger(spark, empty):
    texts = TRICKY + generated(2, ["token", "=", ":", " ", "abcdefgh", "AKIA", "ABCDEFGH1234", "f", "0123456789abcdef", "'", "Secret", "é"], 300)
    frame = spark.createDataFrame([(k, t, "b") for k, t in enumerate(texts)], "doc_id long, text string, blob string")
    ledger = common.scratch(spark)
    found = secret_scan.scan(frame, ledger)
    for r in secret_scan.with_digest(frame, found).collect():
        want = spans_by_hand(texts[r["doc_id"]], SECRETS)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
    scanned = spark.read.parquet(f"{ledger}/scanned").count()
    again = frame.unionByName(spark.createDataFrame([(900, "token=zzzzzzzzzzzz", "b")], frame.schema))
    paths = secret_scan.findings_by_path(again, secret_scan.scan(again, ledger)).filter("doc_id = 900").count()
    assert paths == 1 and spark.read.parquet(f"{ledger}/scanned").count() == scanned + 1
    assert secret_scan.scan(empty, common.scratch(spark)).count() == 0


def test_quality_rules_equal_brute_force(docs, texts, empty):
    def by_hand(text):
        t = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        n, chars, marks, dup = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))
        letters, upper, digits = sum(c.isalpha() for c in t), sum(c.isupper() for c in t), sum(c in "0123456789" for c in t)
        failed = n < 50 or 100 * len(covered) > 50 * n
        bad = failed or 20 * marks > n or chars < 2 * n or chars > 25 * n or 10 * dup > n or 2 * letters < chars or 2 * upper > letters or 3 * digits > chars or 20 * len(set(w)) < n
        return (n, chars, marks, dup, len(covered), failed, not bad)

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rng = random.Random(8)
    more = ["a b c a b c a\n#x\n#x\n \n" * 30, " ".join(f"{rng.randrange(10**6)}" for _ in range(90)), " ".join(f"AB{rng.choice('CDEF')}x" + chr(97 + k % 26) * (k // 26) for k in range(90))]
    more += [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(n)) for n in (49, 50, 300)]
    spark = docs.sparkSession
    every = docs.unionByName(spark.createDataFrame([(1000 + k, t, "en", "s", None, 0.5, "b", 3, 4, 7) for k, t in enumerate(more)], docs.schema))
    rules = quality_rules.production_rules()
    for order in (rules, rules[::-1]):
        got = Counter(tuple(r[n] for n in names) for r in quality_rules.judged(every, order).collect())
        assert got == Counter(by_hand(t) for t in [*texts, *texts[:6], *more])
    assert sum(k[-1] for k in got) >= 2
    assert quality_rules.judged(empty, rules).count() == 0


def test_cascade_measures_and_stops_at_the_first_rejection(docs, empty):
    cheap = quality_rules.cheap_statistics(docs)
    rules = quality_rules.production_rules()
    assert {r.name for r in quality_rules.ordered(cheap, rules, rows=50)} == {r.name for r in rules} and len(quality_rules.ordered(quality_rules.cheap_statistics(empty), rules)) == len(rules)
    fails = quality_rules.QualityRule("fails", F.raise_error(F.lit("evaluated")).cast("boolean"))
    all_go, none = quality_rules.QualityRule("all", F.col("n_words") >= 0), quality_rules.QualityRule("none", F.lit(None).cast("boolean"))
    stopped = quality_rules.cascade(cheap, [none, all_go, fails]).select("rejected_by")
    assert {r[0] for r in stopped.collect()} == {"all"}
    costs = {r.name: (cost, share) for r, cost, share in quality_rules.measure(cheap, [all_go, none])}
    assert costs["all"][1] == 1 and costs["none"][1] == 0
    assert quality_rules.cascade(docs, []).filter("rejected_by IS NULL").count() == docs.count()


def test_sharding(docs, texts, empty):
    got = sharding.sharded(docs, 5).toPandas()
    assert len(got) == len(texts) + 6
    for _, one in got.groupby("shard"):
        assert sorted(one["slot"]) == list(range(len(one)))
    sizes = got.groupby("shard")["size"].sum()
    assert got["size"].sum() == sum(len((t or "").encode()) + 16 for t in [*texts, *texts[:6]])
    assert set(got["text_crc32"]) == {zlib.crc32((t or "").encode()) for t in texts}
    rest = sizes[sizes < got["size"].max()]
    assert rest.max() - rest.min() < 2000
    assert sharding.sharded(empty, 5).count() == 0


def test_place_balances_bytes_tokens_and_rows_jointly():
    rng = np.random.default_rng(4)
    tokens = np.ceil(rng.lognormal(4, 1.2, 4000))
    sizes = np.stack([np.ceil(tokens * rng.uniform(3, 9, 4000)) + 16, tokens, rng.integers(1, 4, 4000)], axis=1)
    shard = sharding.place(sizes, even(sizes, 20))
    for d in range(3):
        load = np.bincount(shard, weights=sizes[:, d], minlength=20)
        assert load.max() - load.min() <= 0.01 * load.mean()
    assert len(sharding.place(np.zeros((0, 3)), np.ones((4, 3)))) == 0 and sorted(sharding.place(np.ones((8, 3)), np.full((4, 3), 2.0)).tolist()) == [0, 0, 1, 1, 2, 2, 3, 3]


def even(sizes, shards):
    return np.tile(sizes.sum(axis=0) / shards, (shards, 1))


@pytest.mark.parametrize("share", [0.1, 0.25])
def test_a_giant_text_leaves_the_other_shards_level(share):
    rng = np.random.default_rng(5)
    tokens = np.ceil(rng.lognormal(4, 1.2, 8000))
    sizes = np.stack([np.ceil(tokens * rng.uniform(3, 9, 8000)) + 16, tokens, np.ones(8000)], axis=1)
    sizes[77, :2] = sizes[:, :2].sum(axis=0) * share / (1 - share)
    shard = sharding.place(sizes, even(sizes, 40))
    for d in range(3):
        load = np.delete(np.bincount(shard, weights=sizes[:, d], minlength=40), shard[77])
        assert load.max() - load.min() <= 0.01 * load.mean()


def test_capacities_level_what_large_groups_leave():
    load = np.array([[10.0, 1, 1], [0, 0, 0], [2, 2, 2]])
    got = sharding.capacities(load, np.array([6.0, 6, 6]))
    assert got.tolist() == [[0, 0, 0], [4, 4, 4], [2, 2, 2]]


def test_groups_that_fit_a_shard_stay_whole(spark):
    rng = random.Random(1)
    texts = [f"t{k} " + "x" * rng.randrange(10, 200) for k in range(3000)] + ["fits " * 40] * 60 + ["splits " * 30] * 900
    got = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).toPandas()
    by_text = got.groupby("text_crc32")["shard"].nunique()
    assert by_text[zlib.crc32(texts[3000].encode())] == 1 and by_text[zlib.crc32(texts[-1].encode())] > 1
    assert (by_text > 1).sum() == 1
    for x in ("size", "tokens"):
        load = got.groupby("shard")[x].sum()
        assert load.max() - load.min() <= 0.01 * load.mean()
    assert got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 15


def test_tasks_fill_what_large_groups_leave(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 700)
    monkeypatch.setattr(sharding, "LARGE", 0.02)
    rng = random.Random(2)
    texts = [" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))) + f" {k}" for k in range(4000)] + ["big " * 3000] * 2 + ["more " * 700] * 5
    got = sharding.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 6).toPandas()
    assert len(got) == len(texts) and got.groupby("text_crc32")["shard"].nunique().max() == 1
    for x in ("size", "tokens"):
        load = got.groupby("shard")[x].sum()
        assert load.max() - load.min() <= 0.01 * load.mean()


def test_a_repeated_row_is_numbered_in_parts(spark):
    frame = spark.range(5000).select(F.lit(1).alias("g"), F.lit("same").alias("x")).repartition(3)
    got = common.number_within(frame, "g", "n", rows_per_task=300)
    assert sorted(r["n"] for r in got.collect()) == list(range(5000))


def test_a_change_of_rules_is_scanned_anew(spark):
    frame = spark.createDataFrame([(1, "token=abcdefgh and code 12345", "kept"), (1, "token=abcdefgh and code 12345", "kept")], "doc_id long, text string, blob string")
    ledger = common.scratch(spark)
    assert [r["kind"] for r in secret_scan.scan(frame, ledger).collect()] == ["assign"]
    more = [*secret_scan.RULES, secret_scan.SpanRule("code", "code [0-9]+", "code")]
    found = secret_scan.scan(frame, ledger, more)
    assert sorted(r["kind"] for r in found.collect()) == ["assign", "code"]
    made = secret_scan.with_digest(frame, found).collect()
    assert [(r["blob"], r["n_assign"], r["spans"]) for r in made] == [("kept", 1, "assign:0:14,code:19:29")] * 2


def test_spread_join_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else "hot" if k % 3 else f"k{k}") for k in range(400)], "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "key string, v int")
    got = Counter((r["id"], r["key"], r["v"]) for r in common.left_join_spread(rows, right, "key", most=10).collect())
    assert got == Counter((k, key, {"hot": 1, "k3": 2}.get(key)) for k, key in [(r["id"], r["key"]) for r in rows.collect()])


def test_packing_round_trip(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).toPandas()
    by_doc = {k: t for k, t in enumerate(texts) if k % 11 and k >= 6}
    for k, t in by_doc.items():
        own = pieces[pieces["doc_id"] == k].sort_values("start")
        ids = np.frombuffer(b"".join(own["ids"]), dtype="<u4").tolist()
        assert ids == reference.encode(t or "", add_special_tokens=False).ids + [0] and own["doc_tokens"].iloc[0] == len(ids)
    assert pieces["length"].sum() == sum(len(reference.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*texts, *texts[:6]])
    for _, one in pieces.sort_values("offset").groupby("sequence_id"):
        total = int(one["length"].sum())
        assert (one["offset"] == one["length"].cumsum() - one["length"]).all() and total <= 1024
    assert packing.packed(empty, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_encoder_equals_the_tokenizer_on_odd_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = ["", " ", "  a", "a  b", "a \n b", "\n\n x\ty ", "<|endoftext|> é日本 😀", "a<|endoftext|>b <|end", *generated(7, [" ", "a", "\n", "don't", "12", "\t", "é", ".", " "], 300)]
    assert made.encode(texts) == [np.array(reference.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_pack_balances_costs():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 900) for _ in range(400)]
    pieces = packing.pack(sizes)
    assert sum(p[2] for p in pieces) == sum(sizes)
    costs = Counter()
    for _, _, n, b, _ in pieces:
        costs[b] += packing.cost(n)
    full = sorted(costs.values())[len(costs) // 50 :]
    assert max(full) < 2 * min(full)


def test_pack_cuts_only_what_fits_nowhere():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.choice([rng.randrange(1, 1024), rng.randrange(1, 5000)]) for _ in range(rng.randrange(1, 60))]
        left = [(n % 1024, n > 1024, d) for d, n in enumerate(sizes) if n % 1024]
        room, spent, placed = [1024] * (sum(n for n, _, _ in left) // 1024), Counter(), {}
        for n, _, d in sorted(left, key=lambda x: (x[1], -x[0], x[2])):
            fits = [(spent[b], room[b], b) for b in range(len(room)) if room[b] >= n]
            if fits:
                b = min(fits)[2]
                placed[d], room[b], spent[b] = b, room[b] - n, spent[b] + packing.cost(n)
        pieces, used, of = packing.pack(sizes), Counter(), Counter()
        for d, start, n, b, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert offset == used[b] and used[b] + n <= 1024
            used[b] += n
            of[d] += 1
        for d, n in enumerate(sizes):
            own = sorted(p[1:3] for p in pieces if p[0] == d)
            assert [a for a, _ in own] == [sum(m for _, m in own[:k]) for k in range(len(own))] and sum(m for _, m in own) == n
            assert of[d] <= (2 if n <= 1024 else n // 1024 + packing.LONG_CUTS + 1)
            assert d not in placed or of[d] == n // 1024 + 1


def test_pack_pads_little_and_keeps_short_documents_whole():
    rng = np.random.default_rng(7)
    sizes = np.minimum(np.ceil(rng.lognormal(6.2, 1.1, 4096)), 30_000).astype(int).tolist()
    pieces = packing.pack(sizes)
    used, of = Counter(), Counter(p[0] for p in pieces)
    for _, _, n, b, _ in pieces:
        used[b] += n
    assert sum(1024 - n for n in used.values()) <= 0.01 * sum(sizes)
    short = [d for d, n in enumerate(sizes) if n <= 1024]
    assert max(of[d] for d in short) <= 2 and sum(of[d] > 1 for d in short) <= 0.01 * len(short)


def test_packing_keeps_the_type_of_ids(spark):
    import public_tokenizers

    frame = spark.createDataFrame([("x", "one two"), (None, None)], "doc_id string, text string")
    pieces = packing.packed(frame, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert {(r["doc_id"], r["doc_tokens"]) for r in pieces.collect()} == {("x", 3), (None, 1)}


def test_quality_model_on_held_out_rows(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["river", "stone", "walks", "quiet", "the", "and"]) for _ in range(80)) + "." for _ in range(300)]
    bad = [" | ".join(rng.choice(["BUY", "NOW", "$$$", "###"]) for _ in range(80)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(360) if k % 2], "doc_id long, quality int")
    model = quality_model.train(frame, labels, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r["score"] for r in quality_model.scored(frame.withColumn("score", F.lit("x")), model).collect()}
    held = [k for k, _ in rows if k % 3 == 0]
    assert np.mean([(got[k] >= 0.7) == (k < 300) for k in held]) > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality_model.scored(odd, model).collect())
    assert quality_model.train(frame, labels.limit(0), F.lit(True)) is None and quality_model.scored(odd, None).count() == 3
    assert quality_model.train(frame.limit(0), labels, F.lit(True)) is None and quality_model.scored(frame.limit(0), model).count() == 0


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(4)
    width = len(quality_model.NAMES) + quality_model.BUCKETS
    for prior in (0.3, 0.8):
        good, bad = rng.normal(0, 1, (6000, width)), rng.normal(0, 1, (3000, width))
        bad[:, 0] += 4
        both = np.concatenate([good[3000 : 3000 + int(3000 * prior)], bad[: int(3000 * (1 - prior))]])
        assert abs(quality_model.estimated_prior(good[:3000], rng.permutation(both)) - prior) < 0.08


def test_quality_score_of_the_column_is_the_models(spark, texts):
    rng = np.random.default_rng(6)
    width = len(quality_model.NAMES) * (1 + 2 * quality_model.KNOTS) + quality_model.BUCKETS
    model = quality_model.Model(np.sort(rng.random((len(quality_model.NAMES), quality_model.KNOTS)), axis=1), rng.random(width), rng.random(width) + 1, rng.normal(size=width), 0.3, 0.5)
    some = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert np.allclose([r["score"] for r in quality_model.scored(some, model).collect()], model.score(quality_model._matrix(some)))


def test_url_rules_and_verdicts(spark):
    urls = ["http://A.ORG/x", "https://b.example.org/es/1", "https://example.org/en/12?q", "http://example.org/fr", "https://x.com/fr/1", "https://x.com/de/", "ftp://org?x=/y", "no scheme.org/", None, "", "http://casino.net/win-1", "http://plain.net/en/1", "http://x.com/fr", "https://Ünï.ORG/a://b"]
    rows = [(k, u, "z") for k, u in enumerate(urls * 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    bad = F.coalesce(F.contains("url", F.lit("casino")), F.lit(False)).cast("int")
    model = url_filter.train(pages.select("url", bad.alias("blocked")))
    got = {r["page_id"]: r for r in url_filter.judged(pages, model).collect()}

    def by_hand(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest).group(0)
        path = re.match("[^?#]*", rest[len(host) :]).group(0)
        host = re.sub("[A-Z]", lambda m: m.group(0).lower(), host)
        fits = [(len(n), n, v) for v, n in url_filter.RULES for h, p in [n.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return host, path, max(fits)[1:] if fits else (None, None)

    for k, u, _ in rows:
        host, path, (rule, verdict) = by_hand(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == verdict if verdict else got[k]["verdict"] in ("allow", "block")
    assert got[10]["verdict"] == "block" and got[11]["verdict"] == "allow"
    none = pages.limit(0)
    assert url_filter.judged(none, url_filter.train(none.select("url", F.lit(0).alias("blocked")))).count() == 0


def test_labels_come_from_rules_and_pages(spark):
    body = " ".join(f"word{k}" for k in range(60))
    rows = [("http://a.org/x", "<p>!!! $$$</p>"), ("http://a.example.org/es/1", f"<p>{body}</p>"), ("http://b.net/1", f"<!-- x --><p>{body}</p><script>var a = '####';</script>"), ("http://b.net/2", "<p>" + body.upper() + "</p>"),
            ("http://b.net/3", "<p>" + "same " * 80 + "</p>"), ("http://b.net/4", f"<p>{'$$ '.join(body.split())}</p>"), ("http://b.net/5", "".join(f"<a href=x>{w}</a> " for w in body.split())), ("http://b.net/6", None), (None, f"<p>{body}</p>"), ("", "")]
    pages = spark.createDataFrame([*rows, rows[2], rows[2]], "url string, html string")
    got = [(r["url"], r["blocked"]) for r in page_labels.labelled(pages).collect()]
    want = [0, 1, 0, 1, 1, 1, 1, 1, 0, 1, 0, 0]
    assert got == [(u, b) for (u, _), b in zip([*rows, rows[2], rows[2]], want)]
    assert page_labels.labelled(pages.limit(0)).count() == 0


def test_language_evidence(spark):
    docs = spark.createDataFrame([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), (None, "en"), ("x", None)] * 4, "text string, lang string")
    model = language_id.train_words(docs)
    page = "<html lang='{}'><script>the and the</script><p>{}</p></html>"
    rows = [(1, "http://a.de/de/1", page.format("de", "der hund und")), (2, "http://b.com/en/", page.format("en", "the dog")), (3, "http://b.com/en/2", "<p></p>"), (4, None, None), (5, "http://a.de/de/2", page.format("de", "")), (1, "http://a.de/de/1", page.format("de", "der hund und"))]
    got = [(r["page_id"], r["lang"]) for r in language_id.identified(spark.createDataFrame(rows * 3, "page_id long, url string, html string"), model).collect()]
    assert Counter(got) == Counter([(1, "de")] * 6 + [(2, "en"), (3, "en"), (5, "de")] * 3 + [(4, dict(got)[4])] * 3)
    untrained = language_id.train_words(docs.limit(0))
    assert language_id.identified(spark.createDataFrame(rows, "page_id long, url string, html string"), untrained).filter("lang IS NULL").count() == 6


def test_fused_language_equals_brute_force(spark):
    rng = random.Random(21)
    vocabulary = {"en": ["the", "cat", "dog", "and", "at"], "de": ["der", "hund", "und", "katze", "at"], "fr": ["le", "chat", "et", "chien", "at"]}
    docs = spark.createDataFrame([(" ".join(rng.choice(vocabulary[x]) for _ in range(12)), x) for x in vocabulary for _ in range(30)], "text string, lang string")
    model = language_id.train_words(docs)
    rows = []
    for k in range(150):
        x = rng.choice(["en", "de", "fr"])
        body = " ".join(rng.choice(vocabulary[x] + ["zzz", "at"]) for _ in range(rng.choice([0, 1, 2, 9, 70])))
        declared = rng.choice(["", f" lang={x}", " lang='en-GB'"])
        rows.append((k if k % 9 else None, rng.choice([None, "", f"http://{rng.choice('ab')}.{x}/{x}/1", f"https://h{rng.randrange(4)}.site.org/{rng.choice(['en', 'about'])}/2"]), rng.choice([None, f"<html{declared}><p>{body}</p>", f"<html{declared}>{body}"]), "z"))
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = Counter((r["page_id"], r["lang"], r["confidence"]) for r in language_id.identified(frame, model).collect())

    at, names, pages = {w: model.table[k] for k, w in enumerate(model.words)}, model.languages, []
    for key, url, html, _ in rows:
        host, _, path = (url or "").partition("://")[2].partition("/")
        host, segments = host.lower(), path.split("/")
        suffix = host.split(".")[-1] + (f"/{segments[0]}" if len(segments[0]) == 2 and host else "")
        found = re.search("lang=['\"]?([A-Za-z]+)", html or "")
        known = [at[w] for w in re.sub("<[^>]*>", " ", html or "").split() if w in at]
        likely = sum(known, np.zeros(len(names))) * (min(1, language_id.EFFECTIVE_WORDS / len(known)) if known else 1)
        likely = likely - likely.max()
        pages.append((key, host, ".".join(host.split(".")[-2:]), suffix, found.group(1).lower() if found else "", likely, names[int(likely.argmax())] if likely.min() < 0 else None))
    want = Counter()
    for me, (key, host, domain, suffix, declared, likely, _) in enumerate(pages):
        rest = [p for other, p in enumerate(pages) if other != me and p[6]]
        score = []
        for k, x in enumerate(names):
            prior = (sum(p[6] == x for p in rest) + 1) / (len(rest) + len(names))
            for field, value in ((2, domain), (1, host)):
                same = [p for p in rest if p[field] == value]
                prior = (sum(p[6] == x for p in same) + 10 * prior) / (len(same) + 10)
            total = likely[k] + np.log(prior)
            for field, value in ((4, declared), (3, suffix)):
                if value:
                    kinds = len({p[field] for p in pages} - {""})
                    total += np.log((sum(p[field] == value and p[6] == x for p in rest) + 1) / (sum(p[6] == x for p in rest) + kinds + 1))
            score.append(total)
        score = np.array(score)
        want[key, names[int(score.argmax())], round(float(1 / np.exp(score - score.max()).sum()), 6)] += 1
    assert {(a, b, round(c, 4)) for a, b, c in got} == {(a, b, round(c, 4)) for a, b, c in want} and sum(got.values()) == len(rows)
    assert language_id.identified(frame.limit(0), model).count() == 0


def test_url_trees_find_unseen_hosts(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1500):
        bad = k % 10 == 0
        host = f"{rng.choice(['win', 'top', 'free', 'big'])}-{rng.randrange(10**5)}-{rng.choice('abc')}x{rng.randrange(99)}.com" if bad else f"{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['river', 'stone', 'quiet', 'walks'])}{rng.choice('abcdefgh') * rng.randrange(1, 4)}.{rng.choice(['com', 'net'])}"
        rows.append((k, f"http://{host}/{rng.choice(['en', 'x', 'about'])}/{rng.randrange(99)}" + ("?a=1&b=2" if rng.random() < 0.3 else ""), int(bad)))
    frame = spark.createDataFrame(rows, "page_id long, url string, blocked int").withColumn("fold", F.lit("clash"))
    held = F.pmod(F.xxhash64(url_filter.split_url(F.col("url"))[0]), F.lit(4)) == 0
    model = url_filter.train(frame.filter(~held))
    got = url_filter.judged(frame.filter(held), model, rules=[]).collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["blocked"]) for r in got]) > 0.97 and sum(r["blocked"] for r in got) > 10
    long = spark.createDataFrame([(1, "http://a.b/" + "x" * 100_000), (1, "http://a.b/" + "x" * 100_000), (None, "://")], "page_id long, url string")
    assert url_filter.judged(long, model).count() == 3


def test_statistics_of_a_url_come_from_other_folds(spark):
    rows = [("com", "com/a", "x.com", 1.0, 0), ("com", "com/a", "x.com", 1.0, 1), ("com", "com/b", "y.com", 0.0, 1), ("net", "net/a", "z.net", 1.0, 2)]
    frame = spark.createDataFrame(rows, "suffix string, section string, domain string, blocked double, fold int")
    got = {(r["section"], r["fold"]): (r["suffix_rate"], r["section_rate"], r["domain_rate"]) for r in url_filter.out_of_fold(frame, frame, 0.75).collect()}
    share = lambda b, n: (b + 5 * 0.75) / (n + 5)
    want = {("com/a", 0): (share(1, 2), share(1, 1), share(1, 1)), ("com/a", 1): (share(1, 1), share(1, 1), share(1, 1)), ("com/b", 1): (share(1, 1),) * 3, ("net/a", 2): (0.75,) * 3}
    assert {k: [round(x, 9) for x in v] for k, v in got.items()} == {k: [round(x, 9) for x in v] for k, v in want.items()}


def test_numbering_has_no_gaps(spark):
    frame = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
    got = common.number_within(frame, "g", "n", rows_per_task=40).toPandas()
    assert all(sorted(x["n"]) == list(range(250)) for _, x in got.groupby("g"))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, "/root/testdata/sf0.001")
        assert after.columns == docs.columns, name
        kept = common.written(after, common.scratch(spark), "kept")
        assert 0 < kept.count() <= before
        before = kept.count()
    assert kept.select("doc_id").distinct().count() == before
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001").select("doc_id").distinct().count() == before


def test_pipeline_stages_take_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (None, "one", "en", None, 3), (None, "one", "en", None, 3), (7, None, None, "s", None)], good.schema)
    for docs, rows in ((odd, 5), (good.limit(0), 0)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, kept, "/root/testdata/sf0.001")
            assert after.columns == docs.columns, name
            kept = common.written(after, common.scratch(spark), "kept")
            assert kept.count() <= rows
        pieces = corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001")
        assert pieces.count() >= kept.count() and (kept.isEmpty() == pieces.isEmpty())
    # Without a model nothing is rejected, and then one of each class stays.
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.keep_good_quality(spark, odd, str(tmp_path)).count() == 5
    assert sorted((r["text"] or "") for r in corpus_pipeline.keep_one_of_each_class(spark, odd, str(tmp_path)).collect()) == ["", "one"]


def test_pipeline_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    rng = random.Random(6)
    a, b, c, d, e = (words_of(rng, 120) for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (5, changed(rng, c, 1)), (5, d), (3, e), (3, changed(rng, e, 1)), (9, None), (8, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each_class(spark, docs, "").collect()]
    third = min((t for k, t in rows if k == 3), key=lambda t: hashlib.md5(t.encode()).digest())
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (2, c), (5, d), (3, third), (8, "")], key=str)
