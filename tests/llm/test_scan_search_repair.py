"""License scans, ranked search and conversation repair against plain versions, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkleads.llm import common, conversation_repair, lexical_search, license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def license_texts():
    rng = random.Random(4)

    def fill(n):
        return " ".join(rng.choice(["the", "license", "of", "gnu", "words", "permission", "é", "all", "by"]) for _ in range(n))

    out = [None, "", " \n ", "All rights reserved", "CC BY cc-by, cc BY", "all rights all rights reserved reserved", fill(20_000)]
    for label, text in license_scan.TEMPLATES:
        words = text.split()
        out.append(f"{fill(rng.randrange(40))} {text} {fill(rng.randrange(40))}")
        out.append(" ".join(words[:-1] + ["zzz"]))
        out.append(" ".join(words[: len(words) // 2]) + " " + fill(30))
        out.append(f"{fill(rng.randrange(20))} {' '.join(rng.sample(words, len(words)))}")
    return out


def plain_licenses(text):
    w = WORD.findall(lowered(text))
    places = sorted((k, label) for phrase, label in license_scan.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
    base, labels, best = {x for _, x in places}, set(), 0.0
    for t in license_scan.production_templates():
        for first in range(0, len(w), t.span):
            shared = len(set(t.words) & set(w[first : first + 2 * t.span]))
            if shared >= t.least:
                labels.add(t.label)
                best = max(best, shared / len(t.words))
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (len(w), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best)


def test_license_scan_equals_brute_force(spark):
    texts = license_texts()
    rows = [(k if k % 9 else None, t, 5, "old") for k, t in enumerate(texts)] + [(3, texts[3], 5, "old")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words long, labels string").repartition(3)
    got = license_scan.scanned(frame).select("text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == plain_licenses(r["text"]), r["text"]
    assert sum("mit" in r["labels"] for r in got) >= 3
    assert license_scan.scanned(frame.limit(0)).count() == 0


def test_prefixes_follow_the_corpus(spark):
    texts = spark.createDataFrame([(b"1", "mit license mit license license the the the"), (b"2", "the")], "text_id binary, _norm string")
    assert license_scan.rarity(texts, ["license", "mit", "the", "apache"]) == ["apache", "mit", "license", "the"]


def plain_search(docs, items, k):
    counts = [Counter(WORD.findall(lowered(t))) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    documents, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c, size in zip(docs, counts, n):
            score = 0
            for t in WORD.findall(lowered(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * documents // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def search_rows():
    rng = random.Random(8)

    def text(n):
        return " ".join(f"{rng.choice('TtuÜ')}{int(rng.paretovariate(0.7)) % 900}" for _ in range(n))

    docs = [(None if k % 50 == 7 else 1000 - k, text(rng.randrange(1, 60))) for k in range(700)]
    docs += [(2000, None), (2001, ""), (2002, "- !"), (2003, text(30_000)), (5, docs[40][1]), (5, docs[40][1]), (6, docs[40][1])]
    items = [(k, text(rng.randrange(1, 12))) for k in range(40)] + [(40, None), (41, "?"), (42, "nowhere"), (43, docs[40][1]), (43, docs[40][1]), (None, "t1 t1 t2")]
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = search_rows()
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, rank int, score long").repartition(3)
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id long").repartition(2)
    got = lexical_search.searched(lexical_search.built(frame, common.scratch(spark)), asked, k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_search(docs, items, 10))
    none = lexical_search.built(frame.limit(0), common.scratch(spark))
    assert lexical_search.searched(none, asked).count() == 0
    assert lexical_search.searched(lexical_search.built(frame, common.scratch(spark)), asked.limit(0)).count() == 0


def test_queries_in_blocks_are_the_same(spark, monkeypatch):
    docs, items = search_rows()
    index = lexical_search.built(spark.createDataFrame(docs, "doc_id long, text string"), common.scratch(spark))
    asked = spark.createDataFrame(items, "item_id long, text string")
    whole = Counter(map(tuple, lexical_search.searched(index, asked).collect()))
    monkeypatch.setattr(lexical_search, "QUERIES", 7)
    assert Counter(map(tuple, lexical_search.searched(index, asked).collect())) == whole


def test_block_maxima_spare_blocks():
    rng = random.Random(2)
    texts = [" ".join(["common"] * rng.randrange(1, 9) + ["rare"] * (k % 400 == 0) + ["Éä", "ß"] * (k % 3) + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))]) for k in range(12_000)]
    shard = lexical_search.ShardBuilder()
    whole = pa.array(texts)
    for first in range(0, len(texts), 5000):
        shard.add(list(range(first, min(first + 5000, len(texts)))), whole.slice(first, 5000))
    total = sum(len(t.split()) for t in texts)
    sizes, names, numbers, data = shard.blocks(len(texts), total)
    assert sizes.tolist() == [len(t.split()) for t in texts] and set(shard.codes) == {w for t in texts for w in t.split()}
    m = lexical_search.lengths(sizes, len(texts), total)
    lists = {}
    for name in ("common", "rare", "w3"):
        own = [k for k, x in enumerate(names.to_pylist()) if x == name]
        lists[name] = lexical_search.PostingList(*[numbers[x][own] for x in ("block", "first", "last", "top")], [data[k].as_py() for k in own], m)
    query = [(lists["common"], 3), (lists["rare"], 6000), (lists["w3"], 40)]
    got = lexical_search.best_of_shard(query, np.arange(len(texts)), 10)
    score = {}
    for k, t in enumerate(texts):
        c = Counter(t.split())
        score[k] = sum(w * (10**9 * c[x] // (1000 * c[x] + 8 * int(m[k]))) for x, w in (("common", 3), ("rare", 6000), ("w3", 40)) if c[x])
    assert got == sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]
    assert len(lists["common"].open) < len(lists["common"].data) / 2


def test_packed_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 300, 16_383, 16_384, 2**31, 2**40 + 5, 2**61], dtype=np.int64)
    data, start = lexical_search.packed_numbers(values)
    assert lexical_search.unpacked_numbers(data.tobytes()).tolist() == values.tolist() and start[-1] == len(data)


def cheapest(symbols):
    """Least cost, then ASCII-least audit, by exhaustive search over (cost, audit)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(symbols) and state in (0, 3):
            return cost, audit
        turned = 3 if state == 2 else 2
        heapq.heappush(heap, (cost + 5, audit + "I", k, turned))
        if k < len(symbols):
            x = symbols[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state))
            if x != "x":
                more = 5 * x.isupper()
                heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, turned))
                if x.lower() == ("a" if state == 2 else "u"):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, turned))
                if x.lower() == "s" and state == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, 1))


def test_nodes_give_the_cheapest_and_least_audit():
    rng = random.Random(6)
    found = ["", *("".join(rng.choice("xsuaoSUAO" if k % 2 else "sua") for _ in range(rng.randrange(1, 9))) for k in range(400))]
    path = conversation_repair.SuffixPath()
    for s in sorted(found, key=lambda x: x[::-1]):
        assert path.solve(s) == cheapest(s), s
    suffixes = {s[k:] for s in found for k in range(len(s))}
    assert path.made == len(suffixes)


def plain_repair(rows):
    """The contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        lines = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            lines += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        lines.sort()
        seen, symbols, n = set(), "", Counter()
        for _, _, role, text in lines:
            kept = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        turns = [t for there, t, _, _ in lines if there]
        cost, audit = cheapest(symbols)
        k, last, made = 0, "", []
        for x in audit:
            turned = "assistant" if last == "u" else "user"
            if x == "I":
                made.append(turned + ":")
            else:
                _, _, role, text = lines[k]
                k += 1
                if x == "D":
                    continue
                turned = turned if x == "R" else role
                made.append(f"{turned}:{text}")
            last = turned[0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(12)
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "User"]) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            text = rng.choice([None, "", " \n", "Yes.", "No", "Why?", "é!\n "])
            out.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 1, 4]), role, text))
    return out + out[:9] + [(900, k, ("user", "assistant")[k % 2], f"Line {k}.") for k in range(3000)] + [(901, None, "user", "x " * 50_000 + ".")]


@pytest.mark.parametrize("parts", [1, 5])
def test_repair_equals_a_plain_version(spark, parts):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "c", 7) for r in rows], "conv_id long, turn long, role string, text string, cost string, at int").repartition(parts)
    got = conversation_repair.repaired(conversation_repair.damaged(frame))
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == plain_repair(rows)
    assert conversation_repair.repaired(conversation_repair.damaged(frame.limit(0))).count() == 0
