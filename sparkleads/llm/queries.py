"""The operators bound to the given tables: QUERIES by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, language_id, license_scan, lexical_search, ngram_join, packing, page_labels, pii, quality_model, quality_rules, secret_scan, sharding, url_filter
from .common import scratch, table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a window that is similar to a benchmark item, with the best window of each item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.leaks_by_document(docs, found).select("doc_id", "item_id", "window_start", "n_words", F.round("similarity", 6).alias("similarity"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `bytes`."""
    out = sharding.sharded(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL, learnt from the rules and from what all pages hold."""
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train(page_labels.labelled(pages))
    return url_filter.judged(pages.select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict", F.round("block_probability", 6).alias("block_probability"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, scratch(spark))
    return secret_scan.with_digest(docs, found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = quality_model.scored(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and number of links of every document under Jaccard similarity 0.8 of word five-grams."""
    return ngram_join.joined(table(spark, sf_dir, "documents")).withColumnRenamed("row_id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line statistics of every document and the verdict of the rule cascade."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.ordered(quality_rules.cheap_statistics(docs), quality_rules.production_rules())
    judged = quality_rules.judged(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, by a word model learnt from the documents' languages."""
    model = language_id.train_words(table(spark, sf_dir, "documents"))
    return language_id.identified(table(spark, sf_dir, "pages"), model)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.ids_crc32(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_spans(docs)
    return pii.with_digest(docs, found).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    index = lexical_search.built(table(spark, sf_dir, "documents"), scratch(spark))
    return lexical_search.searched(index, table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every damaged conversation."""
    damaged = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    out = conversation_repair.repaired(damaged)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_sharding, op3_url_filter, op4_secret_scans, op5_quality_classifier,
    op6_ngram_jaccard_join, op7_quality_rules, op8_language_id, op9_packing, op10_pii,
    op11_license_scans, op12_lexical_search, op13_conversation_repair,
)}

ORACLES: dict[str, str] = {}

# RE2 has no character escapes like \x20 inside [] differently from Java; both read these alike.
_SPANS = """
  SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, hit,
         CAST(sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(hit) AS BIGINT) AS s,
         CAST(sum(gap + length(hit)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS hit, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g
              FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{pattern}')))
"""


def _spans(kind: str, order: int, pattern: str, keep: str = "true") -> str:
    return f"SELECT * FROM ({_SPANS.format(kind=kind, order=order, pattern=pattern.replace(chr(39), chr(39) * 2))}) WHERE {keep}"


_ASSIGN = "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ORACLES["op4_secret_scans"] = f"""
WITH found AS (
  {_spans("assign", 0, _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 1)) >= 8")}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 16")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", "length(hit) >= 32")}
  UNION ALL {_spans("pem", 3, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")}
  UNION ALL {_spans("jwt", 4, "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}")}
), digests AS (
  SELECT doc_id, count_if(kind = 'assign') AS a, count_if(kind = 'access') AS c, count_if(kind = 'hex') AS h,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) FILTER (kind_order < 3), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) AS spans
  FROM found GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN digests f ON d.doc_id = f.doc_id
"""

ORACLES["op7_quality_rules"] = """
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t
  FROM words WHERE len(w) >= 3
), repeated AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY doc_id
), counted AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '\\P{L}+', '', 'g')) AS letters, length(regexp_replace(text, '\\P{Lu}+', '', 'g')) AS upper,
         length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits, len(list_distinct(w)) AS kinds
  FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 20 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 10 * n_dup_lines > n_words
           OR 2 * letters < word_chars OR 2 * upper > letters OR 3 * digits > word_chars OR 20 * kinds < n_words) AS kept
FROM counted
"""

ORACLES["op6_ngram_jaccard_join"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, coalesce(text, '') AS text FROM documents
), texts AS (
  SELECT text, min(doc_id) AS t, count(*) AS copies, any_value(w) AS w FROM words GROUP BY text
), grams AS (
  SELECT DISTINCT t, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM texts
), sizes AS (
  SELECT t, count(*) AS n FROM grams GROUP BY t
), shared AS (
  SELECT a.t AS a, b.t AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.t <> b.t GROUP BY a.t, b.t
), near AS (
  SELECT a, b FROM shared JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach(t, root) AS (
  SELECT t, t FROM texts UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.t
), classes AS (
  SELECT t, min(root) AS class_id FROM reach GROUP BY t
), partners AS (
  SELECT a AS t, sum(copies) AS n FROM near JOIN texts ON texts.t = near.b GROUP BY a
)
SELECT d.doc_id, classes.class_id, CAST(coalesce(n, 0) + copies - 1 AS BIGINT) AS links
FROM documents d JOIN texts ON coalesce(d.text, '') = texts.text JOIN classes ON classes.t = texts.t LEFT JOIN partners ON partners.t = texts.t
"""

ORACLES["op1_benchmark_decontamination"] = """
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), bench AS (
  SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT item_id, len(w) - 4 AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM bench WHERE len(w) >= 5
), item_weights AS (
  SELECT item_id, n, x AS g, count(*) AS c FROM (SELECT item_id, n, unnest(g) AS x FROM items) GROUP BY ALL
), grams AS (
  SELECT doc_id, len(w) - 4 AS total, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM docs WHERE len(w) >= 5
), seeds AS (
  SELECT DISTINCT doc_id, total, p, item_id, n, least(n, total) AS width FROM grams JOIN item_weights USING (g)
), starts AS (
  SELECT DISTINCT doc_id, item_id, n, width, unnest(range(greatest(0, p - width + 1), least(p, total - width) + 1)) AS s FROM seeds
), windows AS (
  SELECT t.doc_id, item_id, n, width, s, grams.g, count(*) AS c FROM starts t JOIN grams ON grams.doc_id = t.doc_id AND p BETWEEN s AND s + width - 1 GROUP BY ALL
), scored AS (
  SELECT doc_id, w.item_id, w.n, width, s, sum(least(w.c, coalesce(i.c, 0))) AS lesser
  FROM windows w LEFT JOIN item_weights i ON i.item_id = w.item_id AND i.g = w.g GROUP BY ALL
), passed AS (
  SELECT *, lesser / (width + n - lesser) AS similarity FROM scored WHERE 5 * lesser >= 4 * (width + n - lesser)
), best AS (
  SELECT doc_id, item_id, s, width + 4 AS n_words, similarity FROM passed QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
), short AS (
  SELECT doc_id, item_id, i - 1 AS s, len(b.w) AS n_words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT len(w) AS n FROM bench WHERE len(w) BETWEEN 1 AND 4)) d
  JOIN bench b ON len(b.w) = n AND d.w[i:i + n - 1] = b.w
)
SELECT doc_id, item_id, CAST(s AS INTEGER) AS window_start, CAST(n_words AS INTEGER) AS n_words, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM best
UNION ALL SELECT doc_id, item_id, CAST(min(s) AS INTEGER), CAST(any_value(n_words) AS INTEGER), 1.0 FROM short GROUP BY doc_id, item_id
"""


def _license_oracle() -> str:
    """Every block of every text against every template of its span."""
    found = license_scan.production_templates()
    rows = ", ".join(f"('{t.label}', {t.span}, {t.least}, {list(t.words)!r})" for t in found)
    base = ", ".join(f"({p.split(' ')!r}, '{label}')" for p, label in license_scan.BASE_PHRASES.items())
    return f"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), templates(label, span, least, t) AS (VALUES {rows}), phrases(p, label) AS (VALUES {base}), places AS (
  SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS i FROM docs, phrases
), based AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
), blocks AS (
  SELECT doc_id, span, w[b * span + 1:(b + 2) * span] AS w FROM (SELECT doc_id, w, span, unnest(range(0, len(w) // span + 1)) AS b FROM docs, (SELECT DISTINCT span FROM templates))
), matched AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best
  FROM (SELECT doc_id, label, least, len(t) AS n, len(list_intersect(t, b.w)) AS shared, shared / n AS c FROM blocks b JOIN templates USING (span)) WHERE shared >= least GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(array_to_string(based.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM docs d LEFT JOIN based ON based.doc_id = d.doc_id LEFT JOIN matched m ON m.doc_id = d.doc_id
"""


ORACLES["op11_license_scans"] = _license_oracle()

ORACLES["op12_lexical_search"] = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), sizes AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), wanted AS (
  SELECT item_id, t, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL
), postings AS (
  SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM postings GROUP BY t), totals
), impacts AS (
  SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS impact FROM postings JOIN sizes USING (doc_id), totals
), scored AS (
  SELECT item_id, doc_id, CAST(sum(c * weight * impact) AS BIGINT) AS score FROM wanted JOIN weights USING (t) JOIN impacts USING (t) GROUP BY ALL HAVING score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10
"""


def _repair_oracle() -> str:
    """The cheapest edits of every conversation from its end, with one struct of cost, audit and lines for each state of the grammar."""
    crc = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
    follow = {0: 2, 1: 2, 2: 3, 3: 2}

    def one(cost: str, letter: str, rest: str, line: str = "") -> str:
        return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 't': {f'list_concat([{line}], {rest}.t)' if line else f'{rest}.t'}}}"

    def turned(state: int) -> str:
        return "assistant" if state == 2 else "user"

    def base(state: int) -> str:
        after = f"s{follow[state]}"
        kept = f"WHEN i.initial = '{turned(state)[0]}' THEN {one('cut', 'K', after, 'line')}"
        kept += f" WHEN i.initial = 's' THEN {one('cut', 'K', 's1', 'line')}" if state == 0 else ""
        return (f"least({one('2', 'D', f's{state}')}, CASE WHEN goes THEN NULL ELSE {one('1 + cut', 'R', after, f"{turned(state)!r} || ':' || i.text")} END, "
                f"CASE WHEN goes THEN NULL {kept} END) AS b{state}")  # fmt: skip

    def inserted(state: int, old: str) -> str:
        return f"least({old}{state}, {one('5', 'I', f'{old}{follow[state]}', f"{turned(state)!r} || ':'")})"

    return f"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS kind
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} AS crc FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations))
), rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept FROM rows
), faults AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN kept = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
            WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), lines AS (
  SELECT *, fault IN ('blank', 'duplicate') AS goes, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut, role || ':' || text AS line,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM faults
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM lines GROUP BY conv_id
), best(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, n, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}}, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': 5, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} FROM stats
  UNION ALL
  SELECT conv_id, pos, {', '.join(inserted(s, 'r') for s in range(4))} FROM (
    SELECT conv_id, pos, {', '.join(f"{inserted(s, 'b')} AS r{s}" for s in range(4))} FROM (
      SELECT i.conv_id, best.pos - 1 AS pos, {', '.join(base(s) for s in range(4))} FROM best JOIN lines i ON i.conv_id IS NOT DISTINCT FROM best.conv_id AND i.pos = best.pos))
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id AND best.pos = 0
"""


ORACLES["op13_conversation_repair"] = _repair_oracle()
