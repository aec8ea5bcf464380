"""The queries of the text operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton, decontaminate, huffman, importance, line_dedup, near_dedup, packing, pii, quality_model, quality_rules, repeats, secrets, sharding, source_audit
from .common import count_kind, documents, span_text, text_of
from .tokens import tokenizer_path


def base_digest(spans, kinds):
    """sha256 of the spans of the given kinds, as kind:start:end, comma-joined."""
    return F.sha2(span_text(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        *[count_kind(out["spans"], k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        base_digest(out["spans"], secrets.KINDS[:3]).alias("base_sha256"),
        span_text(out["spans"]).alias("spans"),
        F.size(out["spans"]).cast("long").alias("n_spans"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer_path()))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_model.classify(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "expected_grade", "top_probability", "kept")


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.removed_runs(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir).select("doc_id", "text"))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = text_of(docs)
    facts = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("tie"))
    out = sharding.histogram_shard(facts, "doc_id", F.col("size"), F.col("tie"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_back(huffman.encode_corpus(documents(spark, sf_dir), tokenizer_path()))


def op9_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        *[count_kind(out["spans"], k).alias(f"n_{k}") for k in pii.KINDS[:4]],
        base_digest(out["spans"], pii.KINDS[:4]).alias("base_sha256"),
        span_text(out["spans"]).alias("spans"),
        F.size(out["spans"]).cast("long").alias("n_spans"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.measure(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_removed"
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_histogram_shards": op7_histogram_shards,
    "op8_token_files": op8_token_files,
    "op9_pii_scan": op9_pii_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_divergence": op12_source_divergence,
    "op13_line_dedup": op13_line_dedup,
}


def quality_rules_sql() -> str:
    """The rules of op10, from the same patterns."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    holds = lambda line, pattern: f"regexp_matches({line}, {quoted(pattern)})"
    no_possessive = quality_rules.NAVIGATION_MARKS.replace("*+", "*")
    boilerplate = " OR ".join(f"contains(lower(line), {quoted(x)})" for x in quality_rules.BOILERPLATE)
    symbols = lambda x: f"length(regexp_replace({x}, {quoted('[^' + quality_rules.SYMBOLS[1:])}, '', 'g'))"
    word = quoted(quality_rules.WORDED + "+")
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT r, doc_id, t, regexp_extract_all(t, {word}) AS w FROM texts),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts),
judged AS (
  SELECT r, line, len(regexp_extract_all(line, {word})) AS n,
    NOT {holds("line", quality_rules.LINE_END)} OR {holds("line", no_possessive)} OR {symbols("line")} > CAST(0.1 AS DOUBLE) * length(line)
      OR {holds("lower(line)", quality_rules.NAVIGATION_LINE)} OR {boilerplate} AS failed
  FROM lines WHERE {holds("line", quality_rules.WORDED)}),
by_line AS (
  SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines, CAST(count(*) FILTER (failed) AS BIGINT) AS n_lines_removed,
    CAST(coalesce(sum(n) FILTER (failed), 0) AS BIGINT) AS n_words_removed
  FROM judged GROUP BY r),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS triple FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, triple) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS ks(k) GROUP BY r),
facts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({symbols("t")} AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(n_words_removed, 0) AS n_words_removed
  FROM worded LEFT JOIN by_line USING (r) LEFT JOIN repeated USING (r)),
verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT *, NOT base_failed AND n_words_removed <= CAST(0.5 AS DOUBLE) * n_words AS kept FROM verdicts"""


IMPORTANCE_SQL = f"""
WITH texts AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS t FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}') FROM benchmark),
worded AS (SELECT side, r, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
features AS (
  SELECT side, r, unnest(w) AS feature FROM worded
  UNION ALL SELECT side, r, w[i] || ' ' || w[i + 1] FROM (SELECT side, r, w, unnest(range(1, len(w))) AS i FROM worded WHERE len(w) > 1)),
counted AS (SELECT side, r, feature, count(*) AS n FROM features GROUP BY ALL),
coded AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)),
hashed AS (
  SELECT feature, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, ({automaton.TABLE.tolist()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket FROM coded),
placed AS (SELECT side, r, bucket, n FROM counted JOIN hashed USING (feature)),
buckets AS (SELECT bucket, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM placed GROUP BY bucket),
totals AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM buckets),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + {importance.BUCKETS}) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (t_all + {importance.BUCKETS})))) AS BIGINT) AS gain
  FROM buckets, totals),
sums AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE side = 's' GROUP BY r),
facts AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM worded LEFT JOIN sums USING (r) WHERE side = 's'),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM facts),
ordered AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {importance.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {importance.PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN ordered USING (r)"""

DIVERGENCE_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
terms AS (SELECT r, lang, source, unnest(w) AS term FROM texts),
counted AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS documents FROM terms GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term HAVING sum(documents) >= {source_audit.MIN_DOCUMENTS}),
langs AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
totals AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM groups g LEFT JOIN (SELECT c.* FROM counted c SEMI JOIN kept USING (lang, term)) c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST({source_audit.UNIT} AS HUGEINT) * (coalesce(c.n, 0) + {source_audit.ADDED}) // (t.n + 2 * l.v) AS p,
    1 + CAST({source_audit.UNIT} AS HUGEINT) * (CAST(k.n AS HUGEINT) + {source_audit.ADDED}) // (l.n + 2 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {source_audit.TOP}"""

LINE_DEDUP_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM texts),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, i, line, key IN (SELECT key FROM common) AS gone FROM keyed),
joined AS (SELECT r, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts JOIN joined USING (r)"""


ORACLE_SQL = {"op10_quality_rules": quality_rules_sql(), "op11_importance_resampling": IMPORTANCE_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_line_dedup": LINE_DEDUP_SQL}
