"""Queries of this package over the test tables, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm import bpe, leakage, lookalike, mixing, overlap, percentiles, pii, splits, subjects
from utterlake.llm.common import delivered_once, table


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """table_name, row_id, field, text of the three fields where people speak."""

    def fields(name: str, key: str, *columns: str) -> DataFrame:
        t = table(spark, d, name).where(F.col(key).isNotNull())
        return t.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("f")).select("table_name", "row_id", "f.field", "f.text")

    return fields("evaluation_result", "result_id", "reference", "generated").unionByName(fields("data_synthesize", "sample_id", "continuation_transcript"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_spans(_spoken(spark, d)).select("table_name", "row_id", "field", "kind").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = _spoken(spark, d).distinct()
    return pii.redact(texts, pii.find_spans(texts)).select("table_name", "row_id", "field", "redacted")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "data_synthesize")
    return s.select(F.col("sample_id").alias("id"), "split", "source", "lang", F.col("previous_transcript").alias("previous"), F.col("continuation_transcript").alias("continuation"), "audio_path", "timestamp")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(_compared(spark, d)).select(F.col("id_a").alias("sample_id_a"), F.col("id_b").alias("sample_id_b")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and evaluation samples touched, per split and source of the evaluation sample."""
    return overlap.report(_compared(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "data_synthesize").where("audio_path is not null")
    return splits.group_records(samples, "sample_id", "audio_path").select("sample_id", "group_id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    groups = splits.group_records(table(spark, d, "data_synthesize"), "sample_id", "audio_path")
    targets = [(r["split_name"], r["share"]) for r in table(spark, d, "split_targets").collect()]
    return splits.assign_splits(groups, targets, "sample_id")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the splits reached."""
    return splits.split_shares(p3_splits(spark, d), table(spark, d, "split_targets")).withColumn("reached", F.round("reached", 9))


METRICS = ("first_token_latency_ms", "last_token_latency_ms", "cer")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """part, key, metric, value: every result once, per run, source and day. Negative latencies
    are markers of a missing one and are left out."""
    r = delivered_once(table(spark, d, "evaluation_result"), "result_id", "run_id", "source", "evaluated_at", *METRICS)
    keys = F.array(*[F.struct(F.lit(n).alias("part"), c.alias("key")) for n, c in (("run", F.col("run_id")), ("source", F.col("source")), ("day", F.date_format("evaluated_at", "yyyy-MM-dd")))])
    metrics = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    long = r.select(F.explode(metrics).alias("m"), "run_id", "source", "evaluated_at").where("m.value is not null and not isnan(m.value) and (m.metric = 'cer' or m.value >= 0)")
    return long.select(F.explode(keys).alias("k"), "m").select("k.part", "k.key", "m.metric", "m.value")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.grids(_measures(spark, d), ["part", "key", "metric"], "value").withColumnRenamed("step", "percent")


def p4_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each month put together from those of its days."""
    days = percentiles.grids(_measures(spark, d).where("part = 'day'"), ["key", "metric"], "value")
    return percentiles.combine(days.withColumn("month", F.substring("key", 1, 7)), ["month", "metric"], [5, 25, 50, 75, 90, 95, 99], ["key"])


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "data_synthesize").where("split = 'train' and source is not null")
    tokens = mixing.tokens_of(F.col("previous_transcript")) + mixing.tokens_of(F.col("continuation_transcript"))
    docs = delivered_once(s.select("sample_id", F.lower("source").alias("source"), tokens.alias("tokens")), "sample_id", "source", "tokens")
    entries = table(spark, d, "training_qwen2audio").select("config_id", "entry_no", F.col("train_data_paths").alias("path"), "weight", "max_repeat")
    return docs, mixing.rates(docs.groupBy("source").agg(F.sum("tokens").alias("size")), entries)


def p5_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_rated(spark, d), "sample_id")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, rated = _rated(spark, d)
    out = mixing.shares(mixing.mix(docs, rated, "sample_id"), rated)
    return out.select("config_id", "source", "size", *[F.round(c, 9).alias(c) for c in ("target_share", "rate", "reached_share")], "documents", "tokens")


def p5_targets(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and target shares of the sources of each configuration."""
    return _rated(spark, d)[1].select("config_id", "source", "size", F.round("target_share", 9).alias("target_share"))


def _canonical_values(spark: SparkSession, d: str) -> DataFrame:
    """result_id, field, value, canonical of both fields of evaluation_result."""
    r = table(spark, d, "evaluation_result").where("result_id is not null")
    values = r.select("result_id", "lang", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("reference", "generated")])).alias("v")).select("result_id", "lang", "v.field", "v.value")
    return lookalike.canonicalize(values, "value", "lang")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _canonical_values(spark, d).where("canonical <> value").select("result_id", "field").distinct()


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return _canonical_values(spark, d).select("result_id", "field", "canonical").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _subjects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """documents, labels and the names of the subjects."""
    names = [r["subject"] for r in table(spark, d, "subjects").select("subject").distinct().collect()]
    return table(spark, d, "documents"), table(spark, d, "subject_labels"), names


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(*_subjects(spark, d)).select("doc_id", "subject").distinct()


def p9_makeup(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus by subject: documents and their sources."""
    docs = table(spark, d, "documents")
    found = subjects.assign(*_subjects(spark, d)).select("doc_id", "subject").distinct()
    return found.join(docs.select("doc_id", "source"), "doc_id").groupBy("subject", "source").agg(F.count(F.lit(1)).alias("documents"))


def p9_topics(spark: SparkSession, d: str) -> DataFrame:
    """The fitted topics, their subjects and the top terms inspected for them."""
    return spark.createDataFrame(subjects.topics(subjects.model(*_subjects(spark, d))), "grp string, topic int, subject string, weight double, terms string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_MEASURED = "SELECT DISTINCT result_id, run_id, source, evaluated_at, first_token_latency_ms, last_token_latency_ms, cer FROM evaluation_result WHERE result_id IS NOT NULL"
_LONG = " UNION ALL ".join(
    f"SELECT '{part}' AS part, {key} AS key, '{m}' AS metric, {m} AS value FROM ({_MEASURED}) WHERE {m} IS NOT NULL AND NOT isnan({m})" + (f" AND {m} >= 0" if m != "cer" else "")
    for part, key in (("run", "run_id"), ("source", "source"), ("day", "strftime(evaluated_at, '%Y-%m-%d')"))
    for m in METRICS
)
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY part, key, metric ORDER BY value) AS place, count(*) OVER (PARTITION BY part, key, metric) AS n FROM ({_LONG})"

_CORPUS = r"list_last(string_split(regexp_replace(regexp_replace(lower(trim(train_data_paths)), '[\\/]+', '/', 'g'), '/[^/]*$', ''), '/'))"
_SIZES = r"SELECT source, CAST(sum(t) AS DOUBLE) AS size FROM (SELECT DISTINCT sample_id, lower(source) AS source, len(regexp_extract_all(coalesce(previous_transcript, ''), '{0}')) + len(regexp_extract_all(coalesce(continuation_transcript, ''), '{0}')) AS t FROM data_synthesize WHERE split = 'train' AND source IS NOT NULL AND sample_id IS NOT NULL) GROUP BY source".format(r"[㐀-䶿一-鿿]|[^\s\p{P}㐀-䶿一-鿿]+")


_ONCE = "SELECT DISTINCT sample_id, lower(source) AS source, {0} AS tokens FROM data_synthesize WHERE split = 'train' AND source IS NOT NULL AND sample_id IS NOT NULL".format(" + ".join(f"len(regexp_extract_all(coalesce({c}, ''), '[㐀-䶿一-鿿]|[^\\s\\p{{P}}㐀-䶿一-鿿]+'))" for c in ("previous_transcript", "continuation_transcript")))
_ENTRIES = f"SELECT config_id, source, sum(weight) AS weight, max(max_repeat) AS max_repeat FROM (SELECT DISTINCT config_id, entry_no, {_CORPUS} AS source, CAST(coalesce(weight, 1) AS DOUBLE) AS weight, CAST(coalesce(max_repeat, 1) AS DOUBLE) AS max_repeat FROM training_qwen2audio) WHERE weight > 0 AND source IS NOT NULL GROUP BY config_id, source"
# how far the total goes until a source is used up, and what is left for those after
_REACH = f"SELECT *, CASE WHEN target_share > 0 THEN max_repeat * size / target_share END AS reach FROM (SELECT *, CASE WHEN size > 0 THEN weight ELSE 0 END / sum(CASE WHEN size > 0 THEN weight ELSE 0 END) OVER (PARTITION BY config_id) AS target_share FROM (SELECT e.*, coalesce(z.size, 0) AS size FROM ({_ENTRIES}) e LEFT JOIN ({_SIZES}) z ON e.source = z.source))"
_LEVEL = f"SELECT *, (total - used) / nullif(lacking, 0) AS level FROM (SELECT *, sum(size) OVER (PARTITION BY config_id) AS total, coalesce(sum(max_repeat * size) OVER w, 0) AS used, 1.0::DOUBLE - coalesce(sum(target_share) OVER w, 0) AS lacking FROM ({_REACH}) WINDOW w AS (PARTITION BY config_id ORDER BY reach NULLS LAST, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_HELD = f"SELECT *, coalesce(target_share > 0 AND level >= reach, false) AS held FROM ({_LEVEL})"
_RATES = f"SELECT h.config_id, h.source, h.size, h.target_share, h.max_repeat, CASE WHEN h.size > 0 THEN least(coalesce(CASE WHEN held THEN max_repeat ELSE target_share * l.level / size END, 0), max_repeat) ELSE 0 END AS rate FROM ({_HELD}) h LEFT JOIN (SELECT config_id, arg_min(level, struct_pack(a := reach, b := source)) AS level FROM ({_HELD}) WHERE NOT held AND target_share > 0 GROUP BY config_id) l ON h.config_id = l.config_id"


def _unit(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('-', '42', {0})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE".format(", ".join(f"CAST({x} AS VARCHAR)" for x in parts))


_MIXED = f"SELECT config_id, source, sample_id, tokens, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INTEGER) AS copy FROM (SELECT r.config_id, r.source, d.sample_id, d.tokens, least(floor(rate) + CASE WHEN {_unit('r.config_id', 'd.sample_id')} < rate - floor(rate) THEN 1 ELSE 0 END, floor(max_repeat)) AS n FROM ({_ONCE}) d JOIN ({_RATES}) r ON d.source = r.source WHERE rate > 0)"
_SHARED = f"SELECT r.config_id, r.source, r.size, round(target_share, 9) AS target_share, round(rate, 9) AS rate, coalesce(documents, 0) AS documents, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(coalesce(coalesce(tokens, 0) / nullif(sum(coalesce(tokens, 0)) OVER (PARTITION BY r.config_id), 0), 0), 9) AS reached_share FROM ({_RATES}) r LEFT JOIN (SELECT config_id, source, count(*) AS documents, sum(tokens) AS tokens FROM ({_MIXED}) GROUP BY config_id, source) m ON r.config_id = m.config_id AND r.source = m.source"

# session and speaker of a path; the regular expressions of this engine have no look-around
_PATH = r"TRY_CAST(regexp_extract(lower(url_decode(audio_path)), '(?s)^.*(?:^|[^a-z]){0}[\s_\-]*0*([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT)"
_NODES = f"SELECT DISTINCT sample_id, {_PATH.format('ses(?:sion)?')} AS session, {_PATH.format('sp(?:ea)?k(?:er)?')} AS speaker FROM data_synthesize WHERE sample_id IS NOT NULL"
_LINKS = f"SELECT DISTINCT coalesce(session, speaker + {1 << 61}) AS a, coalesce(speaker + {1 << 61}, session) AS b FROM ({_NODES}) WHERE session IS NOT NULL OR speaker IS NOT NULL"
# every node with the least one that reaches it: reachability is closed over the few nodes
_COMPONENTS = f"SELECT node, min(other) AS component FROM (WITH RECURSIVE links AS (SELECT a, b FROM ({_LINKS}) UNION SELECT b, a FROM ({_LINKS})), reach(node, other) AS (SELECT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a) SELECT * FROM reach) GROUP BY node"
_GROUPED = f"SELECT n.sample_id, min(CASE WHEN c.component >= {1 << 61} THEN -(c.component - {1 << 61}) - 1 ELSE c.component END) AS group_id FROM ({_NODES}) n LEFT JOIN ({_COMPONENTS}) c ON coalesce(n.session, n.speaker + {1 << 61}) = c.node GROUP BY n.sample_id"
_CUTS = "SELECT split_name, share, sum(share) OVER (ORDER BY split_name) / sum(share) OVER () AS upto FROM split_targets WHERE share > 0"
_SPLIT = f"SELECT sample_id, group_id, (SELECT coalesce(min(split_name) FILTER (WHERE u < upto), max(split_name)) FROM ({_CUTS})) AS split FROM (SELECT *, {_unit('coalesce(CAST(group_id AS VARCHAR), chr(114) || sample_id)')} AS u FROM ({_GROUPED}))"

_DAYS = f"SELECT key, metric, n, place, value FROM ({_RANKED}) WHERE part = 'day'"
_GRID = f"SELECT substr(r.key, 1, 7) AS month, r.metric, r.value, (s.i * r.n + 99) // 100 - ((s.i - 1) * r.n + 99) // 100 AS w FROM ({_DAYS}) r, (SELECT unnest(range(1, 101)) AS i) s WHERE r.place = greatest(1, (s.i * r.n + 99) // 100)"
_POINTS = f"SELECT month, metric, value, w, CAST(sum(w) OVER (PARTITION BY month, metric ORDER BY value) AS BIGINT) AS upto, CAST(sum(w) OVER (PARTITION BY month, metric) AS BIGINT) AS n FROM (SELECT month, metric, value, sum(w) AS w FROM ({_GRID}) GROUP BY month, metric, value)"


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express at all on whole tables; the other operators are tested
    against brute force."""
    return {
        "p3_found": f"SELECT g.sample_id, g.group_id FROM ({_GROUPED}) g SEMI JOIN (SELECT sample_id FROM data_synthesize WHERE audio_path IS NOT NULL) s ON g.sample_id = s.sample_id",
        "p3_splits": _SPLIT,
        "p3_shares": f"SELECT t.split_name, t.share, coalesce(records, 0) AS records, round(coalesce(records, 0) / sum(coalesce(records, 0)) OVER (), 9) AS reached FROM split_targets t LEFT JOIN (SELECT split, count(*) AS records FROM ({_SPLIT}) GROUP BY split) s ON t.split_name = s.split",
        "p4_percentiles": f"SELECT r.part, r.key, r.metric, r.n, CAST(s.i AS INTEGER) AS percent, r.value FROM ({_RANKED}) r, (SELECT unnest(range(101)) AS i) s WHERE r.place = greatest(1, (s.i * r.n + 99) // 100)",
        "p4_combined": f"SELECT month, metric, n, CAST(q.percent AS INTEGER) AS percent, value FROM ({_POINTS}) p, (SELECT unnest([5, 25, 50, 75, 90, 95, 99]) AS percent) q WHERE upto >= greatest(1, (q.percent * n + 99) // 100) AND upto - w < greatest(1, (q.percent * n + 99) // 100)",
        "p5_mixture": _MIXED,
        "p5_shares": _SHARED,
        "p5_targets": f"SELECT config_id, source, size, round(target_share, 9) AS target_share FROM ({_RATES})",
    }
