"""Queries over the test tables for the transcript operators, each with SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.functions import metrics as M
from utterlake.functions import pcm as P
from utterlake.functions import text as T
from utterlake.operators import beam, dataset, segment, synthesis
from utterlake.operators.segment import FRAME
from utterlake.plans import evaluate
from utterlake.streaming import router

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- SQL texts of the text functions ----
def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CJK = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in T.CJK_RANGES) + "]"
_WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"


def sql_cjk(s: str) -> str:
    return f"coalesce(regexp_matches({s}, '{_CJK}'), false)"


def sql_language(hint: str, text: str) -> str:
    h = f"lower(trim(coalesce({hint}, '')))"
    return f"CASE WHEN coalesce({text}, '') = '' THEN NULL WHEN {h} IN ('yue', 'zh') THEN {h} WHEN regexp_matches({h}, 'yue|canton|hongkong|hk') THEN 'yue' WHEN regexp_matches({h}, 'zh|cmn|mandarin|chi|cn') THEN 'zh' WHEN {sql_cjk(text)} THEN 'zh' END"


def sql_lower(s: str) -> str:
    return f"translate({s}, '{T.UPPER}', '{T.LOWER}')"


def sql_fold(s: str, lang: str) -> str:
    f = f"translate({s}, '{T.VARIANTS[0]}', '{T.VARIANTS[1]}')"
    return f"CASE WHEN {lang} IN ('zh', 'yue') THEN regexp_replace({f}, '[{T.FILLERS}]+', '', 'g') ELSE {f} END"


def sql_strip(s: str, unicode: bool = True) -> str:
    out = f"translate({s}, {_lit(T.ASCII_PUNCTUATION)}, '')"
    return rf"regexp_replace({out}, '\p{{P}}', '', 'g')" if unicode else out


def sql_space(s: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate({s}, {_lit(T.ASCII_PUNCTUATION)}, repeat(' ', 32)), '\p{{P}}', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def sql_despace(s: str) -> str:
    # no look-ahead: twice, as a character may stand between two gaps
    one = lambda x: rf"regexp_replace({x}, '([{T.CJK_BMP}]){_WS}+([{T.CJK_BMP}])', '\1\2', 'g')"
    return one(one(s))


def sql_number(s: str) -> str:
    han = "translate({0}, '0123456789', '零一二三四五六七八九')"
    place = "(length(d) - i)"
    one = f"{han.format('substr(d, i, 1)')} || CASE WHEN substr(d, i, 1) = '0' THEN '' ELSE ['', '十', '百', '千'][CAST({place} % 4 AS INTEGER) + 1] END || CASE WHEN {place} % 4 = 0 THEN ['', '万', '亿', '兆'][CAST({place} // 4 AS INTEGER) + 1] ELSE '' END"
    raw = f"array_to_string(list_transform(range(1, length(d) + 1), lambda i: {one}), '')"
    for pattern, to in (("零+", "零"), ("零([万亿兆])", "\\1"), ("([亿兆])万", "\\1"), ("兆亿", "兆"), ("(.)零$", "\\1"), ("^一十", "十")):
        raw = f"regexp_replace({raw}, '{pattern}', '{to}', 'g')"
    whole = raw.replace("length(d)", "length(split_part(x, '.', 1))").replace("substr(d,", "substr(split_part(x, '.', 1),")
    # leading zeros are cut before, so that the positions count what is left
    said = f"{whole} || CASE WHEN split_part(x, '.', 2) <> '' THEN '点' || {han.format(chr(115) + 'plit_part(x, ' + chr(39) + '.' + chr(39) + ', 2)')} ELSE '' END"
    parts = f"regexp_extract_all(regexp_replace({s}, '([0-9]+(?:\\.[0-9]+)?)\\s*%', '百分之\\1', 'g'), '[0-9]+(?:\\.[0-9]+)?|[^0-9]+')"
    cut = f"list_transform({parts}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{1,16}}(\\.[0-9]+)?$') THEN regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END)"
    return f"array_to_string(list_transform({cut}, lambda x: CASE WHEN regexp_matches(x, '^[0-9]{{1,16}}(\\.[0-9]+)?$') THEN {said} ELSE x END), '')"


def sql_utterance(s: str, lang: str) -> str:
    return sql_lower(sql_fold(sql_number(s), lang))


def sql_cer_form(s: str, lang: str) -> str:
    t = f"trim(coalesce({s}, ''))"
    return f"CASE WHEN {lang} IS NOT NULL THEN {sql_despace(sql_strip(sql_utterance(t, lang)))} ELSE {sql_strip(f'lower({t})', False)} END"


def sql_edits(a: str, b: str) -> str:
    """Edit distance of two lists: every distinct element becomes one byte (fewer than 127)."""
    known = f"list_distinct(list_concat({a}, {b}))"
    enc = lambda x: f"array_to_string(list_transform({x}, lambda t: chr(CAST(list_position({known}, t) AS INTEGER))), '')"
    return f"levenshtein({enc(a)}, {enc(b)})"


_CHARS = "regexp_extract_all({0}, '(?s).')"
_RATE = "CASE WHEN len({a}) = 0 THEN CASE WHEN len({b}) = 0 THEN 0.0 ELSE 1.0 END ELSE {e} / len({a}) END"

_RESULTS = "(SELECT DISTINCT result_id, run_id, file, lang, source, reference, generated, first_token_latency_ms AS ftl, last_token_latency_ms AS ltl FROM evaluation_result)"


def results(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """result_id and ``columns`` of evaluation_result, repeated deliveries (which are equal) once."""
    t = table(spark, d, "evaluation_result").withColumnsRenamed({"first_token_latency_ms": "ftl", "last_token_latency_ms": "ltl"})
    return t.select("result_id", *columns).distinct()


_R = f"FROM (SELECT *, trim(coalesce(reference, '')) || trim(coalesce(generated, '')) AS both_texts FROM {_RESULTS})"
_SCORED = f"(SELECT *, regexp_extract_all(r, '(?s).') AS rc, regexp_extract_all(g, '(?s).') AS gc FROM (SELECT *, {sql_cer_form('reference', 'cl')} AS r, {sql_cer_form('generated', 'cl')} AS g FROM (SELECT *, {sql_language('lang', 'both_texts')} AS cl {_R})))"


@query(f"SELECT result_id, file, CAST(len(rc) AS INTEGER) AS ref_length, CAST(len(gc) AS INTEGER) AS gen_length, round({_RATE.format(a='rc', b='gc', e=sql_edits('rc', 'gc'))}, 9) AS cer FROM {_SCORED}")
def cer_by_file(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.per_file(results(spark, d, "file", "lang", "reference", "generated"))
    return r.select("result_id", "file", "ref_length", "gen_length", F.round("cer", 9).alias("cer"))


def sql_tokens(s: str, hint: str) -> str:
    t = f"trim(coalesce({s}, ''))"
    lang = sql_language(hint, t)
    norm = sql_space(f"CASE WHEN ({lang}) IS NOT NULL THEN {sql_utterance(t, f'({lang})')} ELSE lower({t}) END")
    mixed = r"regexp_extract_all({0}, '[\x21-\x7E]+|[^\x00-\x7F\p{{Z}}]')"
    return f"CASE WHEN {norm} = '' THEN [] WHEN coalesce({lang}, CASE WHEN {hint} IN ('zh', 'yue') THEN {hint} END) IS NOT NULL THEN {mixed.format(norm)} ELSE string_split({norm}, ' ') END"


@query(f"SELECT result_id, {sql_tokens('reference', 'lang')} AS tokens FROM {_RESULTS}")
def mer_tokens(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference", "lang").select("result_id", T.mixed_tokens(F.col("reference"), F.col("lang")).alias("tokens"))


@query(f"SELECT result_id, round({_RATE.format(a='a', b='b', e=sql_edits('a', 'b'))}, 9) AS mer FROM (SELECT result_id, {sql_tokens('reference', 'lang')} AS a, {sql_tokens('generated', 'lang')} AS b FROM {_RESULTS})")
def mer_by_file(spark: SparkSession, d: str) -> DataFrame:
    return M.with_mer(results(spark, d, "lang", "reference", "generated"), "reference", "generated", "lang").select("result_id", F.round("mer", 9).alias("mer"))


@query(f"SELECT source, count(*) AS files, round(avg(cer), 9) AS average_cer FROM (SELECT source, {_RATE.format(a='rc', b='gc', e=sql_edits('rc', 'gc'))} AS cer FROM {_SCORED}) GROUP BY source")
def cer_by_source(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.per_file(results(spark, d, "source", "lang", "reference", "generated"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("cer"), 9).alias("average_cer"))


_BASE = "list_last(string_split(audio_path, '/'))"
_STEM = r"regexp_replace(list_last(string_split({0}, '/')), '([^.])\.[^.]*$', '\1')"
_REFS = f"(SELECT file, arg_max(t, struct_pack(p := audio_path, t := t)) AS text FROM (SELECT audio_path, final_text AS t, unnest([{_BASE}, {_STEM.format('audio_path')}]) AS file FROM beam_history WHERE coalesce(final_text, '') <> '') GROUP BY file)"


@query(f"SELECT file, text FROM {_REFS}")
def load_references(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.references(table(spark, d, "beam_history"), "audio_path", "final_text")


_EVAL_JOIN = f"(SELECT r.file, s.cer FROM {_REFS} r LEFT JOIN (SELECT file, avg(cer) AS cer FROM evaluation_result WHERE cer IS NOT NULL GROUP BY file) s ON r.file = s.file)"


@query(f"SELECT count(*) AS total_files, count(cer) AS matched_files, count(*) - count(cer) AS unmatched_files, round(coalesce(avg(cer), 0), 9) AS average_cer FROM {_EVAL_JOIN}")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    refs = evaluate.references(table(spark, d, "beam_history"), "audio_path", "final_text")
    scored = table(spark, d, "evaluation_result").where("cer is not null").groupBy("file").agg(F.avg("cer").alias("cer"), F.avg("mer").alias("mer"))
    return evaluate.summary(refs, scored, "file").select("total_files", "matched_files", "unmatched_files", F.round("average_cer", 9).alias("average_cer"))


@query(f"SELECT result_id, {sql_cjk('reference')} AS has_cjk FROM {_RESULTS}")
def contains_cjk(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference").select("result_id", T.contains_cjk(F.col("reference")).alias("has_cjk"))


@query(f"SELECT result_id, {sql_language('lang', 'reference')} AS language FROM {_RESULTS}")
def resolve_language(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "lang", "reference").select("result_id", T.resolve_language(F.col("lang"), F.col("reference")).alias("language"))


@query(f"SELECT result_id, {sql_fold('reference', 'lang')} AS folded FROM {_RESULTS}")
def fold_variants(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "lang", "reference").select("result_id", T.fold_variants(F.col("reference"), F.col("lang")).alias("folded"))


@query(f"SELECT result_id, {sql_lower('reference')} AS lowered FROM {_RESULTS}")
def lower_ascii(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference").select("result_id", T.lower_ascii(F.col("reference")).alias("lowered"))


@query(f"SELECT result_id, {sql_strip('reference')} AS stripped FROM {_RESULTS}")
def strip_punct(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference").select("result_id", T.strip_punctuation(F.col("reference")).alias("stripped"))


@query(f"SELECT doc_id, {sql_space('text')} AS spaced FROM documents")
def punct_to_space(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.punctuation_to_space(F.col("text")).alias("spaced"))


@query(f"SELECT sample_id, {sql_despace('continuation_transcript')} AS despaced FROM (SELECT DISTINCT sample_id, continuation_transcript FROM data_synthesize)")
def cjk_despace(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "data_synthesize").select("sample_id", "continuation_transcript").distinct()
    return s.select("sample_id", T.despace_cjk(F.col("continuation_transcript")).alias("despaced"))


@query(f"SELECT result_id, {sql_number('reference')} AS numbered FROM {_RESULTS}")
def num_to_han(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference").select("result_id", T.number_to_han(F.col("reference")).alias("numbered"))


@query()
def canon_text(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference").select("result_id", T.canonical_text(F.col("reference")).alias("canonical"))


def sql_canon(s: str) -> str:
    return sql_lower(rf"regexp_replace(replace(regexp_replace({s}, '<\|[^|]*\|>', '', 'g'), chr(65533), ''), '[\s\x0B\x1c-\x1f\x85\p{{Z}}\p{{P}}]', '', 'g')")


_SAMPLES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) AS rn FROM data_synthesize) WHERE rn = 1)"


def samples(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    """sample_id and ``columns`` of data_synthesize, the first delivery of each sample; with ``where``
    (on columns that repeated deliveries have in common) of those samples only, before the
    deliveries meet."""
    s = table(spark, d, "data_synthesize")
    s = s if where is None else s.where(where)
    return s.groupBy("sample_id").agg(F.min_by(F.struct(*columns), "ingested_at").alias("s")).select("sample_id", "s.*")


@query(f"SELECT sample_id, list_filter(list_transform(list_slice(list_filter(k_best_candidates, lambda x: x IS NOT NULL), 1, 3), lambda x: {sql_canon('x')}), lambda x: x <> '') AS candidates FROM {_SAMPLES}")
def topk_clean(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d, "k_best_candidates").select("sample_id", T.clean_candidates(F.col("k_best_candidates"), 3).alias("candidates"))


@query("SELECT audio_path, i - 1 AS idx, CASE WHEN starts_with(h.topk[1], h.previous_transcript) THEN substr(h.topk[1], length(h.previous_transcript) + 1) ELSE h.topk[1] END AS added FROM (SELECT audio_path, history[i] AS h, i FROM (SELECT audio_path, history, unnest(range(1, len(history) + 1)) AS i FROM beam_history))")
def text_delta(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "beam_history").select("audio_path", F.posexplode("history").alias("idx", "h"))
    return h.select("audio_path", F.col("idx").cast("bigint").alias("idx"), T.text_delta(F.get(F.col("h.topk"), 0), F.col("h.previous_transcript")).alias("added"))


@query(f"SELECT sample_id, {_BASE} AS base, {_STEM.format('audio_path')} AS stem, split_part({_BASE}, '.', 1) AS first_stem FROM {_SAMPLES}")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("audio_path")
    return samples(spark, d, "audio_path").select("sample_id", T.base_name(p).alias("base"), T.stem(p).alias("stem"), T.stem(p, first_dot=True).alias("first_stem"))


@query(r"SELECT sample_id, audio_path FROM " + _SAMPLES + r" WHERE regexp_matches(lower(audio_path), '\.(wav|mp3|flac|m4a)$')")
def scan_filter_ext(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d, "audio_path", where=F.lower("audio_path").rlike(r"\.(wav|mp3|flac|m4a)$"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 100")
def sort_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(100)


@query("SELECT doc_id, CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGE_NAMES.items()) + " END AS language FROM documents")
def lang_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.language_name(F.col("lang")).alias("language"))


@query("SELECT audio_path, CAST(CASE WHEN duration < 2 THEN 16 WHEN duration < 5 THEN 8 ELSE 4 END AS INTEGER) AS block FROM beam_history")
def block_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "beam_history").select("audio_path", T.block_size(F.col("duration"), 16).alias("block"))


@query(f"SELECT sample_id, CASE WHEN len(c) > 0 THEN c END AS candidates FROM (SELECT sample_id, list_filter(list_transform(list_filter(k_best_candidates, lambda x: x IS NOT NULL), lambda x: regexp_replace(x, '\\x{{FFFD}}+$', '')), lambda x: NOT regexp_full_match(x, '{_WS}*')) AS c FROM {_SAMPLES})")
def display_candidates(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d, "k_best_candidates").select("sample_id", T.display_candidates(F.col("k_best_candidates")).alias("candidates"))


@query(f"SELECT result_id, {sql_canon('reference')} AS canonical FROM {_RESULTS}")
def canon_form(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference").select("result_id", T.canonical_text(F.col("reference"), nfkc=False).alias("canonical"))


# some characters of the traditional script, for a table of single characters
_SCRIPT = dict(zip("這個們來說時會對過還", "这个们来说时会对过还"))


@query(f"SELECT result_id, translate(reference, '{''.join(_SCRIPT)}', '{''.join(_SCRIPT.values())}') AS converted FROM {_RESULTS}")
def convert_script(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d, "reference").select("result_id", T.convert_script(F.col("reference"), _SCRIPT).alias("converted"))


# transcripts by file: of several the last by result
_LAST = "(SELECT file, arg_max(generated, result_id) AS text FROM evaluation_result WHERE generated IS NOT NULL AND file IS NOT NULL GROUP BY file)"
_MATCHED = f"(SELECT *, trim(reference) || trim(generated) AS both_texts FROM (SELECT r.file, r.text AS reference, g.text AS generated, CAST(NULL AS VARCHAR) AS lang FROM {_REFS} r JOIN {_LAST} g ON r.file = g.file))"
_MATCHED_SCORED = f"(SELECT file, CAST(len(r) AS INTEGER) AS ref_length, CAST(len(g) AS INTEGER) AS gen_length FROM (SELECT *, {sql_cer_form('reference', 'cl')} AS r, {sql_cer_form('generated', 'cl')} AS g FROM (SELECT *, {sql_language('lang', 'both_texts')} AS cl FROM {_MATCHED})))"


def _evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = evaluate.references(table(spark, d, "beam_history"), "audio_path", "final_text")
    e = table(spark, d, "evaluation_result").where("generated is not null and file is not null")
    return refs, e.groupBy("file").agg(F.max_by("generated", "result_id").alias("text"))


# the rates of such long texts are beyond the byte distance of SQL; cer_by_file and mer_by_file check them
@query(f"SELECT file, ref_length, gen_length FROM {_MATCHED_SCORED}")
def eval_matched(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_file(evaluate.matched(*_evaluated(spark, d))).select("file", "ref_length", "gen_length")


@query(f"SELECT (SELECT count(*) FROM {_REFS}) AS total_files, count(*) AS matched_files, (SELECT count(*) FROM {_REFS}) - count(*) AS unmatched_files, count(*) AS results, CAST(sum(ref_length) AS BIGINT) AS characters FROM {_MATCHED_SCORED}")
def eval_file(spark: SparkSession, d: str) -> DataFrame:
    e = evaluate.evaluation(*_evaluated(spark, d))
    characters = F.aggregate(F.transform("per_file_results", lambda x: x["ref_length"].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return e.select("total_files", "matched_files", "unmatched_files", F.size("per_file_results").cast("bigint").alias("results"), characters.alias("characters"))


@query("SELECT audio_path, CAST(i - 1 AS INTEGER) AS idx, printf('%.4f %.0f %.0f %s', coalesce(first_token_latency_ms, 0.0), (i - 1) * 250.0, (i - 1) * 250.0 + 250.0, coalesce(history[i].topk[1], '')) AS line FROM (SELECT *, unnest(range(1, len(history) + 1)) AS i FROM beam_history)")
def emission_line(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "beam_history").select("audio_path", F.coalesce("first_token_latency_ms", F.lit(0.0)).alias("ms"), F.posexplode("history").alias("idx", "h"))
    return h.select("audio_path", "idx", T.emission_line(F.col("ms"), F.col("idx") * 0.25, F.col("idx") * 0.25 + 0.25, F.coalesce(F.get("h.topk", 0), F.lit(""))).alias("line"))


@query("SELECT audio_path, CAST(i AS INTEGER) AS chunk, least((i + 1) * 2.0::DOUBLE, duration) AS end_s, i >= 2 AS keeps_prefix FROM (SELECT audio_path, duration, unnest(range(CAST(greatest(1, ceil(round(duration / 2.0::DOUBLE, 9))) AS BIGINT))) AS i FROM beam_history WHERE duration > 0)")
def redecode_steps(spark: SparkSession, d: str) -> DataFrame:
    return segment.redecoded(table(spark, d, "beam_history"), "audio_path", "duration")


# ---- synthesis, prompts, data sets ----
@query()
def align_prefix(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "beam_history").select("audio_path", "final_text", F.posexplode("history").alias("idx", "h"))
    return h.select("audio_path", "idx", M.align_prefix("h.previous_transcript", "final_text").alias("end_pos"))


@query()
def synth_samples(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.synthesize(table(spark, d, "beam_history"))


@query("SELECT h.audio_path, h.idx, h.end_time, round(h.end_time - lag(h.end_time, 1, 0.0::DOUBLE) OVER (PARTITION BY h.audio_path ORDER BY h.idx), 6) AS duration FROM (SELECT audio_path, CAST(i - 1 AS INTEGER) AS idx, coalesce(history[i].end_time, 0.0) AS end_time FROM (SELECT audio_path, history, unnest(range(1, len(history) + 1)) AS i FROM beam_history)) h")
def chunk_durations(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.histories(table(spark, d, "beam_history")).select("audio_path", "idx", "end_time", F.round("duration", 6).alias("duration"))


_EVAL_FILES = "(SELECT file, max(reference) AS reference FROM evaluation_result GROUP BY file)"


@query(f"SELECT h.audio_path, len(h.history) AS entries, e.reference, e.file IS NULL AS failed FROM beam_history h LEFT JOIN {_EVAL_FILES} e ON list_last(string_split(h.audio_path, '/')) = e.file")
def history_left_join(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "beam_history").withColumn("file", T.base_name(F.col("audio_path")))
    e = table(spark, d, "evaluation_result").groupBy("file").agg(F.max("reference").alias("reference"), F.lit(True).alias("found"))
    return h.join(e, "file", "left").select("audio_path", F.size("history").cast("bigint").alias("entries"), "reference", F.col("found").isNull().alias("failed"))


@query("SELECT DISTINCT audio_path FROM data_synthesize s WHERE audio_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM beam_history h WHERE list_last(string_split(h.audio_path, '/')) = list_last(string_split(s.audio_path, '/')))")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "data_synthesize").where("audio_path is not null").select("audio_path", T.base_name(F.col("audio_path")).alias("base")).distinct()
    done = table(spark, d, "beam_history").select(T.base_name(F.col("audio_path")).alias("base"))
    return dataset.unprocessed(s, done, "base").select("audio_path").distinct()


_NUMBERED = "array_to_string(list_transform(list_zip(c, range(1, len(c) + 1)), lambda z: '  ' || z[2] || '. ' || z[1]), chr(10))"
_QUOTED = "'\"' || coalesce(previous_transcript, '') || '\"'"
_PROMPT = f"{_lit(dataset.PROMPT_AUDIO[0])} || chr(10) || chr(10) || {_lit(dataset.PROMPT_AUDIO[1])} || {_QUOTED} || chr(10) || chr(10) || {_lit(dataset.PROMPT_AUDIO[2])} || chr(10) || {_NUMBERED} || chr(10) || chr(10) || {_lit(dataset.PROMPT_AUDIO[3])} || {_QUOTED} || '?'"
_PROMPTED = f"(SELECT sample_id, continuation_transcript, {_PROMPT} AS prompt FROM (SELECT *, list_filter(list_slice(k_best_candidates, 1, 4), lambda x: x IS NOT NULL) AS c FROM {_SAMPLES}))"


@query(f"SELECT sample_id, '<s>' || prompt || chr(10) || continuation_transcript || '</s>' AS example FROM {_PROMPTED}")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    p = dataset.prompt(F.col("k_best_candidates"), F.col("previous_transcript"), 4)
    return samples(spark, d, "k_best_candidates", "previous_transcript", "continuation_transcript").select("sample_id", dataset.wrapped(p, F.col("continuation_transcript")).alias("example"))


@query(f"SELECT sample_id, CAST(t AS INTEGER) AS turn, ['system', 'user', 'assistant'][t + 1] AS role, ['You correct transcripts.', prompt, continuation_transcript][t + 1] AS content FROM (SELECT *, unnest([0, 1, 2]) AS t FROM {_PROMPTED})")
def chat_render(spark: SparkSession, d: str) -> DataFrame:
    p = dataset.prompt(F.col("k_best_candidates"), F.col("previous_transcript"), 4)
    chat = dataset.chat("You correct transcripts.", p, F.col("continuation_transcript"))
    return samples(spark, d, "k_best_candidates", "previous_transcript", "continuation_transcript").select("sample_id", F.posexplode(chat).alias("turn", "m")).select("sample_id", "turn", "m.role", "m.content")


@query("SELECT config_id, entry_no, train_data_paths, CAST(unnest(range(1, greatest(coalesce(weight, 1), 1) + 1)) AS INTEGER) AS copy FROM training_qwen2audio")
def weighted_union(spark: SparkSession, d: str) -> DataFrame:
    return dataset.replicate(table(spark, d, "training_qwen2audio"), "weight").select("config_id", "entry_no", "train_data_paths", "copy")


@query("SELECT doc_id, source FROM documents ORDER BY md5('21-' || doc_id), doc_id LIMIT 200")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return dataset.sample(table(spark, d, "documents").select("doc_id", "source"), 200, 21, "doc_id")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS INTEGER) AS place FROM documents")
def hash_shuffle(spark: SparkSession, d: str) -> DataFrame:
    return dataset.hash_place(table(spark, d, "documents").select("doc_id", "source"), "source", 42, "doc_id").select("doc_id", "place")


@query("SELECT sample_id, CASE WHEN CAST('0x' || substr(md5('42-' || sample_id), 1, 8) AS BIGINT) < 429496729 THEN 'validation' ELSE 'train' END AS part FROM (SELECT DISTINCT sample_id FROM data_synthesize)")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return dataset.split(table(spark, d, "data_synthesize").select("sample_id").distinct(), 0.1, 42, "sample_id")


@query("SELECT audio_path, i AS idx, last_value(c IGNORE NULLS) OVER (PARTITION BY audio_path ORDER BY i ROWS UNBOUNDED PRECEDING) AS candidates FROM (SELECT audio_path, CAST(i - 1 AS INTEGER) AS i, CASE WHEN len(history[i].topk) > 0 THEN history[i].topk END AS c FROM (SELECT audio_path, history, unnest(range(1, len(history) + 1)) AS i FROM beam_history))")
def last_candidates(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "beam_history").select("audio_path", F.posexplode("history").alias("idx", "h")).withColumn("c", F.when(F.size("h.topk") > 0, F.col("h.topk")))
    return dataset.last_given(h, "audio_path", ["idx"], "c", "candidates").select("audio_path", "idx", "candidates")


@query("SELECT audio_path, CAST(i AS INTEGER) AS idx, coalesce(lag(c) OVER (PARTITION BY audio_path ORDER BY i), '') AS before FROM (SELECT audio_path, i - 1 AS i, history[i].topk[1] AS c FROM (SELECT audio_path, history, unnest(range(1, len(history) + 1)) AS i FROM beam_history))")
def previous_best(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "beam_history").select("audio_path", F.posexplode("history").alias("idx", "h")).select("audio_path", "idx", "h.topk")
    return dataset.previous_best(h, "audio_path", ["idx"], "topk", "before").select("audio_path", "idx", "before")


@query("SELECT doc_id, source FROM documents ORDER BY md5('7-' || doc_id), doc_id")
def shuffle_all(spark: SparkSession, d: str) -> DataFrame:
    return dataset.shuffled(table(spark, d, "documents").select("doc_id", "source"), 7, "doc_id")


@query("SELECT doc_id AS id, lang, source, CAST(NULL AS VARCHAR) AS split FROM documents UNION ALL SELECT item_id, lang, NULL, split FROM eval_items")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return dataset.union([docs, table(spark, d, "eval_items").select(F.col("item_id").alias("id"), "lang", "split")])


# ---- latencies ----
@query(f"SELECT run_id, count(*) AS files, round(avg(CASE WHEN ftl <> 0 AND NOT isnan(ftl) THEN ftl END), 6) AS average_first, round(avg(CASE WHEN ltl <> 0 AND NOT isnan(ltl) THEN ltl END), 6) AS average_last FROM {_RESULTS} GROUP BY run_id")
def latency_avg(spark: SparkSession, d: str) -> DataFrame:
    means = M.latency_means(results(spark, d, "run_id", "ftl", "ltl"), ["run_id"], "ftl", "ltl")
    return means.select("run_id", "files", *[F.round(c, 6).alias(c) for c in ("average_first", "average_last")])


@query(f"SELECT source, min(ftl) AS least, round(median(ftl), 6) AS median, max(ftl) AS greatest FROM {_RESULTS} WHERE NOT isnan(ftl) GROUP BY source")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.latency_spread(results(spark, d, "source", "ftl"), ["source"], "ftl").withColumn("median", F.round("median", 6))


@query(f"SELECT file, arg_min(ftl, result_id) AS first_ftl, arg_max(ltl, result_id) AS last_ltl FROM {_RESULTS} WHERE ftl IS NOT NULL AND ltl IS NOT NULL AND NOT isnan(ftl) AND NOT isnan(ltl) GROUP BY file")
def first_last_latency(spark: SparkSession, d: str) -> DataFrame:
    return M.first_and_last(results(spark, d, "file", "ftl", "ltl"), ["file"], "result_id", "ftl", "ltl").withColumnsRenamed({"first": "first_ftl", "last": "last_ltl"})


@query(f"SELECT h.audio_path, h.first_token_latency_ms, h.last_token_latency_ms, e.cer FROM beam_history h LEFT JOIN (SELECT file, round(avg(cer), 9) AS cer FROM (SELECT DISTINCT result_id, file, cer FROM evaluation_result) GROUP BY file) e ON list_last(string_split(h.audio_path, '/')) = e.file")
def metrics_latency(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "beam_history").withColumn("file", T.base_name(F.col("audio_path")))
    e = table(spark, d, "evaluation_result").select("result_id", "file", "cer").distinct().groupBy("file").agg(F.round(F.avg("cer"), 9).alias("cer"))
    return h.join(e, "file", "left").select("audio_path", "first_token_latency_ms", "last_token_latency_ms", "cer")


# ---- audio arrays ----
@query("SELECT vec_id, list_slice(embedding, 9, 24) AS pcm FROM embeddings")
def pcm_slice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", P.cut(F.col("embedding"), F.lit(0.0005), F.lit(0.0015)).alias("pcm"))


@query("SELECT vec_id, list_concat(list_slice(embedding, 1, n), list_transform(range(m - n), lambda x: 0::FLOAT)) AS pcm FROM (SELECT *, max(n) OVER (PARTITION BY label) AS m FROM (SELECT *, 16 + vec_id % 48 AS n FROM embeddings))")
def pcm_pad(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("cut", F.slice("embedding", F.lit(1), (16 + F.col("vec_id") % 48).cast("int")))
    longest = e.groupBy("label").agg(F.max(F.size("cut")).alias("n"))
    return e.join(longest, "label").select("vec_id", P.pad(F.col("cut"), F.col("n"), F.lit(0.0).cast("float")).alias("pcm"))


@query("SELECT vec_id, list_transform(range(1, 33), lambda i: round((embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2, 9)) AS pcm FROM embeddings")
def pcm_downmix(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    mixed = P.downmix(F.slice(e, 1, 32), F.slice(e, 33, 32))
    return table(spark, d, "embeddings").select("vec_id", F.transform(mixed, lambda x: F.round(x, 9)).alias("pcm"))


_AT = "embedding[CAST(least({0}, 63) AS INTEGER) + 1]::DOUBLE"
_LO = "CAST(floor(i * 64 / 96.0::DOUBLE) AS BIGINT)"


@query(f"SELECT vec_id, list_transform(range(96), lambda i: round({_AT.format(_LO)} + ({_AT.format(_LO + ' + 1')} - {_AT.format(_LO)}) * (i * 64 / 96.0::DOUBLE - {_LO}), 6)) AS pcm FROM embeddings")
def pcm_resample(spark: SparkSession, d: str) -> DataFrame:
    out = P.resample(F.col("embedding").cast("array<double>"), 16000, 24000)
    return table(spark, d, "embeddings").select("vec_id", F.transform(out, lambda x: F.round(x, 6)).alias("pcm"))


@query("SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN i < vec_id % 20 OR i >= 50 THEN -100 ELSE CAST(round(embedding[i + 1]::DOUBLE * 1000) AS INTEGER) END) AS labels FROM embeddings")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.transform("embedding", lambda x, i: F.when(i < 50, F.round(x.cast("double") * 1000).cast("int")))
    return table(spark, d, "embeddings").select("vec_id", P.label_mask(tokens, F.col("vec_id") % 20).alias("labels"))


@query("SELECT label, vec_id, CAST(sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gathered FROM embeddings")
def pcm_accum(spark: SparkSession, d: str) -> DataFrame:
    return segment.gathered(table(spark, d, "embeddings"), "label", ["vec_id"], "embedding").select("label", "vec_id", "gathered")


@query("SELECT vec_id, CAST(i // 16 AS INTEGER) AS frame, CAST(count(*) AS INTEGER) AS n, round(max(abs(x)), 6) AS peak FROM (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)) GROUP BY vec_id, i // 16")
def frame_512(spark: SparkSession, d: str) -> DataFrame:
    f = segment.frames(table(spark, d, "embeddings").withColumn("chunk", F.lit(0)), "vec_id", ["chunk"], "embedding", 16)
    peak = F.array_max(F.transform("pcm", lambda x: F.abs(x.cast("double"))))
    return f.select("vec_id", F.col("frame").cast("int").alias("frame"), F.size("pcm").alias("n"), F.round(peak, 6).alias("peak"))


# samples of a label run on from vector to vector
_RUN = "SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS place FROM (SELECT label, vec_id, i, embedding[i + 1] AS x FROM (SELECT label, vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"


@query(f"SELECT label, CAST(place // 48 AS BIGINT) AS frame, list(x ORDER BY place) AS pcm FROM ({_RUN}) GROUP BY label, place // 48 HAVING count(*) = 48")
def frame_carry(spark: SparkSession, d: str) -> DataFrame:
    return segment.frames(table(spark, d, "embeddings"), "label", ["vec_id"], "embedding", 48)


@query("SELECT vec_id // 8 AS part, flatten(list(embedding ORDER BY vec_id)) AS pcm FROM embeddings GROUP BY vec_id // 8")
def pcm_concat(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("part", F.expr("vec_id div 8"))
    return segment.accumulated(e, ["part"], ["vec_id"], "embedding")


@query("SELECT vec_id, list_concat(list_transform(range(n), lambda x: 1), list_transform(range(64 - n), lambda x: 0)) AS mask, n >= 40 AS enough FROM (SELECT vec_id, 16 + vec_id % 48 AS n FROM embeddings)")
def pcm_mask(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("cut", F.slice("embedding", F.lit(1), (16 + F.col("vec_id") % 48).cast("int")))
    return e.select("vec_id", P.attention_mask(F.col("cut"), F.lit(64)).alias("mask"), P.long_enough(F.col("cut"), 40).alias("enough"))


_TOKENS = "list_transform(list_slice(embedding, 1, n), lambda x: CAST(round(x::DOUBLE * 1000) AS INTEGER))"


@query(f"SELECT vec_id, list_concat(t, list_transform(range(m - n), lambda x: 0)) AS input_ids, list_concat(list_transform(t, lambda x: 1), list_transform(range(m - n), lambda x: 0)) AS attention_mask, list_concat(list_transform(range(3), lambda x: -100), list_slice(t, 4, n), list_transform(range(m - n), lambda x: -100)) AS labels FROM (SELECT *, {_TOKENS} AS t, max(n) OVER (PARTITION BY vec_id // 16) AS m FROM (SELECT *, 8 + vec_id % 13 AS n FROM embeddings))")
def collate_batch(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.transform(F.slice("embedding", F.lit(1), (8 + F.col("vec_id") % 13).cast("int")), lambda x: F.round(x.cast("double") * 1000).cast("int"))
    e = table(spark, d, "embeddings").select("vec_id", tokens.alias("tokens"), F.expr("vec_id div 16").alias("batch"), F.lit(3).alias("prompt"))
    return dataset.collate(e, "batch", "tokens", "prompt").select("vec_id", "input_ids", "attention_mask", "labels")


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 32), lambda i: CASE WHEN i % 5 = vec_id % 5 THEN 0 ELSE abs(embedding[i]::DOUBLE) END)) / list_sum(list_transform(range(1, 32), lambda i: CASE WHEN i % 5 = vec_id % 5 THEN 0 ELSE 1 END)), 9) AS loss FROM embeddings")
def masked_loss(spark: SparkSession, d: str) -> DataFrame:
    lp = F.transform(F.slice("embedding", 1, 31), lambda x: -F.abs(x.cast("double")))
    labels = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(i % 5 == F.col("vec_id") % 5, -100).otherwise(i))
    return table(spark, d, "embeddings").select("vec_id", F.round(M.masked_loss(lp, labels), 9).alias("loss"))


# ---- decoding ----
@query("SELECT vec_id, list_slice(toks, 1, greatest(0, len(toks) - k)) AS prefix FROM (SELECT vec_id, 1 + vec_id % 5 AS k, list_transform(list_slice(embedding, 1, 8), lambda x: CAST(round(x::DOUBLE * 1000) AS INTEGER)) AS toks FROM embeddings)")
def soft_prefix(spark: SparkSession, d: str) -> DataFrame:
    toks = F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double") * 1000).cast("int"))
    k = (1 + F.col("vec_id") % 5).cast("int")
    return table(spark, d, "embeddings").select("vec_id", P.drop_tail(toks, k).alias("prefix"))


_LPS = "SELECT vec_id, i AS p, -abs(embedding[i + 1]::DOUBLE) AS glp, -abs(embedding[i + 9]::DOUBLE) AS alp FROM (SELECT vec_id, embedding, unnest(range(8)) AS i FROM embeddings)"
_PATHS = f"SELECT vec_id, p, glp, alp, coalesce(sum(glp) OVER (PARTITION BY vec_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_LPS})"
_EXPANDED = f"SELECT vec_id, p AS ord, before + alp AS cum, p + 1 AS n FROM ({_PATHS}) UNION ALL SELECT vec_id, 99, sum(glp), 8 FROM ({_LPS}) GROUP BY vec_id"


@query(f"SELECT vec_id, CAST(rank AS INTEGER) AS rank, round(cum, 6) AS cum, CAST(n AS INTEGER) AS length FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cum / n DESC, ord) AS rank FROM ({_EXPANDED})) WHERE rank <= 4")
def beam_topk(spark: SparkSession, d: str) -> DataFrame:
    alt = lambda t, x: F.struct(t.cast("int").alias("token"), (-F.abs(x.cast("double"))).alias("lp"))
    pos = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((i + 1).cast("int").alias("greedy"), F.array(alt(i + 1, F.get("embedding", i)), alt(i + 101, F.get("embedding", i + 8))).alias("alts")))
    beams = table(spark, d, "embeddings").select("vec_id", F.lit(0).alias("beam"), F.lit(0.0).alias("cum"), F.array().cast("array<int>").alias("tokens"), pos.alias("positions"))
    return beam.expand(beams, "vec_id", [-1], 4).select("vec_id", "rank", F.round("cum", 6).alias("cum"), F.size("tokens").alias("length"))


# ---- segmentation ----
_FRAMES = "(SELECT user_id, least(value / 60, 1) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 512 AS cur FROM events)"
_GROUPS = f"(SELECT *, min(CASE WHEN p < 0.7::DOUBLE - 0.15::DOUBLE THEN cur END) OVER (PARTITION BY user_id, grp) AS te FROM (SELECT *, sum(CASE WHEN p >= 0.7::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY cur) AS grp FROM {_FRAMES}))"
_CLOSED = f"(SELECT user_id, grp, min(cur) AS begun, min(te) AS te, max(CASE WHEN p < 0.7::DOUBLE - 0.15::DOUBLE AND cur - te >= 1024 THEN 1 ELSE 0 END) AS closed FROM {_GROUPS} WHERE grp > 0 GROUP BY user_id, grp)"
_OPENED = f"(SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY grp) AS seq FROM (SELECT *, CASE WHEN coalesce(lag(closed) OVER (PARTITION BY user_id ORDER BY grp), 1) = 1 THEN 1 ELSE 0 END AS opens FROM {_CLOSED}))"
_SEGMENTS = f"SELECT user_id, CAST(seq AS BIGINT) AS seq, CAST(greatest(0, min(begun) - 2112) AS BIGINT) AS start_sample, CAST(max(CASE WHEN closed = 1 THEN te + 1088 END) AS BIGINT) AS end_sample FROM {_OPENED} GROUP BY user_id, seq"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.least(F.col("value") / 60, F.lit(1.0)))
    return segment.speech_segments(e, "user_id", ["ts", "event_id"], min_silence=1024)


@query(_SEGMENTS)
def vad_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


@query(f"SELECT user_id, count(*) AS segments, CAST(sum(end_sample - start_sample) AS BIGINT) AS samples FROM ({_SEGMENTS}) WHERE end_sample - start_sample >= 4000 GROUP BY user_id")
def segment_gate(spark: SparkSession, d: str) -> DataFrame:
    s = segment.speech_only(_segments(spark, d))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("end_sample") - F.col("start_sample")).alias("samples"))


_CALLS = "(SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS call, event_id, CASE WHEN value >= 42 THEN 'start' ELSE 'end' END AS kind FROM events)"


@query(f"SELECT user_id, call, CASE WHEN arg_min(kind, event_id) = 'start' THEN min(event_id) END AS start, CASE WHEN arg_max(kind, event_id) = 'end' THEN max(event_id) END AS \"end\" FROM {_CALLS} GROUP BY user_id, call")
def vad_merge(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.floor((F.row_number().over(w) - 1) / 4).alias("call"), F.when(F.col("value") >= 42, "start").otherwise("end").alias("kind"))
    return segment.merge_events(e.withColumn("sample", F.col("event_id")), ["user_id", "call"], "event_id", "kind", "sample")


_CALLED = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chunk, CAST(floor(value * 100) AS BIGINT) AS n FROM events"
_WAITING = f"WITH RECURSIVE called AS ({_CALLED}), run AS (SELECT user_id, chunk, n AS waiting FROM called WHERE chunk = 0 UNION ALL SELECT c.user_id, c.chunk, CASE WHEN r.waiting > 8000 THEN 0 ELSE r.waiting END + c.n FROM run r JOIN called c ON c.user_id = r.user_id AND c.chunk = r.chunk + 1) SELECT * FROM run"


@query(f"SELECT user_id, chunk, CAST(waiting AS BIGINT) AS waiting FROM ({_WAITING}) WHERE waiting > 8000")
def trigger_cadence(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") * 100).alias("n"))
    return segment.trigger_cadence(e, "user_id", ["ts", "event_id"], "n", 8000)


@query()
def vac_route(spark: SparkSession, d: str) -> DataFrame:
    """What goes to a recognizer of streams whose calls have 512 samples and the segments that the
    detector finds in them."""
    seg = _segments(spark, d)
    call = lambda c: F.floor((F.col(c) + FRAME - 1) / FRAME)
    events = seg.select("user_id", call("start_sample").alias("seq_no"), F.col("start_sample").alias("start"), F.lit(None).cast("bigint").alias("end"))
    events = events.unionByName(seg.where("end_sample is not null").select("user_id", call("end_sample").alias("seq_no"), F.lit(None).cast("bigint").alias("start"), F.col("end_sample").alias("end")))
    merged = events.groupBy("user_id", "seq_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    calls = table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("seq_no"), F.lit(FRAME).cast("bigint").alias("samples"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    c = calls.join(merged, ["user_id", "seq_no"], "left").withColumn("key", F.col("user_id").cast("string"))
    return router.routed_table(c, router.Limits(keep=2048, infer_above=4096))


@query("SELECT user_id, event_id, CASE WHEN g < 16000 THEN 'wait' WHEN g - c < 16000 THEN 'first' ELSE 'next' END AS gate FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS c FROM events))")
def initial_buffer_gate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("c", F.floor(F.col("value") * 100))
    return segment.initial_buffer(e, "user_id", ["ts", "event_id"], "c").select("user_id", "event_id", "gate")


@query("SELECT audio_path, CAST(i AS INTEGER) AS chunk, i * 0.5::DOUBLE AS begin_s, least((i + 1) * 0.5::DOUBLE, duration) AS end_s FROM (SELECT audio_path, duration, unnest(range(CAST(greatest(1, ceil(round(duration / 0.5::DOUBLE, 9))) AS BIGINT))) AS i FROM beam_history WHERE duration > 0)")
def tumbling_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.chunks(table(spark, d, "beam_history"), "audio_path", "duration", 0.5)


_GAPS = "(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events)"


@query(f"SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM {_GAPS}) GROUP BY user_id, s")
def session_gap(spark: SparkSession, d: str) -> DataFrame:
    return segment.sessions(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS said FROM events GROUP BY user_id")
def session_concat(spark: SparkSession, d: str) -> DataFrame:
    return segment.joined_text(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def parse_props_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
