"""Scoring generated transcripts against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.functions import metrics as M
from utterlake.functions import text as T


def references(df: DataFrame, path: str, text: str) -> DataFrame:
    """(file, text): each non-empty text under its file name and under the name without
    extension; of texts with the same key the last by path stands."""
    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "").select(F.col(path).alias("_p"), F.col(text).alias("_t"), F.explode(F.array(T.base_name(F.col(path)), T.stem(F.col(path)))).alias("file"))
    return rows.groupBy("file").agg(F.max_by("_t", F.struct("_p", "_t")).alias("text"))


def per_file(df: DataFrame, reference: str = "reference", generated: str = "generated", hint: str = "lang") -> DataFrame:
    """``df`` with cer, mer, ref_length and gen_length; null texts count as empty."""
    both = F.concat(F.trim(F.coalesce(F.col(reference), F.lit(""))), F.trim(F.coalesce(F.col(generated), F.lit(""))))
    d = df.withColumn("_lang", T.resolve_language(F.col(hint), both))
    d = d.withColumn("_r", T.cer_form(F.col(reference), F.col("_lang"))).withColumn("_g", T.cer_form(F.col(generated), F.col("_lang")))
    d = d.withColumns({"cer": M.rate(F.col("_r"), F.col("_g")), "ref_length": F.length("_r"), "gen_length": F.length("_g")})
    return M.with_mer(d, reference, generated, hint).drop("_lang", "_r", "_g")


def _summed(refs: DataFrame, scored: DataFrame, key: str, result: Column | None = None) -> DataFrame:
    more = [] if result is None else [result.alias("_one")]
    j = refs.select(key).join(scored.select(key, "cer", "mer", F.lit(1).alias("_m"), *more), key, "left")
    each = [] if result is None else [F.sort_array(F.collect_list("_one")).alias("per_file_results")]
    return j.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count("_m").alias("matched_files"),
        (F.count(F.lit(1)) - F.count("_m")).alias("unmatched_files"),
        F.coalesce(F.avg("cer"), F.lit(0.0)).alias("average_cer"),
        F.coalesce(F.avg("mer"), F.lit(0.0)).alias("average_mer"),
        *each,
    )


def summary(refs: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """One row: total, matched and unmatched references, mean cer and mer (0 without matches)."""
    return _summed(refs, scored, key)


def matched(refs: DataFrame, generated: DataFrame, language: str | None = None) -> DataFrame:
    """(file, reference, generated, lang) of the keys (file, text) that both sides have."""
    r, g = refs.select("file", F.col("text").alias("reference")), generated.select("file", F.col("text").alias("generated"))
    return r.join(g, "file").withColumn("lang", F.lit(language).cast("string"))


def displayed(scored: DataFrame) -> DataFrame:
    """``scored`` (reference, generated, lang) with both texts in the form that the character rate
    compares."""
    both = F.concat(F.coalesce("reference", F.lit("")), F.coalesce("generated", F.lit("")))
    d = scored.withColumn("_lang", T.resolve_language(F.col("lang"), both))
    return d.withColumns({c: T.cer_form(F.col(c), F.col("_lang")) for c in ("reference", "generated")}).drop("_lang")


def evaluation(refs: DataFrame, generated: DataFrame, language: str | None = None) -> DataFrame:
    """One row: counts, mean rates and per_file_results (file, reference, generated, cer, mer,
    ref_length, gen_length; texts as compared) of references and transcripts (file, text).
    References that nothing matches are counted; the results are one array by file, as the file
    format asks, so this is for evaluation sets; :func:`per_file` of :func:`matched` is the same
    without that bound."""
    scored = displayed(per_file(matched(refs, generated, language)))
    one = F.struct("file", "reference", "generated", "cer", "mer", "ref_length", "gen_length")
    return _summed(refs, scored, "file", one)
