"""One consistent form for texts that look the same.

A text is exploded to positioned pieces: single code points, and runs of code points that
are surely in their final form already (kept whole, so that ordinary text costs one row).
Broadcast tables give compatibility and canonical decompositions, spaces, invisible
characters and look-alike letters; combining marks are ordered by their class within a
sequence, recomposed, and the strings rebuilt.
"""

from __future__ import annotations

import json
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.session import store

# Letters that look like a Latin letter, by script.
CYRILLIC_LOOKALIKES = dict(zip("аеорсухѕіјԁԛԝһӏАВЕКМНОРСТУХЅІЈԌԚԜ", "aeopcyxsijdqwhlABEKMHOPCTYXSIJGQW"))
GREEK_LOOKALIKES = dict(zip("αγικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ayikvoptuxABEZHIKMNOPTYX"))
LATIN_TO_CYRILLIC = dict(zip("aeopcyxkmtbhsijAEOPCYXKMTBHSIJ", "аеорсухкмтьнѕіјАЕОРСУХКМТВНЅІЈ"))
LATIN_TO_GREEK = dict(zip("aoviptuxkyAOINPTXKMZEBHY", "αονιρτυχκγΑΟΙΝΡΤΧΚΜΖΕΒΗΥ"))
CYRILLIC_TO_GREEK = {"о": "ο", "О": "Ο", "а": "α", "А": "Α", "р": "ρ", "Р": "Ρ", "Т": "Τ", "т": "τ", "х": "χ", "Х": "Χ", "к": "κ", "К": "Κ", "Е": "Ε", "М": "Μ", "Н": "Η", "В": "Β", "у": "γ", "і": "ι", "І": "Ι"}
GREEK_TO_CYRILLIC = {"ο": "о", "Ο": "О", "α": "а", "Α": "А", "ρ": "р", "Ρ": "Р", "Τ": "Т", "τ": "т", "χ": "х", "Χ": "Х", "κ": "к", "Κ": "К", "Ε": "Е", "Μ": "М", "Η": "Н", "Β": "В", "Υ": "У", "υ": "и", "ν": "у", "ι": "і", "Ι": "І"}

# Characters that keep their form, as the inside of a character class, by home script.
_NEUTRAL = r"\t\n\r\x20-\x40\x5B-\x60\x7B-\x7E«»¡¿·–—‘’“”"
_HAN = r"、。《-』㐀-䶿一-鿿"
_LATIN = _NEUTRAL + r"A-Za-zÀ-ÖØ-öø-ÿ" + _HAN
PLAIN = {
    "latin": _LATIN,
    "han": _LATIN + "，？！",  # ordinary marks of Chinese text
    "cyrillic": _NEUTRAL + "А-яЁё" + _HAN,
    "greek": _NEUTRAL + r"ΆΈ-ΊΌΎ-ΡΣ-ώ" + _HAN,
}
HAN_LANGS = ("zh", "yue", "cmn", "wuu", "nan", "hak", "lzh")


def home_script(text: Column, lang: Column) -> Column:
    """latin, han, cyrillic or greek: by the language hint (regional codes and case don't
    matter), and where that is null or blank by the letters of the text."""

    def count(cls: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{cls}]", ""))

    code = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)", 1)
    cyr, gre, lat, han = count(r"Ѐ-ӿ"), count(r"Ͱ-Ͽ"), count("A-Za-zÀ-ÖØ-öø-ÿ"), count(r"㐀-䶿一-鿿豈-﫿")
    return (
        F.when(code.isin("ru", "uk", "be", "bg", "sr", "mk"), "cyrillic")
        .when(code == "el", "greek")
        .when(code.isin(*HAN_LANGS), "han")
        .when(F.coalesce(code, F.lit("")) != "", "latin")
        .when(han > 0, "han")
        .when((cyr > lat) & (cyr >= gre), "cyrillic")
        .when(gre > lat, "greek")
        .otherwise("latin")
    )


def forms(spark: SparkSession) -> DataFrame:
    """(ch, to): full compatibility decompositions, spaces as U+0020, invisible characters as
    nothing. Bounded by Unicode (some 6,000 rows); Hangul syllables stay composed."""
    rows = []
    for cp in range(sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Zs", "Zl", "Zp"):
            to = " "
        elif kind == "Cf" or kind == "Cc" and ch not in "\t\n\r" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0):
            to = ""
        else:
            to = unicodedata.normalize("NFKD", ch)
        if to != ch:
            rows.append((ch, to))
    return spark.createDataFrame(rows, "ch string, to string")


def classes(spark: SparkSession) -> DataFrame:
    """(ch, ccc): combining marks and their canonical class (fewer than 1,000 rows)."""
    rows = [(chr(cp), c) for cp in range(sys.maxunicode + 1) if (c := unicodedata.combining(chr(cp)))]
    return spark.createDataFrame(rows, "ch string, ccc int")


def letters(spark: SparkSession) -> DataFrame:
    """(ch, home, letter): the letter of the home script that a foreign letter looks like."""
    rows = [(a, home, b) for home in ("latin", "han") for t in (CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES) for a, b in t.items()]
    rows += [(a, "cyrillic", b) for t in (LATIN_TO_CYRILLIC, GREEK_TO_CYRILLIC) for a, b in t.items()]
    rows += [(a, "greek", b) for t in (LATIN_TO_GREEK, CYRILLIC_TO_GREEK) for a, b in t.items()]
    return spark.createDataFrame(rows, "ch string, home string, letter string")


def compositions() -> Column:
    """map of base + mark -> composed character, as one literal."""
    pairs = {}
    for cp in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(cp)).split()
        if len(d) == 2 and not d[0].startswith("<"):
            two = "".join(chr(int(x, 16)) for x in d)
            if unicodedata.normalize("NFC", two) == chr(cp):
                pairs[two] = chr(cp)
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _recomposed(items: Column) -> Column:
    """The string of one combining sequence: items are struct<ccc, .., s>, starter first, in
    class order. A mark joins the base unless one of its own class stands between them."""
    table = compositions()
    start = F.struct(F.lit("").alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        made = F.element_at(table, F.concat(acc["base"], x["s"]))
        joins = made.isNotNull() & (x["ccc"] > acc["last"])
        return (
            F.when(x["ccc"] == 0, F.struct(F.concat(acc["base"], x["s"]).alias("base"), acc["rest"].alias("rest"), F.lit(0).alias("last")))
            .when(joins, F.struct(made.alias("base"), acc["rest"].alias("rest"), acc["last"].alias("last")))
            .otherwise(F.struct(acc["base"].alias("base"), F.concat(acc["rest"], x["s"]).alias("rest"), x["ccc"].alias("last")))
        )

    return F.aggregate(items, start, step, lambda a: F.concat(a["base"], a["rest"]))


def _pieces(text: Column, home: Column) -> Column:
    out = None
    for name, cls in PLAIN.items():
        # a run leaves its last character to a mark that follows it
        found = F.regexp_extract_all(text, F.lit(rf"(?s)([{cls}]+(?!\p{{M}})|.)"), F.lit(1))
        out = F.when(home == name, found) if out is None else out.when(home == name, found)
    return out


def _doubtful(text: Column, home: Column) -> Column:
    out = F.lit(False)
    for name, cls in PLAIN.items():
        out = F.when(home == name, text.rlike(rf"[^{cls}]")).otherwise(out)
    return out


def canonical_texts(texts: DataFrame) -> DataFrame:
    """(h1, h2, canonical) for the distinct rows of ``texts`` (text, home, h1, h2)."""
    spark = texts.sparkSession
    key = ["h1", "h2"]
    one = texts.groupBy(*key).agg(F.min("text").alias("text"), F.min("home").alias("home"))
    cut = one.select(*key, "home", F.posexplode(_pieces(F.col("text"), F.col("home"))).alias("pos", "ch"))
    # decomposition, then look-alikes on what the decomposition holds
    cut = cut.join(F.broadcast(forms(spark)), "ch", "left")
    cut = cut.select(*key, "home", "pos", F.posexplode(F.when(F.col("to").isNull(), F.array("ch")).otherwise(F.split("to", ""))).alias("k", "ch"))
    cut = cut.join(F.broadcast(letters(spark)), ["ch", "home"], "left").select(*key, "pos", "k", F.coalesce("letter", "ch").alias("s"))
    marks = classes(spark).withColumnRenamed("ch", "s")
    cut = cut.join(F.broadcast(marks), "s", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    order = Window.partitionBy(*key).orderBy("pos", "k")
    cut = cut.withColumn("seq", F.sum((F.col("ccc") == 0).cast("int")).over(order))
    items = F.sort_array(F.collect_list(F.struct("ccc", "pos", "k", "s")))
    # only sequences with a mark are put together by class; the others are one item
    put = cut.groupBy(*key, "seq").agg(items.alias("items"))
    put = put.select(*key, "seq", F.when(F.size("items") == 1, F.col("items")[0]["s"]).otherwise(_recomposed(F.col("items"))).alias("s"))
    whole = put.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("seq", "s"))).alias("all"))
    return whole.select(*key, F.array_join(F.transform("all", lambda x: x["s"]), "").alias("canonical"))


def canonicalize(df: DataFrame, text_col: str, lang_col: str | None = None, out_col: str = "canonical") -> DataFrame:
    """``df`` with ``out_col``: the text in one consistent form.

    Compatibility and width variants, ligatures and CJK compatibility characters become
    what they stand for, unusual spaces a space; invisible characters go; letters and
    their accents are composed; letters of a script foreign to the value's language become
    the letters they look like (a foreign letter like none is kept). The marks U+FF0C,
    U+FF1F and U+FF01 stay in Chinese text. Case and everything else is unchanged. Null
    stays null and empty stays empty; repeated rows come out as often as they came in.
    Conjoining Hangul jamo aren't composed. ``out_col`` must be a new name.
    """
    if out_col in df.columns:
        raise ValueError(f"the table has a column {out_col}")
    text = F.col(text_col)
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    home = home_script(text, lang)
    df = df.withColumn("_home", home).withColumn("_odd", F.coalesce(_doubtful(text, F.col("_home")), F.lit(False)))
    done = df.where(~F.col("_odd")).withColumn(out_col, text).drop("_home", "_odd")
    odd = df.where("_odd").withColumn("_h1", F.xxhash64(text, F.col("_home"))).withColumn("_h2", F.xxhash64(F.lit(7), text, F.col("_home")))
    # the texts that can change are told once, and used twice
    odd, _ = store(odd, "changeable")
    formed = canonical_texts(odd.select(text.alias("text"), F.col("_home").alias("home"), F.col("_h1").alias("h1"), F.col("_h2").alias("h2")))
    formed = formed.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("canonical", F.lit("")).alias(out_col))
    odd = odd.join(formed, ["_h1", "_h2"], "left").withColumn(out_col, F.coalesce(out_col, F.lit("")))
    return done.unionByName(odd.drop("_h1", "_h2", "_home", "_odd"))
