"""Text functions of transcript evaluation as column expressions (all JVM-side)."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Code point ranges that count as Chinese characters.
CJK_RANGES = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF)]
# The part of them within the basic plane, between which spaces are removed.
CJK_BMP = r"㐀-䶿一-鿿豈-﫿"
# ASCII punctuation with its symbols; variants folded; fillers of speech.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
VARIANTS = ("两兩俩萬億幺", "二二二万亿一")
FILLERS = "啊嗯吧呀呃哦哎嘛呢啦嘞"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Names of language codes.
LANGUAGE_NAMES = {
    "yue": "Cantonese", "zh": "Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "de": "German",
    "fr": "French", "es": "Spanish", "pt": "Portuguese", "ru": "Russian", "ar": "Arabic", "hi": "Hindi",
    "id": "Indonesian", "it": "Italian", "th": "Thai", "vi": "Vietnamese", "tr": "Turkish", "ms": "Malay",
}
#: Punctuation of newer Unicode versions that the JVM's \p{P} does not know.
NEWER_PUNCTUATION = "؝᭽᭾⹓-⹝"
SPACE = r"(?U)[\s\x1c-\x1f]"


def _java_class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def contains_cjk(s: Column) -> Column:
    """Whether any Chinese character occurs; false for null."""
    return F.coalesce(s.rlike(_java_class(CJK_RANGES)), F.lit(False))


def resolve_language(hint: Column, text: Column) -> Column:
    """yue, zh or null: by the hint (yue wins over zh in mixed codes), then by the text. An empty
    or null text has no language."""
    h = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None))
        .when(h.isin("yue", "zh"), h)
        .when(h.rlike("yue|canton|hongkong|hk"), "yue")
        .when(h.rlike("zh|cmn|mandarin|chi|cn"), "zh")
        .when(contains_cjk(text), "zh")
    )


def lower_ascii(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def fold_variants(s: Column, lang: Column) -> Column:
    """Numeral variants folded; fillers removed where ``lang`` is zh or yue."""
    folded = F.translate(s, *VARIANTS)
    return F.when(lang.isin("zh", "yue"), F.regexp_replace(folded, f"[{FILLERS}]+", "")).otherwise(folded)


def strip_punctuation(s: Column, unicode: bool = True) -> Column:
    out = F.translate(s, ASCII_PUNCTUATION, "")
    return F.regexp_replace(out, rf"[\p{{P}}{NEWER_PUNCTUATION}]", "") if unicode else out


def punctuation_to_space(s: Column) -> Column:
    """Punctuation becomes a space, runs of white space one space, ends are trimmed."""
    out = F.regexp_replace(F.translate(s, ASCII_PUNCTUATION, " " * 32), rf"[\p{{P}}{NEWER_PUNCTUATION}]", " ")
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


def despace_cjk(s: Column) -> Column:
    """White space between two Chinese characters of the basic plane is removed."""
    return F.regexp_replace(s, rf"(?U)([{CJK_BMP}])[\s\x1c-\x1f]+(?=[{CJK_BMP}])", "$1")


def _integer_numeral(d: Column) -> Column:
    """The Chinese numeral of a string of 1 to 16 ASCII digits."""
    digits = F.regexp_replace(d, "^0+(?=.)", "")
    n = F.length(digits)
    small, big = F.array(*[F.lit(x) for x in ("", "十", "百", "千")]), F.array(*[F.lit(x) for x in ("", "万", "亿", "兆")])

    def one(i: Column) -> Column:
        place = n - i  # places that follow
        name = F.translate(F.substring(digits, i, 1), "0123456789", "零一二三四五六七八九")
        unit = F.element_at(small, (place % 4 + 1).cast("int"))
        group = F.when(place % 4 == 0, F.element_at(big, F.floor(place / 4).cast("int") + 1)).otherwise("")
        return F.concat(name, F.when(name == "零", "").otherwise(unit), group)

    raw = F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")
    for pattern, to in (("零+", "零"), ("零([万亿兆])", "$1"), ("([亿兆])万", "$1"), ("兆亿", "兆"), ("(.)零$", "$1"), ("^一十", "十")):
        raw = F.regexp_replace(raw, pattern, to)
    return raw


def number_to_han(s: Column) -> Column:
    """Numbers in ASCII digits become Chinese numerals, percentages 百分之 with one. A number of
    more than 16 digits before the point is kept as it is."""
    s = F.regexp_replace(s, r"([0-9]+(?:\.[0-9]+)?)\s*%", "百分之$1")
    parts = F.regexp_extract_all(s, F.lit(r"([0-9]+(?:\.[0-9]+)?|[^0-9]+)"), F.lit(1))

    def one(x: Column) -> Column:
        whole, rest = F.split_part(x, F.lit("."), F.lit(1)), F.split_part(x, F.lit("."), F.lit(2))
        said = F.concat(_integer_numeral(whole), F.when(rest != "", F.concat(F.lit("点"), F.translate(rest, "0123456789", "零一二三四五六七八九"))).otherwise(""))
        return F.when(x.rlike(r"^[0-9]{1,16}(\.[0-9]+)?$"), said).otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def normalize_utterance(s: Column, lang: Column, scripts: Mapping[str, Mapping[str, str]] | None = None) -> Column:
    """Conversion between Chinese scripts by the table of ``scripts`` for zh or yue (see
    :func:`convert_script`; none: unchanged), numerals, variants, fillers and ASCII case, in
    this order."""
    for code, table in (scripts or {}).items():
        s = F.when(lang == code, convert_script(s, table)).otherwise(s)
    return lower_ascii(fold_variants(number_to_han(s), lang))


def cer_form(s: Column, lang: Column) -> Column:
    """What the character error rate compares; ``lang`` as resolved for both texts together."""
    t = F.trim(F.coalesce(s, F.lit("")))
    chinese = despace_cjk(strip_punctuation(normalize_utterance(t, lang)))
    return F.when(lang.isNotNull(), chinese).otherwise(strip_punctuation(F.lower(t), unicode=False))


def mixed_tokens(s: Column, hint: Column) -> Column:
    """Tokens of the mixed error rate: in zh and yue each character outside ASCII and each run
    inside it, else words. Null and blank texts have none."""
    t = F.trim(F.coalesce(s, F.lit("")))
    lang = resolve_language(hint, t)
    norm = punctuation_to_space(F.when(lang.isNotNull(), normalize_utterance(t, lang)).otherwise(F.lower(t)))
    by_rule = F.coalesce(lang, F.when(hint.isin("zh", "yue"), hint)).isNotNull()
    mixed = F.regexp_extract_all(norm, F.lit(r"(?U)([\x00-\x7F&&[^\s\x1c-\x1f]]+|[^\x00-\x7F\s])"), F.lit(1))
    return F.when(norm == "", F.array().cast("array<string>")).when(by_rule, mixed).otherwise(F.split(norm, " "))


@pandas_udf(StringType())
def _nfkc(s):  # the JVM has no expression for it
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def canonical_text(s: Column, nfkc: bool = True) -> Column:
    """Marks <|..|> and U+FFFD removed, NFKC, no white space and punctuation, ASCII lower case."""
    t = F.regexp_replace(F.regexp_replace(s, r"<\|[^|]*\|>", ""), "�", "")
    t = _nfkc(t) if nfkc else t
    return lower_ascii(F.regexp_replace(t, rf"(?U)[\s\x1c-\x1f\p{{P}}{NEWER_PUNCTUATION}]", ""))


def clean_candidates(c: Column, most: int) -> Column:
    """The first ``most`` candidates in canonical form (without NFKC), empty ones dropped after;
    trailing U+FFFD goes too. Null gives null."""
    return F.filter(F.transform(F.slice(F.filter(c, lambda x: x.isNotNull()), 1, most), lambda x: canonical_text(x, nfkc=False)), lambda x: x != "")


def display_candidates(c: Column) -> Column:
    """Candidates without the U+FFFD at their ends, blank and null ones dropped; null if none is left."""
    kept = F.filter(F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, "\ufffd+$", "")), lambda x: ~x.rlike(r"(?U)^[\s\x1c-\x1f]*$"))
    return F.when(F.size(kept) > 0, kept)


@pandas_udf(StringType())
def _after_common(full: pd.Series, prefix: pd.Series) -> pd.Series:
    """What follows the longest block that both have in common; all where there is none."""

    def one(f: str | None, p: str | None) -> str | None:
        if f is None or p is None:
            return None
        m = difflib.SequenceMatcher(None, p, f).find_longest_match()
        return f[m.b + m.size :] if m.size else f

    return pd.Series([one(f, p) for f, p in zip(full, prefix)], dtype=object)


def text_delta(full: Column, prefix: Column, common: bool = False) -> Column:
    """What ``full`` adds to ``prefix``. Where it does not begin with it, all of ``full``, or with
    ``common`` what follows the longest block that both have in common."""
    begins = F.startswith(full, prefix)
    # texts that begin with the prefix are not sent to Python
    other = _after_common(F.when(begins, F.lit(None)).otherwise(full), F.when(begins, F.lit(None)).otherwise(prefix)) if common else full
    return F.when(begins, F.substring(full, F.length(prefix) + 1, F.length(full))).otherwise(other)


def convert_script(s: Column, table: Mapping[str, str] | None = None) -> Column:
    """``s`` with the phrases of ``table`` replaced, the longest first from left to right; unchanged
    without a table. Tables of single characters stay in the JVM; one of phrases goes to the
    tasks, so it should be a dictionary and not data."""
    if not table:
        return s
    if all(len(k) == 1 and len(v) == 1 for k, v in table.items()):
        return F.translate(s, "".join(table), "".join(table.values()))
    phrase = re.compile("|".join(map(re.escape, sorted((k for k in table if k), key=len, reverse=True))))
    table = dict(table)

    @pandas_udf(StringType())
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None else phrase.sub(lambda m: table[m.group()], t))

    return convert(s)


def emission_line(ms: Column, start: Column, end: Column, text: Column) -> Column:
    """What a live recognizer prints: milliseconds since its start, begin and end (seconds) of the
    segment in milliseconds, text."""
    return F.format_string("%.4f %.0f %.0f %s", ms.cast("double"), start.cast("double") * 1000, end.cast("double") * 1000, text)


def packet_line(packet: Column) -> Column:
    """The first line of a packet of bytes, up to its first NUL; bytes that are no UTF-8 become
    U+FFFD."""
    text = F.make_valid_utf8(packet.cast("string"))
    return F.substring_index(F.substring_index(text, "\0", 1), "\n", 1)


def line_packets(text: Column, size: int = 65536, pad: bool = False) -> Column:
    """The first line of a text with its line end as packets (array<binary>) of at most ``size``
    bytes; with ``pad`` the last one is filled with NUL."""
    data = F.to_binary(F.concat(F.substring_index(text, "\n", 1), F.lit("\n")), F.lit("utf-8"))
    n = F.ceil(F.length(data) / size).cast("int")
    whole = F.concat(data, F.to_binary(F.repeat(F.lit("\0"), n * size - F.length(data)), F.lit("utf-8"))) if pad else data
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column, first_dot: bool = False) -> Column:
    """The file name without its extension: from the last dot on (a leading dot belongs to the
    name), or with ``first_dot`` everything from the first."""
    b = base_name(path)
    return F.split_part(b, F.lit("."), F.lit(1)) if first_dot else F.regexp_replace(b, r"(?<=[^.])\.[^.]*$", "")


def language_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv]), F.coalesce(code, F.lit("")))


def block_size(seconds: Column, most: int, fixed: int | None = None) -> Column:
    """Decoding block: all tokens under two seconds of audio, eight under five, else four; ``fixed``
    (an option or a variable of the environment) wins."""
    if fixed is not None:
        return F.lit(int(fixed))
    return F.when(seconds < 2, F.lit(most)).when(seconds < 5, F.lit(8)).otherwise(F.lit(4))
