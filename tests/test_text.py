"""Text expressions against plain Python."""

import random
import re
import string
import unicodedata

from pyspark.sql import functions as F

from utterlake.functions import pcm
from utterlake.functions import text as T

ALPHABET = list("abcXYZ 019.,!$%^-é中文啊两萬幺，。？\t　ñ𠀀") + ["<|x|>", "�"]


def strings(n, seed=1):
    r = random.Random(seed)
    return ["", " "] + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 25))) for _ in range(n)]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def punctuation(c):
    return unicodedata.category(c).startswith("P")


def test_strip_punctuation(spark):
    v = strings(400)
    want = ["".join(c for c in s if c not in string.punctuation and not punctuation(c)) for s in v]
    assert column(spark, v, T.strip_punctuation) == want


def test_punctuation_to_space(spark):
    v = strings(400, 2)
    want = [" ".join("".join(" " if c in string.punctuation or punctuation(c) else c for c in s).split()) for s in v]
    assert column(spark, v, T.punctuation_to_space) == want


def test_lower_ascii(spark):
    v = ["ÄBC", "É", "aB中", ""]
    assert column(spark, v, T.lower_ascii) == ["Äbc", "É", "ab中", ""]


def test_despace(spark):
    cjk = "㐀-䶿一-鿿豈-﫿"
    v = strings(400, 3) + ["中 文", "中 a 中", "中 文 字", "𠀀 𠀀"]
    assert column(spark, v, T.despace_cjk) == [re.sub(rf"([{cjk}])\s+(?=[{cjk}])", r"\1", s) for s in v]


def test_resolve_language(spark):
    rows = [("zh-hk", "中", "yue"), ("ZH", "x", "zh"), ("en", "中", "zh"), ("en", "x", None), (None, "中", "zh"), ("zh", "", None), ("cmn", "x", "zh"), (" Yue ", "x", "yue"), (None, None, None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "h string, t string")
    assert [r[0] for r in df.select(T.resolve_language(F.col("h"), F.col("t"))).collect()] == [c for _, _, c in rows]


def test_fold_variants(spark):
    df = spark.createDataFrame([("两百萬", "zh"), ("啊好的", "yue"), ("啊好的", "en"), (None, "zh")], "s string, l string")
    assert [r[0] for r in df.select(T.fold_variants(F.col("s"), F.col("l"))).collect()] == ["二百万", "好的", "啊好的", None]


def test_number_to_han(spark):
    rows = {"0": "零", "10": "十", "11": "十一", "20": "二十", "101": "一百零一", "110": "一百一十", "1001": "一千零一", "1010": "一千零一十", "10000": "一万", "100000": "十万", "10203": "一万零二百零三", "100000000": "一亿", "100010000": "一亿零一万", "100000001": "一亿零一", "3.14": "三点一四", "50%": "百分之五十", "共78份": "共七十八份", "007": "七", "12345678901234567": "12345678901234567", "x": "x", "": ""}
    assert column(spark, list(rows), T.number_to_han) == list(rows.values())


def tokens(text, hint):
    """Independent reading of the tokenizer's rule."""
    t = text.strip()
    lang = "zh" if t and any("一" <= c <= "鿿" or c == "𠀀" for c in t) else None
    if hint in ("zh", "yue") and t:
        lang = hint
    if not t:
        return []
    if lang is None:
        t = t.lower()
        return "".join(" " if c in string.punctuation or punctuation(c) else c for c in t).split()
    return None


def test_mixed_tokens(spark):
    v = [s for s in strings(300, 4) if tokens(s, "en") is not None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(v)], "i int, s string").orderBy("i")
    assert [r[0] for r in df.select(T.mixed_tokens(F.col("s"), F.lit("en"))).collect()] == [tokens(s, "en") for s in v]
    df = spark.createDataFrame([("我有ABC def，3个",), ("",), (None,), ("，。",)], "s string")
    assert [r[0] for r in df.select(T.mixed_tokens(F.col("s"), F.lit("zh"))).collect()] == [["我", "有", "abc", "def", "三", "个"], [], [], []]


def test_canonical_text(spark):
    v = ["ＡＢｃ １", "<|en|>Hi, there�!", "é́", ""]
    want = []
    for s in v:
        s = unicodedata.normalize("NFKC", re.sub(r"<\|[^|]*\|>", "", s).replace("�", ""))
        s = "".join(c for c in s if not c.isspace() and not punctuation(c))
        want.append("".join(c.lower() if ord(c) < 128 else c for c in s))
    assert column(spark, v, T.canonical_text) == want


def test_candidates(spark):
    df = spark.createDataFrame([([None, "A b", "。", "c"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(T.clean_candidates(F.col("c"), 2)).collect()] == [["ab"], [], None]


def test_paths(spark):
    v = ["/a/b.c.wav", "x", "/a/.hidden", "d/e.WAV"]
    assert column(spark, v, T.base_name) == ["b.c.wav", "x", ".hidden", "e.WAV"]
    assert column(spark, v, T.stem) == ["b.c", "x", ".hidden", "e"]
    assert column(spark, v, lambda c: T.stem(c, True)) == ["b", "x", "", "e"]


def test_delta_and_names(spark):
    df = spark.createDataFrame([("abcd", "ab"), ("abcd", "x"), ("ab", "ab")], "f string, p string")
    assert [r[0] for r in df.select(T.text_delta(F.col("f"), F.col("p"))).collect()] == ["cd", "abcd", ""]
    assert column(spark, ["yue", "xx", None, "auto"], T.language_name) == ["Cantonese", None, None, None]


def test_delta_after_a_common_block(spark):
    df = spark.createDataFrame([("abcdef", "abc"), ("xbcdef", "abcd"), ("zz", "abc"), (None, "a"), ("a", None)], "f string, p string")
    assert [r[0] for r in df.select(T.text_delta(F.col("f"), F.col("p"), common=True)).collect()] == ["def", "ef", "zz", None, None]
    assert [r[0] for r in df.select(T.text_delta(F.col("f"), F.col("p"))).collect()][1] == "xbcdef"


def test_script_table(spark):
    df = spark.createDataFrame([("頭髮發展",), (None,), ("",)], "s string")
    phrases = {"頭髮": "头发", "發": "发", "頭": "头"}
    assert [r[0] for r in df.select(T.convert_script(F.col("s"), phrases)).collect()] == ["头发发展", None, ""]
    assert df.select(T.convert_script(F.col("s"))).first()[0] == "頭髮發展"
    lang = spark.createDataFrame([("發", "zh"), ("發", "yue"), ("發", None)], "s string, l string")
    assert [r[0] for r in lang.select(T.normalize_utterance(F.col("s"), F.col("l"), {"zh": {"發": "发"}})).collect()] == ["发", "發", "發"]


def test_packets(spark):
    df = spark.createDataFrame([("h\u00e9llo\nmore",), ("",)], "s string")
    got = [[bytes(x) for x in r[0]] for r in df.select(T.line_packets(F.col("s"), 4, pad=True)).collect()]
    assert got == [[b"h\xc3\xa9l", b"lo\n\0"], [b"\n\0\0\0"]]
    assert [bytes(x) for x in df.select(T.line_packets(F.col("s"), 4)).first()[0]] == [b"h\xc3\xa9l", b"lo\n"]
    p = spark.createDataFrame([(b"ab\xff\ncd\0",), (b"x\0y\nz",), (b"",)], "b binary")
    assert [r[0] for r in p.select(T.packet_line(F.col("b"))).collect()] == ["ab\ufffd", "x", ""]


def test_candidates_to_display(spark):
    df = spark.createDataFrame([(["a\ufffd\ufffd", "\ufffdb", " ", None, "\ufffd"],), ([" "],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(T.display_candidates(F.col("c"))).collect()] == [["a", "\ufffdb"], None, None, None]


def test_soft_prefix(spark):
    pieces = [b"ab", "\u00e9".encode()[:1], "\u00e9".encode()[1:], b"c", b"d"]
    df = spark.createDataFrame([(pieces, k) for k in (0, 1, 2, 3, 4, 9)], "p array<binary>, k int")
    assert [r[0] for r in df.select(pcm.soft_prefix(F.col("p"), F.col("k"))).collect()] == ["abécd", "abéc", "abé", "ab", "ab", ""]
