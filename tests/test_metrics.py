"""Error rates and alignment against plain Python."""

import random

from pyspark.sql import functions as F

from utterlake.functions import metrics as M
from utterlake.plans import evaluate


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_golden(spark):
    df = spark.createDataFrame([("对不对？", "知道", "zh"), ("两百", "二百", "zh"), ("啊好的", "好的", "zh"), ("中 文", "中文", "zh"), ("", "", "en"), ("", "x", "en"), (None, None, None), ("是的", "是的是的", "zh"), ("a$b", "ab", "en")], "reference string, generated string, lang string")
    got = evaluate.per_file(df)
    assert [r["cer"] for r in got.collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert got.collect()[0]["mer"] == 1.0


def test_token_rate(spark):
    r = random.Random(5)
    rows = [([r.choice("abcdef") for _ in range(r.randrange(0, 9))], [r.choice("abcdef") for _ in range(r.randrange(0, 9))]) for _ in range(200)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = [x["r"] for x in M.with_token_rate(df, "a", "b", "r").orderBy("i").collect()]
    assert got == [distance(a, b) / len(a) if a else float(bool(b)) for a, b in rows]


def test_prefix_end():
    r = random.Random(6)
    for _ in range(300):
        a = "".join(r.choice("ab中") for _ in range(r.randrange(0, 9)))
        b = "".join(r.choice("ab中") for _ in range(r.randrange(0, 12)))
        want = 0 if not a or not b else min(range(len(b) + 1), key=lambda j: (distance(a, b[:j]), abs(j - len(a)), j))
        assert M.prefix_end(a, b) == want
    assert M.prefix_end("ab", "xx") == 2


def test_summary(spark):
    refs = spark.createDataFrame([("a",), ("b",)], "file string")
    scored = spark.createDataFrame([("a", 0.5, 0.25)], "file string, cer double, mer double")
    assert evaluate.summary(refs, scored, "file").first().asDict() == {"total_files": 2, "matched_files": 1, "unmatched_files": 1, "average_cer": 0.5, "average_mer": 0.25}
    assert evaluate.summary(refs.limit(0), scored.limit(0), "file").first()["average_cer"] == 0.0


def test_references_last_wins(spark):
    df = spark.createDataFrame([("/x/a.wav", "one"), ("/y/a.wav", "two"), ("/z/b.wav", ""), (None, "t")], "p string, t string")
    assert {r["file"]: r["text"] for r in evaluate.references(df, "p", "t").where(F.col("file").isNotNull()).collect()} == {"a.wav": "two", "a": "two"}


def test_token_rate_of_very_many_tokens(spark):
    n = 3000
    rows = [([f"t{i}" for i in range(n)], [f"t{i}" for i in range(0, n, 2)])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert M.with_token_rate(df, "a", "b", "r").first()["r"] == 0.5
    # places around the surrogates and U+FEFF keep tokens apart
    text = M._as_text(F.array(F.lit("x"), F.lit("y")), F.concat(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.lit("-")), F.array(F.lit("x"), F.lit("y"))))
    d = spark.createDataFrame([(k,) for k in (1, 0xD6FF, 0xD700, 0xF5FE, 0xF5FF, 0x20000)], "n int")
    got = [r[0] for r in d.select(text.alias("t")).collect()]
    assert all(len(t) == 2 and t[0] != t[1] and "\ufeff" not in t for t in got)


def test_prefix_ends_of_many_pairs():
    r = random.Random(17)
    word = lambda: "".join(r.choice("abç好") for _ in range(r.randrange(0, 14)))
    pairs = [(word(), word()) for _ in range(900)] + [("a" * 3000, "ab" * 1500), ("", "a"), ("a", "")]
    for a, b in pairs[:300]:  # against all prefixes
        d = [plain_edits(a, b[:k]) for k in range(len(b) + 1)]
        assert M.prefix_end(a, b) == (min(range(len(d)), key=lambda k: (d[k], abs(k - len(a)), k)) if a and b else 0)
    assert M.prefix_ends([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [M.prefix_end(a, b) for a, b in pairs]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]
