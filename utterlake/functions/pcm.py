"""Arrays of audio samples and of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(pcm: Column, begin: Column, end: Column, rate: int = 16000) -> Column:
    """Samples from ``begin`` to ``end`` seconds, both truncated to samples and kept in range."""
    n = F.size(pcm)
    a = F.least(F.greatest((begin * rate).cast("int"), F.lit(0)), n)
    b = F.least(F.greatest((end * rate).cast("int"), a), n)
    return F.slice(pcm, a + 1, b - a)


def downmix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def pad(values: Column, to: Column, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, (to - F.size(values)).cast("int")))


def label_mask(tokens: Column, prompt: Column, ignore: int = -100) -> Column:
    """Labels: ``ignore`` at the first ``prompt`` places and at padding (null tokens)."""
    return F.transform(tokens, lambda x, i: F.when((i < prompt) | x.isNull(), F.lit(ignore)).otherwise(x))


def resample(pcm: Column, from_rate: int, to_rate: int) -> Column:
    """Linear interpolation onto round(duration * to_rate) samples, both grids without their end
    point; beyond the last sample its value holds."""
    n = F.size(pcm)
    m = F.round(n / F.lit(float(from_rate)) * to_rate).cast("int")

    def at(i: Column) -> Column:
        x = i * n / m
        lo = F.floor(x).cast("int")
        a, b = F.get(pcm, F.least(lo, n - 1)), F.get(pcm, F.least(lo + 1, n - 1))
        return a + (b - a) * (x - lo)

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), F.greatest(m - 1, F.lit(0))), at)).otherwise(F.slice(pcm, 1, 0).cast("array<double>"))


def scale_int16(pcm: Column) -> Column:
    return F.transform(pcm, lambda x: x / 32768)


def attention_mask(values: Column, to: Column) -> Column:
    """1 for each value, 0 for each place of padding up to ``to``."""
    n = F.size(values)
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(0), (to - n).cast("int"))))


def long_enough(pcm: Column, least: int = 1600) -> Column:
    """Whether there is enough audio to decode; false for null."""
    return F.coalesce(F.size(pcm) >= least, F.lit(False))


def drop_tail(tokens: Column, k: Column) -> Column:
    """Tokens without the last ``k``."""
    return F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - k))


def soft_prefix(pieces: Column, k: Column) -> Column:
    """The text of byte pieces (array<binary>) without the last ``k``, and without as many more as it
    takes to end with a whole character and to hold no U+FFFD; empty if none is left."""
    n = F.greatest(F.lit(0), F.size(pieces) - k)
    text = lambda e: F.aggregate(F.slice(pieces, F.lit(1), e), F.lit(b""), lambda a, x: F.concat(a, x))
    good = lambda e: F.is_valid_utf8(text(e).cast("string")) & ~F.contains(text(e).cast("string"), F.lit("\ufffd"))
    longest = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), good)), F.lit(0))
    return text(longest).cast("string")


def response_length(whole: Column, prompt: Column) -> Column:
    """Tokens of an example beyond those of its prompt."""
    return F.greatest(F.lit(0), F.size(whole) - F.size(prompt))
