"""Same or near-same records across splits.

Texts: an exact prefix-filter join between evaluation and training texts. Of the disjoint
shingles of an evaluation text an edit destroys at most one, so among any (edits + 1) of
them one occurs unchanged in the partner, shifted by no more than the edits: the rarest
that many are indexed, and training texts probe with all their shingles under position and
length filters; the edit distance decides. Moments: an equi-join on recording and time slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import unicodedata
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm.splits import path_numbers
from utterlake.session import drop_path, store

#: Buckets of the table of shingle frequencies and bits of the table of indexed shingles:
#: both have this size however large the data are. Full tables cost time, never results.
FREQUENCY_BUCKETS = 1 << 18
INDEX_BITS = 1 << 26
#: Shingles no longer than this: shorter ones leave more to choose the rarest from.
SHINGLE = 6
POSITION_SLOT = 64
#: Shingles indexed beyond the (edits + 1): each asks for one more in common.
EXTRA = 1
#: Bits of a join key: few enough to shuffle cheaply; keys that fall together are told apart.
KEY_BITS = 40


class _Kept(dict):
    """For str.translate: letters, marks, digits and symbols stay, the rest goes."""

    def __missing__(self, cp: int) -> int | None:
        ch = chr(cp)
        self[cp] = None if unicodedata.category(ch)[0] in "PZC" else cp
        return self[cp]


_KEPT = _Kept()


def compared_form(text: str) -> str:
    """Without case, spaces, punctuation, character width and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(_KEPT)


def shingle_lengths(min_chars: int, one_in: int) -> list[tuple[int, int, int]]:
    """(q, from, to): for texts of from <= length < to, the longest shingle (up to
    SHINGLE) of which they have more disjoint ones than a partner may have edits (a ``one_in``-th of the longer text)."""
    out: list[tuple[int, int, int]] = []
    upto = 1 << 31
    for q in range(min(SHINGLE, one_in - 2), 1, -1):
        # beyond q * one_in**2 the quotients differ by more than one
        short = [n for n in range(1, q * one_in * one_in) if n // q <= n // (one_in - 1)]
        least = max(min_chars, max(short, default=0) + 1)
        if least < upto:
            out.append((q, least, upto))
            upto = least
        if upto == min_chars:
            return out
    raise ValueError(f"texts of {min_chars} characters are too short for this distance")


def _hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each place on."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, q, np.uint64)
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, length of each text, first place of each text)"""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return points, lengths, np.cumsum(lengths) - lengths


def _places(lengths: np.ndarray, starts: np.ndarray, q: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, position) of every shingle, each ``step`` characters."""
    counts = np.maximum(0, (lengths - q) // step + 1)
    text = np.repeat(np.arange(len(lengths)), counts)
    return text, (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * step


# the counts 0 to 15 round the clock, in eight bits: as many bits differ as counts lie apart
_CLOCK = np.array([(1 << i) - 1 for i in range(9)] + [255 & ~((1 << i) - 1) for i in range(1, 8)], np.uint64)


def _profiles(points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often characters of each of sixteen kinds come in each text, modulo 16, eight bits each.
    An edit changes at most two counts by one, so between texts within an edit distance at
    most twice that many bits differ."""
    n = len(lengths)
    kind = ((points * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.int64)
    count = np.bincount(np.repeat(np.arange(n), lengths) * 16 + kind, minlength=n * 16).reshape(n, 16)
    bits = _CLOCK[count & 15] << (np.arange(16, dtype=np.uint64) % np.uint64(8) * np.uint64(8))
    return np.bitwise_or.reduce(bits[:, :8], axis=1).view(np.int64), np.bitwise_or.reduce(bits[:, 8:], axis=1).view(np.int64)


def _length_slot(n: np.ndarray, one_in: int) -> np.ndarray:
    """Texts within the distance are in the same or neighbouring slots."""
    return np.floor(np.log(np.maximum(n, 1)) / -np.log1p(-1.001 / one_in)).astype(np.int64)


def _key(h: np.ndarray, length_slot: np.ndarray, position_slot: np.ndarray) -> np.ndarray:
    k = (h ^ (length_slot.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    k = ((k ^ (k >> np.uint64(32))) + position_slot.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (k >> np.uint64(64 - KEY_BITS)).view(np.int64)


def similar_texts(texts: DataFrame, one_in: int = 10, min_chars: int = 40) -> DataFrame:
    """(left_id, right_id) of all pairs of different texts, one of the left and one of the right
    side, whose edit distance is at most a ``one_in``-th of the longer one's length.

    ``texts``: tid bigint, text string, n int (its length), on_left boolean, on_right boolean,
    one row per text; shorter texts than ``min_chars`` are left out (they have no guarantee).
    All such pairs are found: no cap on partners or candidates.
    """
    spark = texts.sparkSession
    plan = shingle_lengths(min_chars, one_in)
    texts = texts.where(F.col("n") >= min_chars)

    def shingles(texts: list[str], step: bool, widen: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(lengths, text, position, hash, profile of each text) for each shingle length; with ``step``
        the disjoint ones only; with ``widen`` also of lengths that a partner may have."""
        points, lengths, starts = _flat(texts)
        profile = _profiles(points, lengths)
        for q, least, upto in plan:
            fit = (lengths < upto * one_in // (one_in - 1) + 1) & (lengths >= least * (one_in - 1) // one_in) if widen else (lengths < upto) & (lengths >= least)
            text, pos = _places(np.where(fit, lengths, 0), starts, q, q if step else 1)
            if len(text):
                yield lengths, text, pos, _hashes(points, q)[starts[text] + pos], profile

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FREQUENCY_BUCKETS, np.int64)
        for b in batches:
            for _, _, _, h, _ in shingles(b.column(0).to_pylist(), False, True):
                seen += np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=FREQUENCY_BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["bucket", "count"])

    counted = texts.where("on_right").select("text").mapInArrow(frequencies, "bucket bigint, count bigint").groupBy("bucket").agg(F.sum("count").alias("count")).toPandas()
    often = np.zeros(FREQUENCY_BUCKETS, np.uint32)
    often[counted["bucket"].to_numpy()] = np.minimum(counted["count"].to_numpy(), 0xFFFFFFFF)
    shared_often = spark.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lengths, text, pos, h, profile in shingles(b.column(1).to_pylist(), True, False):
                # the rarest (edits + 1 + EXTRA) of each text; ties by place
                order = np.lexsort((pos, shared_often.value[h >> np.uint64(46)], text))
                rank = np.arange(len(text)) - np.searchsorted(text, text)
                edits = lengths // (one_in - 1)
                chosen = order[rank <= edits[text] + EXTRA]
                text, pos, h = text[chosen], pos[chosen], h[chosen]
                edits = edits[text]
                first, last = np.maximum(0, pos - edits) // POSITION_SLOT, (pos + edits) // POSITION_SLOT
                slots = last - first + 1
                again = np.repeat(np.arange(len(text)), slots)
                slot = first[again] + np.arange(len(again)) - np.repeat(np.cumsum(slots) - slots, slots)
                for d in (-1, 0, 1):
                    k = _key(h[again], _length_slot(lengths[text[again]], one_in) + d, slot)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(pos[again].astype(np.int32)), pa.array(lengths[text[again]].astype(np.int32)), pa.array(ids[text[again]]), *[pa.array(p[text[again]]) for p in profile]], ["k", "pos", "n", "left_id", "pa", "pb"])

    index = texts.where("on_left").select("tid", "text").mapInArrow(prefixes, "k bigint, pos int, n int, left_id bigint, pa bigint, pb bigint")
    bit = F.shiftrightunsigned("k", KEY_BITS - INDEX_BITS.bit_length() + 1) + 1
    bits = index.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    have = np.zeros(INDEX_BITS, bool)
    for r in bits:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        at = (r["part"] - 1) * 32768
        have[at : at + len(part)] = part[: INDEX_BITS - at]
    shared_have = spark.sparkContext.broadcast(np.packbits(have))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared_have.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lengths, text, pos, h, profile in shingles(b.column(1).to_pylist(), False, True):
                k = _key(h, _length_slot(lengths, one_in)[text], pos // POSITION_SLOT)
                at = k.view(np.uint64) >> np.uint64(KEY_BITS - INDEX_BITS.bit_length() + 1)
                hit = (have[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
                text, pos, k = text[hit], pos[hit], k[hit]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(pos.astype(np.int32)), pa.array(lengths[text].astype(np.int32)), pa.array(ids[text]), *[pa.array(p[text]) for p in profile]], ["k", "pos2", "m", "right_id", "qa", "qb"])

    probing = texts.where("on_right").select("tid", "text").mapInArrow(probes, "k bigint, pos2 int, m int, right_id bigint, qa bigint, qb bigint")
    most = (F.greatest("n", "m") / F.lit(one_in)).cast("int")
    # an unchanged shingle parts both texts, and the edits are those before and those after it;
    # texts that share a phrase in its place but little else differ in their characters, which
    # is told before pairs are shuffled
    met = index.join(probing, "k").where((F.abs(F.col("pos") - F.col("pos2")) + F.abs(F.col("n") - F.col("pos") - F.col("m") + F.col("pos2")) <= most) & (F.col("left_id") != F.col("right_id")) & (F.expr("bit_count(pa ^ qa) + bit_count(pb ^ qb)") <= 2 * most))
    # an indexed shingle may meet several places of a text, which only lets more pairs through
    whole = F.lit(0)
    for q, least, upto in plan:
        whole = F.when((F.col("n") >= least) & (F.col("n") < upto), (F.col("n") / F.lit(q)).cast("int")).otherwise(whole)
    indexed = F.least(whole, (F.col("n") / F.lit(one_in - 1)).cast("int") + 1 + EXTRA)
    needed = indexed - most
    pairs = met.groupBy("left_id", "right_id").agg(F.min(needed).alias("needed"), F.count("pos").alias("met")).where("met >= needed").select("left_id", "right_id")
    t = texts.select("tid", "text")
    both = pairs.join(t.withColumnsRenamed({"tid": "left_id", "text": "a"}), "left_id").join(t.withColumnsRenamed({"tid": "right_id", "text": "b"}), "right_id")
    close = F.expr(f"levenshtein(a, b, cast(greatest(length(a), length(b)) / {int(one_in)} as int))")
    return both.where(close >= 0).select("left_id", "right_id")


def whole_transcript(previous: Column, continuation: Column, lang: Column) -> Column:
    """Both parts, joined by a space except in Chinese; null where both are null."""
    gap = F.when(F.lower(lang).isin("zh", "yue"), "").otherwise(" ")
    both = F.concat(F.coalesce(previous, F.lit("")), F.when((F.coalesce(previous, F.lit("")) == "") | (F.coalesce(continuation, F.lit("")) == ""), "").otherwise(gap), F.coalesce(continuation, F.lit("")))
    return F.when(previous.isNotNull() | continuation.isNotNull(), both)


def _compared(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [compared_form(x) if x else "" for x in b.column(2).to_pylist()]
            n = pa.array([len(x) for x in out], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), n, b.column(3)], ["id", "train", "text", "n", "least"])

    return df.mapInArrow(run, "id bigint, train boolean, text string, n int, least int")


def _moments(df: DataFrame, seconds: float) -> DataFrame:
    """(id, other): records outside and in training of one moment of a recording."""
    slot = F.floor(F.col("timestamp") / F.lit(seconds))
    at = df.where("audio_path is not null and timestamp is not null and not isnan(timestamp)").select("id", "train", "timestamp", path_numbers(F.col("audio_path")).alias("p")).select("id", "train", "timestamp", slot.alias("slot"), "p.session", "p.channel").where("session is not null and channel is not null")
    keys = ["session", "channel", "slot"]
    held = at.where("not train").select("id", "timestamp", "session", "channel", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    return held.join(at.where("train").select(F.col("id").alias("other"), F.col("timestamp").alias("then"), *keys), keys).where(F.abs(F.col("timestamp") - F.col("then")) < F.lit(seconds)).where("id <> other").select("id", "other").distinct()


def _texts(df: DataFrame, one_in: int, least: dict[str, int], least_other: int) -> tuple[DataFrame, DataFrame]:
    """((left_id, right_id) of texts that overlap, equal ones too; (id, train, tid): who has which text)."""
    # each different text once, and who has it
    need = F.lit(least_other)
    for k, v in least.items():
        need = F.when(F.lower("lang") == k, v).otherwise(need)
    spoken = whole_transcript(F.col("previous"), F.col("continuation"), F.col("lang"))
    long_enough = df.select("id", "train", spoken.alias("text"), need.cast("int").alias("least")).where(F.length("text") >= F.col("least"))
    own = _compared(long_enough).where("n >= least").select("id", "train", "text", "n", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    own, own_path = store(own, "transcripts")
    once = own.groupBy("h1", "h2").agg(F.min("text").alias("text"), F.min("n").alias("n"), F.max(~F.col("train")).alias("on_left"), F.max("train").alias("on_right"))
    once, _ = store(once.withColumn("tid", F.monotonically_increasing_id()), "texts")
    has, _ = store(own.select("id", "train", "h1", "h2").distinct().join(once.select("h1", "h2", "tid"), ["h1", "h2"]).select("id", "train", "tid"), "holders")
    drop_path(df.sparkSession, own_path)
    smallest = min([least_other, *least.values()])
    pairs = similar_texts(once.select("tid", "text", "n", "on_left", "on_right"), one_in, smallest)
    return pairs.unionByName(once.where("on_left and on_right").select(F.col("tid").alias("left_id"), F.col("tid").alias("right_id"))), has


def overlaps(df: DataFrame, train: str = "train", seconds: float = 0.005, one_in: int = 10, least: dict[str, int] | None = None, least_other: int = 120) -> DataFrame:
    """(id_a, id_b, reason) of all pairs of records, exactly one of them in the split ``train``.

    ``df``: id bigint, split, lang, previous, continuation, audio_path string, timestamp double.
    reason is 'moment' (paths name the same recording by session and channel, and the
    timestamps differ by less than ``seconds``) or 'text' (whole transcripts in compared
    form, each of at least ``least[lang]``, else ``least_other``, characters, whose edit
    distance is at most a ``one_in``-th of the longer one's length); a pair may have both.
    id_a < id_b. A record of a null split counts as not delivered as train; null ids,
    paths, timestamps, and texts that are null or too short match nothing. Repeated rows
    count once.
    """
    least = {"zh": 40, "yue": 40} if least is None else least
    df = df.where("id is not null").withColumn("train", F.coalesce(F.col("split") == train, F.lit(False)))
    moment = _moments(df, seconds).select("id", "other", F.lit("moment").alias("reason"))
    pairs, has = _texts(df, one_in, least, least_other)
    left = has.where("not train").select("id", F.col("tid").alias("left_id"))
    right = has.where("train").select(F.col("id").alias("other"), F.col("tid").alias("right_id"))
    text = pairs.join(left, "left_id").join(right, "right_id").select("id", "other", F.lit("text").alias("reason"))
    both = moment.unionByName(text).where("id <> other")
    return both.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "reason").distinct()


def report(df: DataFrame, train: str = "train", seconds: float = 0.005, one_in: int = 10, least: dict[str, int] | None = None, least_other: int = 120) -> DataFrame:
    """(split, source, train_source, reason, pairs, records): how many pairs :func:`overlaps` has per
    split and source of the record outside training, source in training, and reason; ``records``
    is the number of different records outside training among them.

    ``df`` is that of :func:`overlaps` with source; null splits and sources are counted as null.
    A record of several splits or sources counts in each. Pairs of texts are counted by how
    many records hold each text, so copies are not spread out into pairs.
    """
    least = {"zh": 40, "yue": 40} if least is None else least
    df = df.where("id is not null").withColumn("train", F.coalesce(F.col("split") == train, F.lit(False)))
    where = df.select("id", "train", "split", "source").distinct()
    pairs, has = _texts(df, one_in, least, least_other)
    group = ["split", "source", "train_source"]
    # who holds a text: outside training by split and source, in training by source
    held = has.join(where, ["id", "train"])
    outside = held.where("not train").groupBy(F.col("tid").alias("left_id"), "split", "source").agg(F.count(F.lit(1)).alias("n"))
    inside = held.where("train").groupBy(F.col("tid").alias("right_id"), F.col("source").alias("train_source")).agg(F.count(F.lit(1)).alias("m"))
    met = pairs.join(inside, "right_id").groupBy("left_id", "train_source").agg(F.sum("m").alias("m")).join(outside, "left_id")
    text = met.groupBy(*group).agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.sum("n").alias("records"))
    # a record delivered on both sides is no partner of its own
    own = held.where("not train").select("id", "tid", "split", "source").join(held.where("train").select("id", "tid", F.col("source").alias("train_source")), ["id", "tid"])
    text = text.unionByName(own.groupBy(*group).agg((-F.count(F.lit(1))).alias("pairs"), F.lit(0).cast("bigint").alias("records"))).groupBy(*group).agg(F.sum("pairs").alias("pairs"), F.sum("records").alias("records"))
    # moments hold few records each
    moment = _moments(df, seconds).join(where.where("not train").select("id", "split", "source"), "id").join(where.where("train").select(F.col("id").alias("other"), F.col("source").alias("train_source")), "other")
    # two steps instead of a distinct count, so that a hot group is pre-aggregated
    moment = moment.groupBy(*group, "id").count().groupBy(*group).agg(F.sum("count").alias("pairs"), F.count(F.lit(1)).alias("records"))
    out = text.withColumn("reason", F.lit("text")).unionByName(moment.withColumn("reason", F.lit("moment")))
    return out.where("pairs > 0").select(*group, "reason", "pairs", "records")
