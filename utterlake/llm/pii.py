"""Personal data in free text: found, typed, replaced.

Bootstrapped contextual extraction. Shapes (an address with @, a number with +, a title with a
capitalised word) only start it. What stands left and right of a mention, and its shape, are
patterns; patterns are scored by the instances they hold, instances by their patterns, in
turns over the graph of both, and the score accepts, types or drops every mention, also
those that started it. High-confidence patterns then discover what no shape gives away:
names in lower case or without title, the words they are made of, and numbers and addresses
of unknown form.

All counts cover all texts. What goes to the tasks are sketches, sized by the number of
patterns that passed; what they let through is decided by exact joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.llm import pii_scan as scan_
from utterlake.llm import pii_tokens
from utterlake.session import drop_path, store

KINDS = ("email", "phone", "id_number", "address", "name")
_CLASSES = ("email", "phone", "id_number", "address", "other")
#: What the mentions of each group can be.
_POSSIBLE = {"email": ("email",), "num": ("phone", "id_number"), "address": ("address",)}
_ROW = ["table_name", "row_id", "field"]
_PLACE = "table_name string, row_id bigint, field string, start int, end int"
# numbers of contexts (whole, two next tokens, inner pair; left and right) and of tokens
_NUMBERS = ["lw", "ln", "li", "rw", "rn", "ri", "t1", "t2", "t3"]
_SCHEMA = f"{_PLACE}, grp string, form string, seed string, left string, right string, shape string, often bigint, {', '.join(f'{c} bigint' for c in _NUMBERS)}"
_FIELDS = [tuple(x.split()) for x in _SCHEMA.split(", ")]

# what may stand in a context that announces numbers or addresses, whatever its form
_CODE = re.compile(r"[A-Za-z]{0,4}[ -]?\d[\dA-Za-z]*(?:[ ./-][\dA-Za-z]*\d[\dA-Za-z]*)*")
_SOMEWHERE = re.compile(r"\d{1,4}[a-z]?,?\s+[^\W\d_]{2,}(?:\s[^\W\d_]{2,}){0,2}|(?:[^\W\d_]{2,}\s){1,3}\d{1,4}[a-z]?(?=\s*(?:[^\w\s]|$))|[一-鿿]{2,10}[0-9零〇一二三四五六七八九十百]{1,6}[号號]")


class _ContextNumbers(dict):
    """Numbers of contexts, remembered."""

    def __missing__(self, context: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[context] = n = pii_tokens.context_number(context)
        return n


_CONTEXT_NUMBER = _ContextNumbers()


def _table(columns: dict[str, object], n: int) -> pa.RecordBatch:
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in _FIELDS], [c for c, _ in _FIELDS])


def _shaped(batch: pii_tokens.Batch) -> Iterator[tuple[int, scan_.Mention, int]]:
    """(text, mention, number of what is said) of emails, addresses and numbers of any known shape."""
    for i in batch.with_shapes().tolist():
        f = batch.folded[i]
        c = scan_.Context(f.text)
        out = scan_.emails(c)
        out += scan_.addresses(c, [(m.start, m.end) for m in out])
        out += scan_.numbers(c, [(m.start, m.end) for m in out])
        for m in out:
            said = pii_tokens.number(f.text[m.start : m.end].lower())
            m.start, m.end = f.span(m.start, m.end)
            yield i, m, said


def _opened(batch: pii_tokens.Batch, opens: pii_tokens.Sketch) -> Iterator[tuple[int, int, int, str, int]]:
    """(text, start, end, form, context) of what stands in contexts that announce numbers and
    addresses, in forms open to any."""
    at = np.flatnonzero(batch.kind != pii_tokens.MARK)
    left = batch.contexts(at, False, False)[0]
    hit = (left != 0) & opens.has(left)
    for i, context in zip(at[hit].tolist(), left[hit].tolist()):
        t = int(batch.text[i])
        f, a = batch.folded[t], int(batch.start[i] - batch.text_start[t])
        if (m := _CODE.match(f.text, a)) and sum(map(str.isdecimal, m.group())) >= 5:
            yield t, *f.span(a, m.end()), "code", context
        if m := _SOMEWHERE.match(f.text, a):
            yield t, *f.span(a, m.end()), "somewhere", context


def _scanned(texts: DataFrame, known: tuple[bytes, ...] | None) -> DataFrame:
    """Mentions of each text. The first time (without ``known``) those of known shapes, titled and
    capitalised names, and rows of group 'count' (t1: a token or two next to each other,
    often: how often in this part of the table); then names and others that what is known
    points to."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = shared.value and pii_tokens.Known(*[pii_tokens.Sketch(np.frombuffer(b, np.uint8)) for b in shared.value])
        counted: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, inverse = np.unique(np.concatenate([a for a, _ in counted]), return_inverse=True)
            return h, np.bincount(inverse, np.concatenate([b for _, b in counted])).astype(np.int64)

        def counts() -> pa.RecordBatch:
            h, n = merged()
            return _table({"grp": ["count"] * len(h), "t1": h, "often": n}, len(h))

        for b in batches:
            batch = pii_tokens.Batch(b.column(3).to_pylist())
            where = lambda rows: {c: b.column(i).take(pa.array(rows, pa.int64())) for i, c in enumerate(_ROW)}  # noqa: E731, B023
            if sketches is None:
                counted.append(batch.counts())
                if sum(len(a) for a, _ in counted) > 4_000_000:
                    counted = [merged()]
                    if len(counted[0][0]) > 2_000_000:  # hand on what is counted so far
                        yield counts()
                        counted = []
                rows = list(_shaped(batch))
                if rows:
                    texts, ms, said = zip(*rows)
                    yield _table({**where(texts), "start": [m.start for m in ms], "end": [m.end for m in ms], "grp": [m.group for m in ms], "form": [m.form for m in ms], "seed": [m.seed for m in ms], "left": [m.left for m in ms], "right": [m.right for m in ms], "shape": [m.shape for m in ms], "ln": [_CONTEXT_NUMBER[m.left] for m in ms], "t1": said}, len(ms))
            else:
                rows = list(_opened(batch, sketches.opens))
                if rows:
                    texts, start, end, form, context = zip(*rows)
                    yield _table({**where(texts), "start": start, "end": end, "grp": ["open"] * len(rows), "form": form, "ln": context}, len(rows))
            for found, wide in zip(batch.names(sketches), (False, True)):
                n = len(found.form)
                if n:
                    spans = [batch.span(a, z) for a, z in zip(found.begin.tolist(), found.end.tolist())]
                    columns = dict(zip(_NUMBERS, (*batch.contexts(found.begin, False, wide), *batch.contexts(found.end, True, wide), *found.tokens.T)))
                    yield _table({**where([t for t, _, _ in spans]), **columns, "start": [x for _, x, _ in spans], "end": [x for _, _, x in spans], "grp": ["name"] * n, "form": found.form, "seed": np.where(found.seed, "name", "")}, n)
        if counted:
            yield counts()

    return texts.select(*_ROW, "text").where(F.col("text").isNotNull() & (F.col("text") != "")).mapInArrow(run, _SCHEMA)


def _sketch(numbers: DataFrame) -> bytes:
    """The sketch of a one-column table of numbers: at least 16 bits for each, between 16 kB and 128 MB."""
    bits = 1 << min(30, max(17, (16 * numbers.count()).bit_length()))
    at = F.col(numbers.columns[0]).bitwiseAND(bits - 1) + 1
    out = bytearray(bits // 8)
    for r in numbers.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = bytes(r["bits"])
    return bytes(out)


def _patterns() -> Column:
    """What speaks for a kind: the contexts left and right, whole and next to the mention, and the
    shape, alone and with the token before."""
    left, right = F.when(F.col("left") != "^", F.col("left")), F.when(F.col("right") != "$", F.col("right"))
    before, after = F.element_at(F.split(left, " "), -1), F.element_at(F.split(right, " "), 1)
    said = F.when(F.col("shape") != "", F.concat("grp", F.lit(":"), "shape"))
    parts = [F.concat(F.lit("L:"), left), F.concat(F.lit("R:"), right), F.concat(F.lit("l:"), before), F.concat(F.lit("r:"), after), F.concat(F.lit("S:"), said), F.concat(F.lit("B:"), F.substring_index(said, ":", 2), F.lit("|"), before)]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def score(mentions: DataFrame, rounds: int = 3, prior: float = 1.0, trust: float = 10.0) -> DataFrame:
    """(grp, left, right, shape, seed, kind, sure): the kind of emails, numbers and addresses by the
    pattern-instance graph, '' where none is likely.

    An instance is a mention with its surroundings, its patterns are what stands left, right,
    and its shape. Seeds begin with their label, others without. In each round a pattern's
    score of a kind is its share among the pattern's labelled instances (``prior`` unlabelled
    ones added) against all kinds alike, and every instance, seed or not, gets the kinds that
    its patterns together speak for; that it is a seed counts as ``trust`` to one for its kind,
    which its patterns can outweigh. Equal instances are counted before anything is shuffled.
    """
    spark = mentions.sparkSession
    key = ["grp", "left", "right", "shape", "seed"]
    inst = mentions.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    inst = inst.select("*", F.xxhash64(*key).alias("i"), *[F.when(F.col("seed") == c, 1.0).otherwise(0.0).alias(c) for c in _CLASSES])
    table, path = store(inst, "mentions-scored", keep=False)
    k = len(_CLASSES)
    for _ in range(rounds):
        e = table.select("i", "n", *_CLASSES, F.explode(_patterns()).alias("p"))
        mass = F.sum(F.col("n") * sum(F.col(c) for c in _CLASSES))
        pat = e.groupBy("p").agg(*[F.log((F.sum(F.col("n") * F.col(c)) + prior / k) / (mass + prior) * k).alias(f"p_{c}") for c in _CLASSES])
        said = e.select("i", "p").join(pat, "p").groupBy("i").agg(*[F.exp(F.sum(f"p_{c}")).alias(f"e_{c}") for c in _CLASSES])
        own = {c: F.coalesce(f"e_{c}", F.lit(1.0)) * F.when(F.col("seed") == c, trust).otherwise(1.0) for c in _CLASSES}
        total = sum(own.values())
        top = F.greatest(*own.values()) / total
        new = table.join(said, "i", "left").select(*key, "n", "i", *[F.when(top >= 0.6, x / total).otherwise(0.0).alias(c) for c, x in own.items()])
        last = path
        table, path = store(new, "mentions-scored", keep=False)
        drop_path(spark, last)
    best = F.greatest(*[F.col(c) for c in _CLASSES])
    kind = F.when(best < 0.5, "")
    for c in _CLASSES:
        kind = kind.when(F.col(c) == best, c)
    out, _ = store(table.select(*key, kind.alias("kind"), best.alias("sure")), "mention-kinds")
    drop_path(spark, path)
    return out


def _announcing(decided: DataFrame, counts: DataFrame, share: float, least: int) -> DataFrame:
    """(ln, kind): contexts of two tokens of at least ``least`` different mentions of a kind, which
    take at least ``share`` of all places where the tokens stand: what comes there next is of
    the kind, whatever its form."""
    of = decided.where("ln <> 0 and kind in ('id_number', 'address')").groupBy("ln", "kind", "t1").agg(F.count(F.lit(1)).alias("n"))
    of = of.groupBy("ln", "kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).where(F.col("different") >= least)
    return of.join(counts, F.col("ln") == F.col("w")).where(F.col("n") >= share * F.col("total")).select("ln", "kind")


def _contexts(named: DataFrame, counts: DataFrame, least_share: float, least_seeds: int) -> DataFrame:
    """(role, h): contexts of at least ``least_seeds`` different names, which take at least
    ``least_share`` of all places where the context's words stand (of more than two, the inner
    pair tells how often it may stand)."""
    one = lambda role, h, w: F.struct(F.lit(role).alias("role"), F.col(h).alias("h"), F.col(w).alias("w"))
    each = F.array_distinct(F.array(one("L", "lw", "li"), one("L", "ln", "ln"), one("R", "rw", "ri"), one("R", "rn", "rn")))
    p = named.select("t1", F.explode(each).alias("p")).select("t1", "p.*").where("h <> 0").groupBy("role", "h", "w", "t1").agg(F.count(F.lit(1)).alias("n"))
    p = p.groupBy("role", "h", "w").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= least_seeds)
    return p.join(counts, "w").where(F.col("n") >= least_share * F.col("total")).select("role", "h").distinct()


def _tokens(named: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, share): the share of a token's occurrences that are in names."""
    t = named.select(F.explode(F.array("t1", "t2", "t3")).alias("w")).where("w <> 0").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return t.join(counts, "w").select(F.col("w").alias("h"), F.least(F.lit(1.0), F.col("n") / F.col("total")).alias("share"))


def _judged(found: DataFrame, tokens: DataFrame, contexts: DataFrame) -> DataFrame:
    """``found`` (with an ``id``) with the shares of its tokens (s1 to s3, 0 for unknown ones) and
    whether a known context holds it: its tokens and contexts meet what is known in one join."""
    known = tokens.select(F.lit("T").alias("role"), "h", "share").unionByName(contexts.select("role", "h", F.lit(1.0).alias("share")))
    one = lambda slot, role, h: F.struct(F.lit(slot).alias("slot"), F.lit(role).alias("role"), F.col(h).alias("h"))
    slots = F.array(*[one(i, "T", f"t{i}") for i in (1, 2, 3)], one(4, "L", "lw"), one(4, "L", "ln"), one(4, "R", "rw"), one(4, "R", "rn"))
    asked = found.select("id", F.explode(slots).alias("x")).select("id", "x.*").where("h <> 0")
    told = asked.join(known, ["role", "h"]).groupBy("id").agg(*[F.max(F.when(F.col("slot") == i, F.col("share"))).alias(f"s{i}") for i in (1, 2, 3)], F.max(F.col("slot") == 4).alias("held"))
    out = found.join(told, "id", "left")
    return out.withColumns({**{f"s{i}": F.coalesce(f"s{i}", F.lit(0.0)) for i in (1, 2, 3)}, "held": F.coalesce("held", F.lit(False))})


def _accepted(sure: float, held: float) -> Column:
    s1, s2, s3 = (F.col(f"s{i}") for i in (1, 2, 3))
    second, third = F.when(F.col("t2") == 0, 1.0).otherwise(s2), F.when(F.col("t3") == 0, 1.0).otherwise(s3)
    return (
        # a surname that stands in names, or a title that mostly follows surnames
        F.when(F.col("form") == "han_title", F.col("held") | (s1 >= held / 10) | (s2 >= held))
        .when(F.col("form") == "title", s1 >= held)
        # characters of Chinese names also stand in names of places: one telling character is
        # enough, and in a known context a few occurrences in names
        .when(F.col("form") == "han", (F.least(s2, third) >= held / 10) & (F.col("held") | (F.greatest(s2, s3) >= sure)))
        # a first character that is no listed surname has to stand mostly at such places
        .when(F.col("form") == "han_open", F.col("held") & (s1 >= sure) & (second >= held / 10) & (third >= held / 10))
        .otherwise(F.when(F.col("held"), F.least(s1, s2) >= held).otherwise(F.least(s1, s2) >= sure))
    )


def find_spans(texts: DataFrame, rounds: int = 2, least_seeds: int = 2, context_share: float = 0.02, sure: float = 0.25, held: float = 0.1, announced: float = 0.5) -> DataFrame:
    """(table_name, row_id, field, start, end, kind): personal data in ``texts`` (table_name
    string, row_id bigint, field string, text string).

    start and end count characters of the text, end excluded. kind is one of KINDS. Null
    and empty texts have none; a text that comes twice under the same key counts once. Spans
    of different kinds may overlap; :func:`redact` takes the first and longest.
    ``rounds`` of names follow the first scan; a context counts from ``least_seeds`` different
    names on that take ``context_share`` of its occurrences; tokens count as names where
    ``sure`` (in a known context ``held``) of their occurrences are in names. A context of
    which identity numbers or addresses take ``announced`` of the occurrences finds others of
    any form.
    """
    spark = texts.sparkSession
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out, path = store(df, name, keep=False)
        paths.append(path)
        return out

    def identified(df: DataFrame) -> DataFrame:
        return df.withColumn("id", F.monotonically_increasing_id())

    first = keep(identified(_scanned(texts, None)), "mentions")
    counts = keep(first.where("grp = 'count'").groupBy(F.col("t1").alias("w")).agg(F.sum("often").alias("total")), "counts")
    shaped = first.where("grp in ('num', 'email', 'address')")
    possible = F.lit(False)
    for g, kinds in _POSSIBLE.items():
        possible = possible | ((F.col("grp") == g) & F.col("kind").isin(*kinds))
    decided = keep(shaped.join(score(shaped), ["grp", "left", "right", "shape", "seed"]).where(possible).select(*_ROW, "start", "end", "kind", "ln", "t1"), "decided")
    announcing = keep(_announcing(decided, counts, announced, 3), "announcing")
    opens = _sketch(announcing.select("ln"))

    # names: contexts of titled names accept capitalised pairs, these give tokens, and so on
    found = first.where("grp = 'name'")
    named = found.where("seed = 'name'")
    contexts = keep(_contexts(named, counts, context_share, least_seeds), "contexts")
    for r in range(rounds):
        judged = _judged(found, _tokens(named, counts), contexts)
        # before tokens are known the context alone speaks for a capitalised pair
        good = judged.where("seed = 'name' or held" if r == 0 else _accepted(sure, held))
        good = keep(good.select(*found.columns), "named")
        tokens = keep(_tokens(good, counts).where(F.col("share") >= held / 10), "tokens")
        contexts = keep(_contexts(good, counts, 4 * context_share, least_seeds), "contexts")
        sides = [contexts.where(F.col("role") == side).select("h") for side in ("L", "R")]
        scanned = keep(identified(_scanned(texts, (_sketch(tokens.select("h")), *map(_sketch, sides), opens))), "names")
        found = scanned.where("grp = 'name'")
        # what stands in a known context counts towards its tokens; their share decides
        judged = _judged(found, _tokens(good, counts), contexts)
        named = judged.where(F.col("held") | _accepted(sure, held)).select(*found.columns)
    judged = _judged(found, _tokens(named, counts), contexts)
    names = judged.where(_accepted(sure, held)).select(*_ROW, "start", "end", F.lit("name").alias("kind"))
    spans = decided.select(*_ROW, "start", "end", "kind").unionByName(names)
    if rounds:
        fits = (F.col("form") == "code") & (F.col("kind") == "id_number") | (F.col("form") == "somewhere") & (F.col("kind") == "address")
        spans = spans.unionByName(scanned.where("grp = 'open'").join(announcing, "ln").where(fits).select(*_ROW, "start", "end", "kind"))
    out, _ = store(spans.distinct(), "spans")
    for path in paths:
        drop_path(spark, path)
    return out


def redact(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with ``redacted``: each span replaced by its kind in square brackets, capital
    letters ([EMAIL]); the rest is unchanged. Of overlapping spans the first, and of those the
    longest, is replaced. Null texts stay null. ``texts`` has (table_name, row_id, field,
    text); rows that are repeated stay repeated. Only texts with spans are rebuilt."""
    per = spans.distinct().groupBy(*_ROW).agg(F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "kind"))).alias("_spans"))
    joined = texts.join(per, _ROW, "left")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["upto"]
        put = F.concat(acc["done"], F.substring(F.col("text"), acc["upto"] + 1, s["start"] - acc["upto"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(skip, acc).otherwise(F.struct(put.alias("done"), (-s["back"]).alias("upto")))

    whole = F.aggregate("_spans", start, step, lambda a: F.concat(a["done"], F.substring(F.col("text"), a["upto"] + 1, F.length("text"))))
    return joined.withColumn("redacted", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(whole)).drop("_spans")
