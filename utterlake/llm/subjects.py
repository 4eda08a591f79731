"""Subject areas of documents by distributed latent Dirichlet topic models.

One model per group of languages (languages share no terms), fitted by variational Bayes
without any seeded term: the parts of the corpus infer the topic shares of their documents
under the current topics and hand on expected counts, which are added up by a tree and make
the next topics, over all documents in every round. Words that stand in as many documents as
chance would put them in tell nothing of a subject and are left out before. The top terms of
each fitted topic are inspected against labelled documents, and the topic takes the subject
that they tell; a document gets the subjects that its sentences' topics have the share of.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm.common import word_hashes
from utterlake.llm.leakage import _APOSTROPHE, _INVISIBLE, _MARK, _SPEAKER
from utterlake.session import drop_path, store

# Frequent words that tell a language, and the groups that have a model.
_STOP = {"en": {"the", "and", "was", "that", "with", "you", "is"}, "de": {"der", "die", "und", "ist", "das", "hat", "nach"}, "es": {"el", "la", "que", "por", "los", "en", "para"}}
GROUPS = ("en", "de", "es", "zh", "other")
_LANG = {"yue": "zh", "cmn": "zh"}
# Texts of these characters need no normal form.
_PLAIN = re.compile("[\x09\x0a\x0d\x20-\x7e一-鿿。、，！？；：À-ÖØ-öø-ÿ¿¡]*")
#: Prior of the topic shares of a document and of the terms of a topic.
ALPHA, ETA = 0.1, 0.01
#: Texts tokenized together.
_TOGETHER = 2000

# ---- tokens ----
_OTHER, _LETTER, _DIGIT, _HAN, _MARKS = range(5)


def _kinds() -> np.ndarray:
    """What each character of the basic plane is."""
    kind = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isalnum():
            kind[i] = _DIGIT if c.isdigit() else _LETTER
    for a, b in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
        kind[a : b + 1] = _HAN
    kind[[ord(c) for c in ".?!;,:…。，！？；：、\n"]] = _MARKS
    return kind


_KIND: np.ndarray | None = None


def clean(text: str) -> str:
    """Lower case, one width, without invisible characters, apostrophes within words, and marks
    of time and speaker."""
    if not text.isascii() and not _PLAIN.fullmatch(text):
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if ":" in text or "：" in text:
        text = _SPEAKER.sub(" ", _MARK.sub(" ", text.replace("：", ":")))
    text = text.lower()
    return _APOSTROPHE.sub("", text) if "'" in text or "’" in text else text


@dataclass
class Tokens:
    """Terms of some texts, in order: words of three letters or more, and pairs of neighbouring
    Chinese characters."""

    doc: np.ndarray
    sentence: np.ndarray  # within the text; sentences without terms don't count
    term: np.ndarray
    start: np.ndarray
    length: np.ndarray
    points: np.ndarray
    sentences: np.ndarray  # of each text
    group: list[str]

    def word(self, i: int) -> str:
        return "".join(map(chr, self.points[self.start[i] : self.start[i] + self.length[i]].tolist()))

    @classmethod
    def of(cls, texts: list[str | None], langs: list[str | None], window: int = 16) -> "Tokens":
        """A sentence of more than twice ``window`` words or characters without marks is divided
        every ``window``."""
        global _KIND
        if _KIND is None:
            _KIND = _kinds()
        n = len(texts)
        # a line end and a zero close each text
        joined = "".join([clean(t or "").replace("\0", " ") + "\n\0" for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _KIND[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF).tolist():
            c = int(points[i])
            kind[i] = _HAN if 0x20000 <= c <= 0x3134F else _LETTER if chr(c).isalnum() else _OTHER
        in_word = (kind == _LETTER) | (kind == _DIGIT)
        edge = np.flatnonzero(np.diff(in_word, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        han = np.flatnonzero(kind == _HAN)
        # words and Chinese characters in order
        at = np.concatenate((begin, han))
        order = np.argsort(at, kind="stable")
        at, length = at[order], np.concatenate((end - begin, np.ones(len(han), np.int64)))[order]
        is_word = order < len(begin)
        doc = np.cumsum(points == 0, dtype=np.int64)[at]
        mark = np.cumsum(kind == _MARKS, dtype=np.int64)[at]
        new = np.append(True, mark[1:] != mark[:-1])[: len(at)]
        first, run = np.flatnonzero(new), np.cumsum(new) - 1
        place = np.arange(len(at)) - first[run] if len(at) else at
        size = np.diff(np.append(first, len(at)))
        part = np.where(size[run] > 2 * window, place // window, 0) if len(at) else at
        word = word_hashes(points, at[is_word], length[is_word])
        # the language, by the text where it tells, else by the hint
        words, chars = np.bincount(doc[is_word], minlength=n), np.bincount(doc[~is_word], minlength=n)
        names = list(_STOP)
        stops = np.stack([np.bincount(doc[is_word][np.isin(word, _word_hashes(_STOP[g]))], minlength=n) for g in names], 1)
        best = stops.argmax(1)
        tells = stops[np.arange(n), best] * 20 > words
        group = []
        for i, lang in enumerate(langs):
            hint = (lang or "").lower()[:3].split("-")[0]
            hint = _LANG.get(hint, hint)
            if chars[i] > words[i]:
                group.append("zh")
            elif not words[i]:
                group.append("other")
            else:
                group.append(names[best[i]] if tells[i] else hint if hint in GROUPS and hint != "zh" else "other")
        # terms
        whole = np.flatnonzero(is_word)
        good = (length[whole] > 2) & (kind[at[whole]] == _LETTER)
        pair = np.flatnonzero(~is_word[:-1] & ~is_word[1:] & (at[1:] == at[:-1] + 1)) if len(at) else whole
        pairs = (points[at[pair]].astype(np.int64) << 21) | points[at[pair] + 1].astype(np.int64)
        unit = np.concatenate((whole[good], pair))
        order = np.argsort(unit, kind="stable")
        unit, term = unit[order], np.concatenate((word[good], pairs))[order]
        key = run[unit] * (int(part.max(initial=0)) + 1) + part[unit]
        doc = doc[unit]
        fresh = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(unit)]
        count = np.bincount(doc[fresh], minlength=n)
        sentence = np.cumsum(fresh) - 1 - (np.cumsum(count) - count)[doc]
        return cls(doc, sentence, term, at[unit], np.where(is_word[unit], length[unit], 2), points, count, group)


def _word_hashes(words: set[str]) -> np.ndarray:
    listed = sorted(words)
    points = np.frombuffer("".join(listed).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in listed])
    return word_hashes(points, np.cumsum(length) - length, length)


def _each(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Tokens]]:
    """(ids, tokens) of the texts of a batch (id, text, lang), some at a time."""
    for i in range(0, b.num_rows, _TOGETHER):
        c = b.slice(i, _TOGETHER)
        yield c.column(0).to_numpy(zero_copy_only=False), Tokens.of(c.column(1).to_pylist(), c.column(2).to_pylist())


# ---- the vocabulary ----
#: Documents are counted by the logarithm of their number of terms, in steps of a tenth.
_STEP = 1.1


def _counted(docs: DataFrame) -> DataFrame:
    """(grp, term, word, docs, times) of each term in all documents; for the negative terms, how
    many documents of about _STEP ** (-1 - term) terms there are, and their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # term -> word, documents, times, by group
        seen: dict[str, dict[int, list]] = {g: {} for g in GROUPS}

        def out() -> Iterator[pa.RecordBatch]:
            for g, by in seen.items():
                v = list(by.values())
                if v:
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(v), pa.string()), pa.array(list(by), pa.int64()), pa.array([x[0] for x in v], pa.string()), pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.int64())], ["grp", "term", "word", "docs", "times"])
                by.clear()

        for b in batches:
            for _, t in _each(b):
                number = np.array([GROUPS.index(g) for g in t.group])
                lengths = np.bincount(t.doc, minlength=len(number))
                for g in set(t.group):
                    rows = number == GROUPS.index(g)
                    at = np.flatnonzero(rows[t.doc])
                    term, first, inverse, times = np.unique(t.term[at], return_index=True, return_inverse=True, return_counts=True)
                    held = np.unique(t.doc[at] * len(term) + inverse) % max(1, len(term))
                    df = np.bincount(held, minlength=len(term))
                    by = seen[g]
                    for h, f, a, c in zip(term.tolist(), at[first].tolist(), df.tolist(), times.tolist()):
                        if x := by.get(h):
                            x[1] += a
                            x[2] += c
                        else:
                            by[h] = [t.word(f), a, c]
                    bins = -1 - (np.log(np.maximum(1, lengths[rows])) / math.log(_STEP)).astype(np.int64)
                    for h, c in zip(*np.unique(bins, return_counts=True)):
                        x = by.setdefault(int(h), ["", 0, 0])
                        x[1] += int(c)
                        x[2] += int(lengths[rows][bins == h].sum())
                if sum(map(len, seen.values())) > 1_000_000:
                    yield from out()
        yield from out()

    parts = docs.mapInArrow(run, "grp string, term bigint, word string, docs bigint, times bigint")
    return parts.groupBy("grp", "term").agg(F.min("word").alias("word"), F.sum("docs").alias("docs"), F.sum("times").alias("times"))


@dataclass
class Vocabulary:
    term: np.ndarray  # sorted
    word: list[str]


def vocabularies(counts: DataFrame, least: float, clustered: float) -> dict[str, Vocabulary]:
    """The terms of each group that at least ``least`` of its documents (and at least three) hold,
    unless they are spread by chance. Terms of a subject come together in fewer documents: those
    are kept that chance would put in 2 ** ``clustered`` times as many documents of these lengths
    (within a standard error), and those that a document repeats twice as often as by chance
    (beyond five), as those of a subject of a third of the corpus are. What is sent around stays
    bounded: by the terms of an average document over ``least``."""
    lengths: dict[str, list[tuple[int, int]]] = {}
    for r in counts.where("term < 0").collect():  # at most some hundred lengths a group
        lengths.setdefault(r["grp"], []).append((r["docs"], r["times"]))
    few = F.lit(3.0)
    for g, x in lengths.items():
        few = F.when(F.col("grp") == g, max(3.0, least * sum(n for n, _ in x))).otherwise(few)
    kept: dict[str, list[tuple[int, str, int, int]]] = {}
    for r in counts.where((F.col("term") >= 0) & (F.col("docs") >= few)).collect():
        kept.setdefault(r["grp"], []).append((r["term"], r["word"], r["docs"], r["times"]))
    out = {}
    for g, rows in kept.items():
        n, total = (np.array(x, float) for x in zip(*lengths[g]))
        rate = np.array([r[3] for r in rows]) / total.sum()
        expected = sum(a * -np.expm1(-rate * b / a) for a, b in zip(n, total))
        df, tf = (np.array([r[i] for r in rows], float) for i in (2, 3))
        again, error = tf - df, np.sqrt(np.minimum(tf - df, df) + 1) / df / math.log(2)
        tells = (np.log2(expected / df) + error >= clustered) | (again - 5 * np.sqrt(again) >= 2 * (tf - expected))
        listed = sorted(r[:2] for r, x in zip(rows, tells) if x)
        out[g] = Vocabulary(np.array([t for t, _ in listed], np.int64), [w for _, w in listed])
    return {g: v for g, v in out.items() if v.word}


_NUMBERED = "id bigint, grp string, words array<int>, times array<int>, terms array<int>, places array<int>, sentences int"


def _lists(doc: np.ndarray, n: int, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))


def _numbered(docs: DataFrame, vocabulary: dict[str, Vocabulary]) -> DataFrame:
    """Documents by their terms in the vocabulary: each term with its number of times (words,
    times), and all in order with their sentences (terms, places)."""
    shared = docs.sparkSession.sparkContext.broadcast({g: v.term for g, v in vocabulary.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, t in _each(b):
                n = len(ids)
                group = np.array(t.group)
                number = np.full(len(t.term), -1, np.int64)
                for g, known in shared.value.items():
                    of = np.flatnonzero((group == g)[t.doc])
                    at = np.minimum(np.searchsorted(known, t.term[of]), len(known) - 1)
                    number[of] = np.where(known[at] == t.term[of], at, -1)
                keep = number >= 0
                doc, number, place = t.doc[keep], number[keep], t.sentence[keep]
                pair, times = np.unique(doc << 32 | number, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(t.group, pa.string()), _lists(pair >> 32, n, pair & 0xFFFFFFFF), _lists(pair >> 32, n, times), _lists(doc, n, number), _lists(doc, n, place), pa.array(t.sentences, pa.int32())],
                    ["id", "grp", "words", "times", "terms", "places", "sentences"],
                )

    return docs.mapInArrow(run, _NUMBERED)


# ---- the models ----
def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)): with digamma(x) = digamma(x + 2) - 1 / x - 1 / (x + 1), and the series of
    exp(digamma(y + 1/2)) for what is then above 1.5."""
    y = x + x.dtype.type(1.5)
    return (y + 1 / (24 * y) - 37 / (5760 * y * y * y)) * np.exp(-1 / x - 1 / (x + 1))


def topics_of(weight: np.ndarray) -> np.ndarray:
    """exp(E[log phi]) of topics (terms x topics) whose Dirichlet parameters are ``weight``."""
    w = weight.astype(np.float64)
    return (exp_digamma(w) / exp_digamma(w.sum(0, keepdims=True))).astype(np.float32)


def infer(beta: np.ndarray, word: np.ndarray, times: np.ndarray, begin: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(exp(E[log theta]) up to a factor of each document, expected counts of topics of each entry)
    for documents that begin at ``begin`` (each has an entry). The normalizer of a document's
    theta cancels out."""
    p = beta[word]
    row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(word))))
    theta = np.ones((len(begin), beta.shape[1]), np.float32)
    for _ in range(steps):
        x = times / np.maximum(np.einsum("ij,ij->i", p, theta[row]), 1e-30)
        theta = exp_digamma(np.float32(ALPHA) + theta * np.add.reduceat(p * x[:, None], begin, axis=0))
    r = p * theta[row]
    return theta, r * (times / np.maximum(r.sum(1), 1e-30))[:, None]


def _of_group(b: pa.RecordBatch, group: str, columns: list[str], most: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(rows, first entries, values of the list columns) of the documents of a group that have any,
    ``most`` at a time."""
    lists = [b.column(b.schema.get_field_index(c)) for c in columns]
    size = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False)
    is_group = pc.equal(b.column(b.schema.get_field_index("grp")), group).to_numpy(zero_copy_only=False)
    every = np.flatnonzero(is_group & (size > 0))
    for i in range(0, len(every), most):
        rows = every[i : i + most]
        yield rows, np.cumsum(size[rows]) - size[rows], [x.take(pa.array(rows)).flatten().to_numpy() for x in lists]


def _sums(numbered: DataFrame, counts: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[str, np.ndarray]:
    """What ``counts`` makes of each part (grp, float32 counts), added up by group in two levels."""
    parts = numbered.rdd.getNumPartitions()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.frombuffer(x, np.float32)
                total[g] = total[g] + a if g in total else a
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([a.tobytes() for a in total.values()], pa.binary())], ["grp", "counts"])

    sums = numbered.mapInArrow(counts, "grp string, counts binary")
    if parts > 64:
        sums = sums.repartition(math.isqrt(parts)).mapInArrow(add, "grp string, counts binary")
    total: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator() if parts > 4096 else sums.collect():
        a = np.frombuffer(bytes(r["counts"]), np.float32).astype(np.float64)
        total[r["grp"]] = total[r["grp"]] + a if r["grp"] in total else a
    return total


def fit(numbered: DataFrame, sizes: dict[str, int], topics: int, rounds: int = 12, steps: int = 3, seed: int = 42) -> dict[str, np.ndarray]:
    """The Dirichlet parameters of each group's topics (terms x ``topics``), begun at random and
    fitted on all documents in ``rounds`` rounds. A part of the table hands on its expected
    counts (terms x topics, a bounded size); they are added up in two levels, so that the
    driver receives about the square root of their number."""
    spark = numbered.sparkSession
    rng = np.random.default_rng(seed)
    weight = {g: rng.gamma(100.0, 0.01, (sizes[g], topics)) for g in GROUPS if g in sizes}
    numbered = numbered.select("grp", "words", "times")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast({g: topics_of(w) for g, w in weight.items()})

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for b in batches:
                for g, beta in shared.value.items():
                    for _, begin, (word, times) in _of_group(b, g, ["words", "times"]):
                        _, r = infer(beta, word, times.astype(np.float32), begin, steps)
                        s = np.stack([np.bincount(word, r[:, k], len(beta)) for k in range(beta.shape[1])], 1)
                        total[g] = total[g] + s if g in total else s
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([a.astype(np.float32).tobytes() for a in total.values()], pa.binary())], ["grp", "counts"])

        total = _sums(numbered, expect)
        weight = {g: total[g].reshape(w.shape) + ETA if g in total else w for g, w in weight.items()}
        shared.unpersist()
    return weight


# ---- from topics to subjects ----
def telling_terms(numbered: DataFrame, labels: DataFrame, id_col: str, names: list[str], sizes: dict[str, int], lift: float = 3.0, least: int = 2) -> dict[str, np.ndarray]:
    """For each group, which of its terms tell which subject (terms x subjects, 0 or 1): those that
    at least ``least`` labelled documents of the subject hold, a share of them surely ``lift``
    times as large as of the other labelled ones. All labels count; a term tells at most one subject, the
    one where this is strongest."""
    by = labels.select(F.col(id_col).cast("bigint").alias("id"), "subject").where(F.col("subject").isin(names)).distinct().groupBy("id").agg(F.collect_set("subject").alias("named"))
    held = numbered.select("id", "grp", "words").join(by, "id")
    terms = held.select("grp", F.explode("words").alias("term"), "named")
    number = held.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.array_contains("named", s), 1)).alias(f"n{i}") for i, s in enumerate(names)])
    count = terms.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.array_contains("named", s), 1)).alias(f"n{i}") for i, s in enumerate(names)])
    labelled = {r["grp"]: np.array([r["n"], *(r[f"n{i}"] for i in range(len(names)))], float) for r in number.collect()}
    out = {g: np.zeros((v, len(names)), np.float32) for g, v in sizes.items()}
    for r in count.collect():  # at most one row for each term of the vocabularies
        n = labelled[r["grp"]]
        a = np.array([r[f"n{i}"] for i in range(len(names))], float)
        inside, outside = a / np.maximum(1, n[1:]), (r["n"] - a + 0.5) / (n[0] - n[1:] + 1)
        # ``lift`` times as large even with one standard error less
        sure = (a >= least) & ((a - np.sqrt(a)) / np.maximum(1, n[1:]) >= lift * outside)
        best = int(np.argmax(np.where(sure, inside / outside, 0)))
        if sure[best]:
            out[r["grp"]][r["term"], best] = 1
    return out


def map_topics(weight: np.ndarray, telling: np.ndarray, top: int = 20, most: float = 0.5, least: float = 0.2) -> tuple[list[int], list[list[int]]]:
    """(the subject of each topic, or -1; the top terms inspected for it): the subject that at least
    ``least`` of the weight of its ``top`` terms tells, and at least ``most`` of what tells any."""
    phi = weight / weight.sum(0, keepdims=True)
    score = phi * np.log(phi / phi.mean(1, keepdims=True))
    subject, inspected = [], []
    for k in range(phi.shape[1]):
        best = np.argsort(-score[:, k], kind="stable")[:top]
        told = phi[best, k] @ telling[best]
        s = int(told.argmax())
        subject.append(s if told[s] >= max(most * told.sum(), least * phi[best, k].sum()) > 0 else -1)
        inspected.append(best.tolist())
    return subject, inspected


@dataclass
class Fitted:
    """What assigns subjects: fitted topics and what they are about."""

    numbered: DataFrame
    path: str
    vocabulary: dict[str, Vocabulary]
    weight: dict[str, np.ndarray]
    names: list[str]
    subject: dict[str, list[int]]
    inspected: dict[str, list[list[int]]]


def model(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.002, clustered: float = 0.1, per_subject: int = 3, rounds: int = 12, steps: int = 3, seed: int = 42) -> Fitted:
    """Topics fitted to all documents, ``per_subject`` for each subject of ``names``, and mapped to
    the subjects by their top terms and the labelled documents (``labels``: id, subject). See
    :func:`vocabularies`, :func:`fit`, :func:`telling_terms`, :func:`map_topics`."""
    names = sorted({n for n in names if n is not None})
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), text_col, lang_col)
    counts, counts_path = store(_counted(docs), "terms", keep=False)
    vocabulary = vocabularies(counts, least, clustered)
    drop_path(docs.sparkSession, counts_path)
    numbered, path = store(_numbered(docs, vocabulary), "numbered")
    sizes = {g: len(v.word) for g, v in vocabulary.items()}
    if not names or not sizes:
        return Fitted(numbered, path, vocabulary, {}, names, {}, {})
    weight = fit(numbered, sizes, per_subject * len(names), rounds, steps, seed)
    telling = telling_terms(numbered, labels, id_col, names, sizes)
    mapped = {g: map_topics(w, telling[g]) for g, w in weight.items()}
    return Fitted(numbered, path, vocabulary, weight, names, {g: m[0] for g, m in mapped.items()}, {g: m[1] for g, m in mapped.items()})


def topics(fitted: Fitted) -> list[tuple[str, int, str | None, float, str]]:
    """(grp, topic, subject, weight, terms): the fitted topics with their inspected top terms."""
    return [
        (g, k, fitted.names[s] if s >= 0 else None, float(w[:, k].sum()), " ".join(fitted.vocabulary[g].word[i] for i in fitted.inspected[g][k]))
        for g, w in fitted.weight.items()
        for k, s in enumerate(fitted.subject[g])
    ]


def assign(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", share: float = 0.3, sure: float = 0.5, **options: object) -> DataFrame:
    """(id, subject, share): the subjects that at least ``share`` of a document's sentences are
    about; none for a document below it, or with a null, empty or blank text.

    A sentence is about a subject if one of its terms belongs, with a probability of ``sure``
    under the document's topic shares, to topics of the subject. ``options`` are those of
    :func:`model`. Ids are taken to be unique; a repeated one is a document of its own. A
    language group without labelled documents has topics but no subjects; subjects that no
    label names, and labels of other subjects or of unknown documents, change nothing.
    """
    f = model(docs, labels, names, id_col, **options)
    count = len(f.names)
    to = {g: np.eye(count + 1, dtype=np.float32)[np.array(s, int)][:, :count] for g, s in f.subject.items()}
    shared = docs.sparkSession.sparkContext.broadcast({g: (topics_of(w), to[g]) for g, w in f.weight.items()})
    names = f.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            sentences = b.column(b.schema.get_field_index("sentences")).to_numpy(zero_copy_only=False)
            for g, (beta, to) in shared.value.items():
                # entries of the document's words, and all its terms in order
                for (rows, begin, (word, times)), (_, first, (term, place)) in zip(_of_group(b, g, ["words", "times"]), _of_group(b, g, ["terms", "places"])):
                    theta, _ = infer(beta, word, times.astype(np.float32), begin, 8)
                    doc = np.repeat(np.arange(len(rows)), np.diff(np.append(first, len(term))))
                    r = beta[term] * theta[doc]
                    token, about = np.nonzero((r @ to) >= sure * r.sum(1, keepdims=True))
                    hit = np.unique(np.stack((doc[token], about, place[token])), axis=1)
                    part = np.zeros((len(rows), len(names)))
                    np.add.at(part, (hit[0], hit[1]), 1)
                    part /= np.maximum(1, sentences[rows])[:, None]
                    i, j = np.nonzero(part >= share)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows[i]]), pa.array([names[x] for x in j], pa.string()), pa.array(part[i, j])], [id_col, "subject", "share"])

    return f.numbered.select("id", "grp", "words", "times", "terms", "places", "sentences").mapInArrow(run, f"`{id_col}` bigint, subject string, share double")
