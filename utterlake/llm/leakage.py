"""Evaluation passages that leak into a corpus.

Every document looks up its character q-grams among those of the items (a small table, sent
to the tasks in blocks of bounded size). Hits are counted in overlapping diagonal bands of
each (document, item); by the q-gram lemma a passage with few slips leaves a known number
of q-grams in a band. Retained bands are verified by banded local alignment of units (words,
or characters of Chinese), all candidates of a batch together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm.common import word_hashes

#: Most characters of items sent to the tasks at once; more items are searched in blocks.
BLOCK_CHARS = 4_000_000
#: Characters of documents handled together.
BATCH_CHARS = 1_000_000
# q-grams with a Chinese character, and others
Q_HAN, Q_WORD = 5, 12
BAND = 16
#: Units by which the path of a passage may leave the diagonals of its hits.
SLACK = 8

_MARK = regex.compile(r"[\[(<]\s*\d{1,2}(?::\d{2}){1,2}(?:[.,]\d+)?\s*[\])>]|^\s*\d{1,2}(?::\d{2}){1,2}(?:[.,]\d+)?\s", regex.M)
_SPEAKER = regex.compile(r"^\s*(?:[A-Z]|spk\s?\d+|speaker\s?\w{1,3}|sprecher\s?\w{1,3}|说话人\s?\w{1,3}|發言人\s?\w{1,3})\s*[:：]", regex.M | regex.I)
_APOSTROPHE = re.compile(r"(?<=\w)['’](?=\w)")
_UNIT = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]|[^\W_㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f]+")
_INVISIBLE = regex.compile(r"[\p{Cf}︀-️]")
# Texts of these characters need no normal form.
_PLAIN = re.compile("[\x09\x0a\x0d\x20-\x7e一-鿿。、，！？；：À-ÖØ-öø-ÿ¿¡]*")


def units(text: str | None) -> list[str]:
    """Words, and single characters of Chinese, without case, width, punctuation, invisible
    characters, and marks of time and speaker."""
    if not text:
        return []
    if not text.isascii() and not _PLAIN.fullmatch(text):
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if ":" in text or "：" in text:
        text = _SPEAKER.sub(" ", _MARK.sub(" ", text.replace("：", ":")))
    text = text.lower()
    return _UNIT.findall(_APOSTROPHE.sub("", text) if "'" in text or "’" in text else text)


def _is_han(points: np.ndarray) -> np.ndarray:
    return ((points >= 0x3400) & (points <= 0x9FFF)) | ((points >= 0xF900) & (points <= 0xFAFF)) | ((points >= 0x20000) & (points <= 0x3134F))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    return h ^ (h >> np.uint64(29))


def _joined(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of what stands at each place and ``apart`` places on."""
    m = max(0, len(a) - apart)
    return _mixed(a[:m], b[apart:])


@dataclass
class Flat:
    """Texts as one run of code points and one run of units."""

    points: np.ndarray  # code points
    text_of: np.ndarray  # text of each code point
    unit_of: np.ndarray  # unit (counted over all texts) of each code point
    unit_start: np.ndarray  # first code point of each unit
    first_unit: np.ndarray  # first unit of each text, and the end
    first_point: np.ndarray  # first code point of each text, and the end

    @classmethod
    def of(cls, texts: list[list[str]]) -> "Flat":
        words = [w for t in texts for w in t]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first_unit = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        first_point = ends[first_unit]
        return cls(points, np.repeat(np.arange(len(texts)), np.diff(first_point)), np.repeat(np.arange(len(words)), lengths), ends[:-1], first_unit, first_point)

    def numbers(self) -> np.ndarray:
        """A 62-bit number of each unit."""
        return word_hashes(self.points, self.unit_start, np.diff(np.append(self.unit_start, len(self.points))))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of every q-gram within one text."""
        n = len(self.points)
        han = np.concatenate(([0], np.cumsum(_is_han(self.points))))
        # hashes of 4 characters by doubling; one of Q_HAN = 4 + 1 or Q_WORD = 4 + 4 + 4 is made of them
        one = self.points.astype(np.uint64)
        four = _joined(_joined(one, one, 1), _joined(one, one, 1), 2)
        places, hashes = [], []
        for q, want in ((Q_HAN, True), (Q_WORD, False)):
            if n < q:
                continue
            m = n - q + 1
            at = np.flatnonzero((self.text_of[:m] == self.text_of[q - 1 :]) & ((han[q:] - han[:m] > 0) == want))
            if q == Q_HAN:
                h = _mixed(four[at], one[at + 4])
            else:
                h = _mixed(_mixed(four[at], four[at + 4]), four[at + 8])
            places.append(at)
            hashes.append(h * np.uint64(0xBF58476D1CE4E5B9))
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.concatenate(places), np.concatenate(hashes)


class Items:
    """The index of a block of items."""

    def __init__(self, ids: list[int], texts: list[list[str]], least_words: int, least_chars: int, slip: float) -> None:
        self.ids, self.flat = np.array(ids, np.int64), Flat.of(texts)
        f = self.flat
        self.known, self.unit = np.unique(f.numbers(), return_inverse=True)
        place, h = f.grams()
        grams = np.sort(place)
        order = np.argsort(h, kind="stable")
        self.place, h = place[order], h[order]
        self.hash, self.begin = np.unique(h, return_index=True)
        self.end = np.append(self.begin[1:], len(h))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True
        chars = np.diff(f.first_point)
        han = np.concatenate(([0], np.cumsum(_is_han(f.points))))
        self.han = (han[f.first_point[1:]] - han[f.first_point[:-1]]) * 2 > chars
        self.least = np.where(self.han, least_chars, least_words)
        self.longest = int(chars.max(initial=0))
        # characters of the widest unit
        self.widest = np.array([max(map(len, t), default=0) for t in texts], np.int64)
        self.bound, self.width = self._bounds(grams, slip)

    def _bounds(self, grams: np.ndarray, slip: float) -> tuple[np.ndarray, np.ndarray]:
        """The q-gram lemma for each item's own letters: how many grams its shortest passages keep
        at least when the units that touch most of them are changed, and the most characters
        that one of these passages has."""
        f = self.flat
        ends = np.append(f.unit_start, len(f.points))
        # a gram with a Chinese character has Q_HAN characters, another one Q_WORD
        han = np.concatenate(([0], np.cumsum(_is_han(f.points))))
        is_han = han[np.minimum(grams + Q_HAN, len(f.points))] > han[grams]
        kinds = [(q, np.concatenate(([0], np.cumsum(np.bincount(g, minlength=len(f.points)))))) for q, g in ((Q_HAN, grams[is_han]), (Q_WORD, grams[~is_han]))]
        touched = sum(n[ends[1:]] - n[np.maximum(0, ends[:-1] - q + 1)] for q, n in kinds)
        out, width = np.empty(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        for i, least in enumerate(self.least):
            a, b = f.first_unit[i], f.first_unit[i + 1]
            # the passages: from each unit to the first with which the length is reached
            last = np.searchsorted(ends[: b + 1], ends[a:b] + least) if self.han[i] else np.arange(a, b) + least
            first = np.arange(a, b)[last <= b]
            last = last[last <= b]
            if not len(first):
                out[i] = np.iinfo(np.int64).max  # shorter than any passage
                continue
            whole = sum(np.maximum(0, n[np.maximum(ends[last] - q + 1, ends[first])] - n[ends[first]]) for q, n in kinds)
            units = first[:, None] + np.arange((last - first).max())
            cost = np.where(units < last[:, None], touched[np.minimum(units, len(touched) - 1)], 0)
            slips = min(int(1.5 * slip * least), cost.shape[1])
            out[i] = (whole - np.sort(cost, axis=1)[:, cost.shape[1] - slips :].sum(1)).min()
            width[i] = (ends[last] - ends[first]).max()
        return out, width


def _align(items: Items, unit_of_doc: np.ndarray, first: np.ndarray, end: np.ndarray, item: np.ndarray, shift: np.ndarray, half: int, miss: int) -> tuple[np.ndarray, ...]:
    """Best local alignment of each candidate within ``half`` units of the diagonal ``shift``:
    (score, first unit of the item, end, first unit of the document, end). A match counts 1, a
    unit changed, added or dropped -``miss``. Scores carry the start of their path in their low
    bits, so that a maximum takes it along."""
    f = items.flat
    low = np.int64(1) << 42
    c = len(item)
    i0, n = f.first_unit[item], np.diff(f.first_unit)[item]
    k = np.arange(2 * half + 1)
    gap = (miss * k).astype(np.int64) * low
    row = np.full((c, 2 * half + 3), -low * 1000, np.int64)
    best = np.zeros(c, np.int64)
    at_i, at_j = np.zeros(c, np.int64), np.zeros(c, np.int64)
    last = len(unit_of_doc) - 1
    for i in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > i)
        j = (first[live] + shift[live] + i - half)[:, None] + k
        inside = (j >= first[live][:, None]) & (j < end[live][:, None])
        same = (unit_of_doc[np.clip(j, 0, last)] == items.unit[i0[live] + i][:, None]) & inside
        old = row[live]
        # a path may begin here; it remembers where
        local = np.clip(j - first[live][:, None] + 1, 0, (1 << 30) - 1)
        start = (np.int64(i) << 30) | local
        through = np.where(old[:, 1:-1] >= low, old[:, 1:-1], start)
        cell = np.where(same, through + low, through - miss * low)
        cell = np.maximum(cell, old[:, 2:] - miss * low)  # a unit of the item is missing
        cell = np.maximum.accumulate(cell + gap, axis=1) - gap  # units of the document are added
        new = old
        new[:, 1:-1] = cell
        row[live] = new
        top = cell.argmax(axis=1)
        value = cell[np.arange(len(live)), top]
        better = (value >> 42) > (best[live] >> 42)
        w = live[better]
        best[w] = value[better]
        at_i[w] = i + 1
        at_j[w] = j[np.arange(len(live)), top][better] - first[w] + 1
    begun = best & (low - 1)
    return best >> 42, begun >> 30, at_i, (begun & ((1 << 30) - 1)) - 1, at_j


def _edge(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """For 0 to ``most`` slips, how many units of a and of b an alignment from their beginnings
    takes that ends with a match; the longest in a."""
    far = {0: 0}  # places by diagonal (place in b - place in a), as far as they get
    out, best = [], (0, 0)
    for e in range(most + 1):
        if e:
            new: dict[int, int] = {}
            for k, x in far.items():
                for k2, x2 in ((k, x + 1), (k + 1, x), (k - 1, x + 1)):
                    if x2 <= len(a) and 0 <= x2 + k2 <= len(b):
                        new[k2] = max(new.get(k2, -1), x2)
            far = new
        for k, x in far.items():
            y = x
            while y < len(a) and y + k < len(b) and a[y] == b[y + k]:
                y += 1
            if y > x and y > best[0]:
                best = (y, y + k)
            far[k] = y
        out.append(best)
    return out


def _reaches(a: np.ndarray, starts: np.ndarray | None, b: np.ndarray, i0: int, i1: int, j0: int, j1: int, errors: float, least: int, rate: float) -> bool:
    """Whether the passage a[i0:i1], found as b[j0:j1], reaches the length ``least`` when it is
    carried on over slips at its edges to a further match, with at most ``rate`` errors a unit.
    A slip that no match follows cannot be told from other text and does not count. With
    ``starts``, first characters of the units, the length is that in characters."""
    most = int(rate * (i1 - i0 + least) - errors)
    if most < 1:
        return False
    margin = 4 * (least + most)
    left = _edge(a[max(0, i0 - margin) : i0][::-1], b[max(0, j0 - margin) : j0][::-1], most)
    right = _edge(a[i1 : i1 + margin], b[j1 : j1 + margin], most)
    for e in range(most + 1):
        for r in range(most + 1 - e):
            first, last = i0 - left[e][0], i1 + right[r][0]
            steps = max(last - first, j1 + right[r][1] - j0 + left[e][1])
            length = last - first if starts is None else starts[last] - starts[first]
            if length >= least and errors + e + r <= rate * steps:
                return True
    return False


def _search(items: Items, texts: list[list[str]], slip: float, miss: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) of every passage found."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    doc = Flat.of(texts)
    place, h = doc.grams()
    maybe = items.bits[(h >> np.uint64(42)).astype(np.int64)]
    place, h = place[maybe], h[maybe]
    at = np.searchsorted(items.hash, h)
    known = at < len(items.hash)
    known[known] = items.hash[at[known]] == h[known]
    place, at = place[known], at[known]
    if not len(place):
        return none
    count = items.end[at] - items.begin[at]
    begins = np.cumsum(count) - count
    ours = np.repeat(place, count)
    theirs = items.place[np.repeat(items.begin[at] - begins, count) + np.arange(count.sum())]
    d, it = doc.text_of[ours], items.flat.text_of[theirs]
    diagonal = (ours - doc.first_point[d]) - (theirs - items.flat.first_point[it]) + items.longest
    shift = (doc.unit_of[ours] - doc.first_unit[d]) - (items.flat.unit_of[theirs] - items.flat.first_unit[it])
    slots = int(diagonal.max()) // BAND + 3
    key = (d * len(items.ids) + it) * slots + diagonal // BAND
    order = np.argsort(key, kind="stable")
    key, shift, theirs = key[order], shift[order], theirs[order]
    bands, begin, hits = np.unique(key, return_index=True, return_counts=True)
    # overlapping bands: each with the next one
    follows = np.append(bands[1:] == bands[:-1] + 1, False)
    both = hits + np.where(follows, np.append(hits[1:], 0), 0)
    pair = bands // slots
    least = np.maximum(1, items.bound[pair % len(items.ids)])
    keep = both >= least
    # of bands in a row with the same hits the first is enough
    keep[1:] &= ~((bands[1:] == bands[:-1] + 1) & (both[1:] == hits[1:]) & keep[:-1])
    # the hits of retained bands, by their places in the item: a passage leaves that many within
    # the width of one passage, where hits from all over the item can be more
    kept = np.flatnonzero(keep)
    begin, both, least, pair = begin[kept], both[kept], least[kept], pair[kept]
    first = np.cumsum(both) - both
    band = np.repeat(np.arange(len(kept)), both)
    hit = np.repeat(begin - first, both) + np.arange(both.sum())
    order = np.lexsort((theirs[hit], band))
    hit = hit[order]
    at = np.arange(len(hit)) + least[band] - 1
    inside = at < (first + both)[band]
    at[~inside] = 0
    inside &= theirs[hit[at]] - theirs[hit] <= items.width[pair % len(items.ids)][band]
    keep = np.bincount(band[inside], minlength=len(kept)) > 0
    if not keep.any():
        return none
    # the diagonals of units from the least to the greatest of each band's hits
    low = np.minimum.reduceat(shift[hit], first)[keep]
    high = np.maximum.reduceat(shift[hit], first)[keep]
    d, it, mean, strong = pair[keep] // len(items.ids), pair[keep] % len(items.ids), (low + high) // 2, both[keep]
    # with what slips may move the path, in steps of 8, so that bands of like width go together
    half = ((high - low + 1) // 2 + SLACK + 7) // 8 * 8
    # units of the documents as those of the items, -1 for others
    h = doc.numbers()
    at = np.minimum(np.searchsorted(items.known, h), len(items.known) - 1)
    own = np.where(items.known[at] == h, at, -1)
    # the strongest band of each pair first; the others only where it holds no passage
    order = np.lexsort((-strong, it, d))
    new = np.append(True, (d[order][1:] != d[order][:-1]) | (it[order][1:] != it[order][:-1]))
    found = np.zeros(0, np.int64)
    found_d, found_i = [], []
    for turn in (order[new], order[~new]):
        turn = turn[~np.isin(d[turn] * len(items.ids) + it[turn], found)]
        for w in np.unique(half[turn]):
            of = turn[half[turn] == w]
            for lo in range(0, len(of), 4096):
                ok = _holds(items, doc, own, d[of[lo : lo + 4096]], it[of[lo : lo + 4096]], mean[of[lo : lo + 4096]], int(w), slip, miss)
                found_d.append(d[of[lo : lo + 4096]][ok])
                found_i.append(it[of[lo : lo + 4096]][ok])
        found = np.concatenate(found_d) * len(items.ids) + np.concatenate(found_i) if found_d else found
    pairs = np.unique(np.stack((np.concatenate(found_d), np.concatenate(found_i)), 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _holds(items: Items, doc: Flat, own: np.ndarray, d: np.ndarray, it: np.ndarray, mean: np.ndarray, half: int, slip: float, miss: int) -> np.ndarray:
    """Whether the band of each (document, item) holds a passage."""
    score, i_from, i_to, j_from, j_to = _align(items, own, doc.first_unit[d], doc.first_unit[d + 1], it, mean, half, miss)
    f = items.flat
    i0 = f.first_unit[it]
    starts = np.append(f.unit_start, len(f.points))
    chars = starts[i0 + i_to] - starts[i0 + i_from]
    span = np.where(items.han[it], chars, i_to - i_from)
    steps = np.maximum(i_to - i_from, j_to - j_from)
    # score = matches - miss * errors over about ``steps`` units
    errors = (steps - score) / (1 + miss)
    least = items.least[it]
    ok = (span >= least) & (errors <= 1.5 * slip * steps)
    # each slip at an edge takes up to ``miss`` units of the passage along; with the slips
    # that the shortest passage may have, these could still reach its length. Carried on they
    # are held to ``slip`` itself: beyond it phrases that many texts use begin to match
    lost = np.floor(1.5 * slip * least) * (1 + miss)
    units_short = np.where(items.han[it], (least - span) / np.maximum(1, items.widest[it]), least - span)
    for x in np.flatnonzero((span < least) & (score > 0) & (units_short <= lost)):
        i, o = it[x], doc.first_unit[d[x]]
        ok[x] = _reaches(
            items.unit[f.first_unit[i] : f.first_unit[i + 1]], starts[f.first_unit[i] : f.first_unit[i + 1] + 1] if items.han[i] else None, own[o : doc.first_unit[d[x] + 1]],
            i_from[x], i_to[x], j_from[x], j_to[x], float(errors[x]), int(least[x]), slip + 1e-9,
        )
    return ok


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least_words: int = 20, least_chars: int = 30, slip: float = 0.1) -> DataFrame:
    """(doc_id, item_id), distinct: documents holding a passage of the item of at least
    ``least_words`` words (``least_chars`` characters in Chinese) in the item's order, of which
    about a ``slip``-th may be changed, added or dropped. It begins and ends with units that are
    the same in both.

    Case, punctuation, spacing, width and marks of time and speaker do not matter. Null, blank
    and too short texts match nothing; repeated documents or items count once by their ids.
    Items are taken to be few: they go to the tasks in blocks of at most BLOCK_CHARS
    characters, each searched over all documents.
    """
    spark = docs.sparkSession
    blocks: list[tuple[list[int], list[list[str]]]] = []
    size = BLOCK_CHARS
    for r in items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).toLocalIterator():
        u = units(r[1])
        n = sum(map(len, u))
        if not u:
            continue
        if size + n > BLOCK_CHARS:
            blocks.append(([], []))
            size = 0
        blocks[-1][0].append(r[0])
        blocks[-1][1].append(u)
        size += n
    schema = f"`{doc_id}` bigint, `{item_id}` bigint"
    out = spark.createDataFrame([], schema)
    for ids, texts in blocks:
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Items(*shared.value, least_words, least_chars, slip)
            for b in batches:
                ids, part, size = b.column(0).to_numpy(zero_copy_only=False), [], 0
                begin = 0
                for i, t in enumerate(b.column(1).to_pylist()):
                    part.append(units(t))
                    size += len(t or "")
                    if size >= BATCH_CHARS or i == b.num_rows - 1:
                        d, it = _search(index, part, slip)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[begin + d]), pa.array(index.ids[it])], [doc_id, item_id])
                        part, size, begin = [], 0, i + 1

        out = out.unionByName(docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, schema))
    return out.distinct()
