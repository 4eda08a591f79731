"""Names among the tokens of many texts at once: arrays of tokens, contexts as numbers.

Tokens are words, single Chinese characters, numbers and marks. A word is known by a number
made of its lower case, a context (the tokens next to a place, up to a mark) by one made of
those of its tokens; all numbers are one word, and marks have 0. What is found is decided
from the whole corpus (see pii.py).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from utterlake.llm import pii_scan as scan_
from utterlake.llm.common import word_hashes

_SPACE, _LETTER, _DIGIT, _HAN, _MARK = range(5)
#: What closes contexts.
MARK = _MARK
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    kind = np.full(0x10000, _MARK, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isspace():
            kind[i] = _SPACE
        elif c.isdecimal():
            kind[i] = _DIGIT
        elif c.isalnum():
            kind[i] = _LETTER
    kind[0x3400:0x4DC0] = kind[0x4E00:0xA000] = _HAN
    return kind


_KIND: np.ndarray | None = None


def number(word: str) -> int:
    """The number of one word in lower case."""
    return int(word_hashes(np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32), np.array([0]), np.array([len(word)]))[0])


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of two tokens in this order."""
    h = a.astype(np.uint64) * _MULT + b.astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) >> np.uint64(1)).astype(np.int64)


def context_number(context: str) -> int:
    """The number of a context of one or two tokens in words; 0 for one that a mark or an end closes
    at once."""
    if context in ("^", "$"):
        return 0
    t = [np.array([number(x)]) for x in context.split(" ")[-2:]]
    return int(t[0][0]) if len(t) == 1 else int(pair(*t)[0])


def _set(words: object) -> np.ndarray:
    return np.array(sorted(number(w) for w in words), np.int64)


def _in(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


@dataclass
class _Lists:
    """The fixed values of pii_scan as numbers."""

    titles: np.ndarray
    digit: int
    surname: np.ndarray  # code points
    double: np.ndarray  # pairs of code points
    han_title: np.ndarray
    spoken: np.ndarray
    at: np.ndarray
    dot: np.ndarray
    street: np.ndarray
    counted: np.ndarray
    han_digit: np.ndarray

    @classmethod
    def make(cls) -> "_Lists":
        two = lambda words: np.array(sorted(ord(w[0]) << 21 | ord(w[1]) for w in words), np.int64)
        one = lambda chars: np.array(sorted(map(ord, chars)), np.int64)
        streets = {x.strip("/") for x in (scan_.STREETS_EN + "|" + scan_.STREETS_ES).split("|")}
        return cls(
            _set(scan_.TITLES), number("0"), one(scan_.SURNAMES), two(scan_.DOUBLE_SURNAMES), two(scan_.HAN_TITLES.split("|")), _set(scan_.DIGIT_WORDS), _set(["at", "ät", "arroba"]), _set(["dot", "punkt", "punto"]),
            _set(streets), _set([*scan_.ONES.split("|"), *scan_.TENS.split("|"), "hundred"]), one(scan_.HAN_DIGITS),
        )


_LISTS: _Lists | None = None


@dataclass
class Sketch:
    """Numbers of a set in bits, sixteen or more for each; may hold more, never less. What it lets
    through is decided by an exact join."""

    bits: np.ndarray  # bytes

    def has(self, numbers: np.ndarray) -> np.ndarray:
        at = numbers & (len(self.bits) * 8 - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Known:
    """What earlier rounds found: name tokens, contexts of names left and right, and contexts after
    which numbers and addresses stand."""

    tokens: Sketch
    lefts: Sketch
    rights: Sketch
    opens: Sketch


@dataclass
class Names:
    """Mentions of names: first token, token after the last, whether it is a seed, tokens (0: none)."""

    form: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    seed: np.ndarray
    tokens: np.ndarray


class Batch:
    def __init__(self, texts: list[str]) -> None:
        global _KIND, _LISTS
        if _KIND is None:
            _KIND, _LISTS = _kinds(), _Lists.make()
        self.lists = _LISTS
        self.folded = [scan_.fold(t.replace("\0", " ") if "\0" in t else t) for t in texts]
        plain = [f.text for f in self.folded]
        low = [t.lower() for t in plain]
        low = [b if len(a) == len(b) else "".join(c.lower() if len(c.lower()) == 1 else c for c in a) for a, b in zip(plain, low)]
        # a zero, which is a mark, closes each text
        read = lambda parts: np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points, points = read(plain), read(low)
        self.text_start = np.cumsum([0, *(len(t) + 1 for t in plain)])[:-1]
        kind = _KIND[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF).tolist():
            c = chr(int(points[i]))
            kind[i] = _DIGIT if c.isdecimal() else _LETTER if c.isalnum() else _SPACE if c.isspace() else _MARK
        # an apostrophe or hyphen between letters belongs to the word
        joins = np.flatnonzero((points == 0x27) | (points == 0x2019) | (points == 0x2D))
        joins = joins[(joins > 0) & (joins < len(kind) - 1)]
        kind[joins[(kind[joins - 1] == _LETTER) & (kind[joins + 1] == _LETTER)]] = _LETTER
        edge = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == _HAN) | (kind[1:] == _MARK))[: len(kind)]
        start = np.flatnonzero(edge)
        stop = np.append(start[1:], len(kind))
        solid = kind[start] != _SPACE
        self.start, self.stop = start[solid], stop[solid]
        self.kind = kind[self.start]
        self.char = points[self.start].astype(np.int64)
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        n = len(self.start)
        self.hash = np.zeros(n, np.int64)
        has = (self.kind == _LETTER) | (self.kind == _HAN)
        self.hash[has] = word_hashes(points, self.start[has], (self.stop - self.start)[has])
        self.hash[self.kind == _DIGIT] = self.lists.digit
        # padding, so that places near the ends need no care
        self._padded = np.concatenate((np.zeros(4, np.int64), self.hash, np.zeros(5, np.int64)))
        self._letters = np.flatnonzero(self.kind == _LETTER)

    # ---- contexts ----
    def _side(self, at: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The four tokens next to places, nearest first; 0 from the first mark on."""
        w = [self._padded[at + 4 + (k if right else -1 - k)] for k in range(4)]
        for k in range(1, 4):
            w[k] = np.where(w[k - 1] != 0, w[k], 0)
        return tuple(w)

    def contexts(self, at: np.ndarray, right: bool, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whole context, the two tokens next to the place, the pair that tells how often the whole
        one may stand) at tokens ``at``: before them, or with ``right`` from them on. A ``wide``
        context has up to four tokens, another one two."""
        a, b, c, d = self._side(at, right)
        order = pair if right else (lambda x, y: pair(y, x))
        near = np.where(b != 0, order(a, b), a)
        if not wide:
            return near, near, near
        # the second and third token of the context as it reads
        inner = np.where(d != 0, order(b, c), np.where(c != 0, order(b, c) if right else order(a, b), near))
        far = np.where(d != 0, order(c, d), c)
        return np.where(c != 0, order(near, far), near), near, inner

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(number, how often): of each token and of each two next to each other."""
        h = self.hash
        two = np.flatnonzero((h[1:] != 0) & (h[:-1] != 0))
        return np.unique(np.concatenate((h[h != 0], pair(h[two], h[two + 1]))), return_counts=True)

    # ---- names ----
    def _gap(self, i: np.ndarray) -> np.ndarray:
        """Whether white space stands before tokens."""
        return self.start[i] > self.stop[i - 1]

    def _next(self, i: np.ndarray) -> np.ndarray:
        return np.minimum(i, len(self.start) - 1)

    def names(self, known: Known | None) -> tuple[Names, Names]:
        """Latin and Chinese mentions: titled words and pairs of capitalised words; with ``known`` also
        pairs of words, and Chinese characters, that known tokens or contexts point to."""
        return self._latin(known), self._han(known)

    def _latin(self, known: Known | None) -> Names:
        out: list[tuple] = []
        none = np.zeros(0, np.int64)
        if not len(self._letters):
            return Names(np.zeros(0, object), none, none, none.astype(bool), np.zeros((0, 3), np.int64))
        size = self.stop - self.start
        word = self.kind == _LETTER
        title = np.zeros(len(word), bool)
        title[self._letters] = _in(self.hash[self._letters], self.lists.titles)
        first = self.points[self.start].astype(np.int64)
        upper = np.zeros(len(word), bool)
        upper[self._letters] = first[self._letters] != self.char[self._letters]  # its lower case differs
        before = np.where(self.start > 0, self.points[np.maximum(0, self.start - 1)], 0)
        after = self.points[np.minimum(self.stop, len(self.points) - 1)]
        point = self.char == ord(".")
        nxt = self._next
        token = known.tokens.has(self.hash) if known else np.zeros(len(word), bool)

        # titles: one, a point, an initial with a point, a word, and maybe another
        i = np.flatnonzero(title & (before != ord(".")) & (before != ord("_")) & ~((before >= 0x30) & (before <= 0x39)))
        j = nxt(i + 1)
        j = np.where(point[j] & ~self._gap(j), nxt(j + 1), j)
        initial = word[j] & (size[j] == 1) & point[nxt(j + 1)] & self._gap(j) & ~self._gap(nxt(j + 1))
        j = np.where(initial, nxt(j + 2), j)
        ok = (j > i) & word[j] & (size[j] > 1) & ~title[j] & self._gap(j) & (self.text[j] == self.text[i])
        i, j = i[ok], j[ok]
        shouted = np.array([self.points[a:b].tobytes().decode("utf-32-le", "surrogatepass").isupper() and b - a > 3 for a, b in zip(self.start[i], self.stop[i])], bool)
        capital = upper[j] & ~shouted
        v = nxt(j + 1)
        second = word[v] & (v > j) & self._gap(v)
        with_v = second & (upper[v] & capital | token[v] & token[j])
        keep = np.ones(len(i), bool) if known else capital
        titled = j
        out.append(("title", i[keep], (j + 1 + with_v)[keep], capital[keep], [self.hash[j][keep], none, none]))

        # pairs of capitalised words, maybe with a comma and an initial between
        big = word & upper & (size > 1)
        inner = np.zeros(len(word), np.int64)
        b = np.flatnonzero(big)
        if len(b):
            # capitals inside a word but after a hyphen, and apostrophes, make it no first name
            p = self.points
            odd = ((p >= 0x41) & (p <= 0x5A) & (np.append(0, p[:-1]) != 0x2D)) | (p == 0x27) | (p == 0x2019)
            total = np.concatenate(([0], np.cumsum(odd)))
            inner[b] = total[self.stop[b]] - total[self.start[b] + 1]
        i = np.flatnonzero(big & (inner == 0) & ~title & ~np.isin(before, [ord("."), ord("@"), ord("_"), *range(0x30, 0x3A)]))
        i = i[~np.isin(i, titled)]
        j = nxt(i + 1)
        j = np.where((self.char[j] == ord(",")) & ~self._gap(j), nxt(j + 1), j)
        letter = word[j] & upper[j] & (size[j] == 1) & self._gap(j)
        k = nxt(j + 1)
        k = np.where(point[k] & ~self._gap(k), nxt(k + 1), k)
        j = np.where(letter, k, j)
        ok = (j > i) & big[j] & self._gap(j) & (self.text[j] == self.text[i]) & ~np.isin(after[j], [ord("@"), ord("_"), *range(0x30, 0x3A)])
        i, j = i[ok], j[ok]
        out.append(("capitals", i, j + 1, np.zeros(len(i), bool), [self.hash[i], self.hash[j], none]))

        if known:
            words = word & (size > 1) & ~title
            i = np.flatnonzero(words)
            j = nxt(i + 1)
            comma = self.char[j] == ord(",")
            letter = ~comma & word[j] & (size[j] == 1)
            k = nxt(j + 1)
            k = np.where(letter & point[k], nxt(k + 1), k)
            j = np.where(comma | letter, k, j)
            ok = words[j] & (j > i) & (self.text[j] == self.text[i])
            i, j = i[ok], j[ok]
            both = token[i] & token[j]
            held = both.copy()
            rest = np.flatnonzero(~both)
            left, right = self.contexts(i[rest], False, False)[0], self.contexts(j[rest] + 1, True, False)[0]
            held[rest] = (left != 0) & known.lefts.has(left) | (right != 0) & known.rights.has(right)
            for form, of in (("pair", both), ("context", held & ~both)):
                out.append((form, i[of], j[of] + 1, np.zeros(int(of.sum()), bool), [self.hash[i[of]], self.hash[j[of]], none]))
        return self._joined(out)

    def _joined(self, parts: list[tuple]) -> Names:
        fill = lambda x, n: x if len(x) == n else np.zeros(n, np.int64)
        return Names(
            np.concatenate([np.full(len(b), f, object) for f, b, *_ in parts]),
            np.concatenate([b for _, b, *_ in parts]),
            np.concatenate([e for _, _, e, *_ in parts]),
            np.concatenate([s for *_, s, _ in parts]),
            np.concatenate([np.stack([fill(t, len(b)) for t in ts], 1) for _, b, _, _, ts in parts]),
        )

    def _han(self, known: Known | None) -> Names:
        out: list[tuple] = []
        none = np.zeros(0, np.int64)
        lists, nxt = self.lists, self._next
        han = self.kind == _HAN
        n = len(han)
        # character pairs without a gap
        close = np.append(han[1:] & han[:-1] & (self.start[1:] == self.stop[:-1]), False)[:n]
        two = np.where(close, self.char << 21 | self.char[nxt(np.arange(n) + 1)], -1)
        at = np.flatnonzero(close)
        double, title = np.zeros(n + 3, bool), np.zeros(n + 3, bool)
        double[at], title[at] = _in(two[at], lists.double), _in(two[at], lists.han_title)
        single = np.zeros(n + 3, bool)
        at = np.flatnonzero(han)
        single[at] = _in(self.char[at], lists.surname)
        inside = np.append(False, double[:-1])  # the second half of a double surname
        seed_of = lambda x: np.ones(len(x), bool)
        open_of = lambda x: np.zeros(len(x), bool)

        def surname(a: np.ndarray) -> np.ndarray:
            return np.where(double[a], pair(self.hash[a], self.hash[nxt(a + 1)]), self.hash[a])

        a = np.flatnonzero((double | single & ~inside)[:n])
        b = a + 1 + double[a]
        ahead = b < n
        linked = close[np.minimum(b, n) - 1] & ahead if n else ahead
        a, b = a[linked], b[linked]
        with_title = title[b]
        x, y = a[with_title], b[with_title]
        # the title is the second token: the share of its occurrences after surnames speaks too
        out.append(("han_title", x, y + 2, seed_of(x), [surname(x), pair(self.hash[y], self.hash[nxt(y + 1)]), none]))
        if known:
            a, b = a[~with_title], b[~with_title]
            padded = np.append(known.tokens.has(self.hash) & (self.hash != 0), np.zeros(3, bool))
            adjacent = np.append(close, np.zeros(3, bool))

            def left_known(x: np.ndarray) -> np.ndarray:
                whole, near, _ = self.contexts(x, False, True)
                return (whole != 0) & (known.lefts.has(whole) | known.lefts.has(near))

            def right_known(x: np.ndarray) -> np.ndarray:
                whole, near, _ = self.contexts(np.minimum(x, n), True, True)
                return (whole != 0) & (known.rights.has(whole) | known.rights.has(near))

            hold, near = left_known(a), padded[b]
            longer = adjacent[b]
            ok = longer & (hold | near & padded[b + 1] | right_known(b + 2))
            out.append(("han", a[ok], b[ok] + 2, open_of(a[ok]), [surname(a[ok]), self.hash[b[ok]], self.hash[nxt(b[ok] + 1)]]))
            ok = hold | near | right_known(b + 1)
            out.append(("han", a[ok], b[ok] + 1, open_of(a[ok]), [surname(a[ok]), self.hash[b[ok]], none]))

            # other first characters, where the next ones stand in known names: a context or a
            # title must point there, and the share of the first one in such places decides
            a = np.flatnonzero(close & ~single[:n] & ~double[:n] & padded[np.minimum(np.arange(n) + 1, n)])
            past = lambda x, k: np.where(x >= k, x - k, n + 2)
            joined = lambda x, k: adjacent[past(x, k)]
            # inside a name with a listed surname
            taken = joined(a, 1) & (single[past(a, 1)] & padded[a] | double[past(a, 1)]) | joined(a, 2) & double[past(a, 2)]
            a = a[~taken]
            hold = left_known(a)
            for k in (3, 2):
                b = a + k
                ok = np.ones(len(a), bool) if k == 2 else adjacent[a + 1] & padded[np.minimum(a + 2, n)]
                ok &= hold | right_known(b) | adjacent[np.minimum(b, n + 2) - 1] & title[np.minimum(b, n + 2)]
                x = a[ok]
                out.append(("han_open", x, x + k, open_of(x), [self.hash[x], self.hash[nxt(x + 1)], self.hash[nxt(x + 2)] if k == 3 else none]))
            x = np.flatnonzero(title[:n])
            x = x[joined(x, 1) & (x > 0)]
            a = x - 1
            ok = ~single[a] & ~double[past(a, 1)] & padded[a]
            out.append(("han_open", a[ok], x[ok] + 2, open_of(a[ok]), [self.hash[a[ok]], none, none]))
        return self._joined(out)

    # ---- the rest ----
    def span(self, begin: int, end: int) -> tuple[int, int, int]:
        """(text, first and last place in the original text) of tokens."""
        t = int(self.text[begin])
        s = int(self.text_start[t])
        return t, *self.folded[t].span(int(self.start[begin]) - s, int(self.stop[end - 1]) - s)

    def with_shapes(self) -> np.ndarray:
        """Texts that can hold an email, an address or a number of any shape: what each shape cannot
        do without, by counts of tokens."""
        n, lists = len(self.folded), self.lists
        count = lambda tokens: np.bincount(self.text[tokens], minlength=n)
        where = lambda hit: count(np.flatnonzero(hit))
        words = self._letters
        of = lambda listed: count(words[_in(self.hash[words], listed)])
        char = lambda *c: where(np.isin(self.char, [ord(x) for x in c]))
        digits = np.bincount(self.text[self.kind == _DIGIT], (self.stop - self.start)[self.kind == _DIGIT], n)
        at = char("@") + of(lists.at) + char("艾")
        dot = char(".") + of(lists.dot) + char("点", "點")
        said = of(lists.counted)
        street = of(lists.street)
        # German streets end in their type, and their numbers are digits or end in -zig
        last = self.stop[words] - 1
        low = lambda k: self.points[np.maximum(0, last - k)].astype(np.int64) | 0x20
        three = low(2) << 42 | low(1) << 21 | low(0)
        ends = lambda listed: count(words[np.isin(three, [(ord(x[0]) | 0x20) << 42 | (ord(x[1]) | 0x20) << 21 | ord(x[2]) | 0x20 for x in listed])])
        german = (ends({x[-3:] for x in scan_.STREETS_DE.split("|")}) > 0) & ((digits > 0) | (ends(("zig", "ßig")) > 0))
        # a number and two capitalised words, maybe with a letter between
        i = np.flatnonzero(self.kind == _DIGIT)
        big = (self.kind == _LETTER) & (self.points[self.start].astype(np.int64) != self.char)
        nxt = self._next
        wide = count(i[big[nxt(i + 1)] & big[nxt(i + 2)] | (self.stop - self.start == 1)[nxt(i + 1)] & big[nxt(i + 2)] & big[nxt(i + 3)]]) > 0
        email = (at > 0) & (dot > 0)
        address = (street > 0) & (digits + said > 0) | german | wide | (char("号", "號") > 0)
        spoken = (of(lists.spoken) >= 3) | (where(np.isin(self.char, lists.han_digit)) >= 7)
        return np.flatnonzero(email | address | (digits >= 6) | spoken)
