"""Names of one text, token by token: what the arrays of pii_tokens are held against."""

import re
from bisect import bisect_left
from dataclasses import dataclass

from utterlake.llm.pii_scan import DOUBLE_SURNAMES, HAN_TITLES, SURNAMES, TITLES, Context, Mention, is_han

_LETTER, _HAN = re.compile("[A-Za-z]"), re.compile("[㐀-鿿]")
HAN_NAME_TITLE = re.compile(rf"(?P<sur>{'|'.join(DOUBLE_SURNAMES)}|[{''.join(sorted(SURNAMES))}])(?P<title>{HAN_TITLES})")
_HAN_RUN, _HAN_TITLE, _HAN_TITLES = re.compile("[㐀-鿿]{2,}"), re.compile(HAN_TITLES), tuple(HAN_TITLES.split("|"))
_TITLE_STARTS = frozenset(t[0] for t in HAN_TITLES.split("|"))
HAN_SURNAME = re.compile(rf"{'|'.join(DOUBLE_SURNAMES)}|[{''.join(sorted(SURNAMES))}]")


_CLOSING = frozenset(",.?!。、；：;:…")



# ---- names ----
_W = r"[^\W\d_㐀-䶿一-鿿]+(?:['’-][^\W\d_㐀-䶿一-鿿]+)*"
CAPITALS = re.compile(r"(?<![\w.@])(?P<a>[A-ZÄÖÜÁÉÍÓÚÑ][^\W\d_A-Z㐀-鿿]+(?:-[A-Z][^\W\d_]+)?)(?P<mid>,?\s+(?:[A-Z]\.?\s+)?)(?P<b>[A-ZÄÖÜÁÉÍÓÚÑ][^\W\d_㐀-鿿]+(?:[-'’][A-Z]?[^\W\d_]+)*)(?![\w@])")
TITLED = re.compile(rf"(?<![\w.])(?P<t>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?\s+(?:[A-Z]\.\s+)?(?P<w>{_W})(?:\s+(?P<v>{_W}))?", re.I)


class Plain:
    """A set that answers as a sketch does."""

    def __init__(self, words):
        self.words, self.has = set(words), self

    def __getitem__(self, s):
        return s in self.words

    def __contains__(self, s):
        return s in self.words


@dataclass
class Known:
    """What earlier rounds found, as sketches: name tokens and contexts of names."""

    tokens: Plain
    lefts: Plain
    rights: Plain

    def __post_init__(self) -> None:
        self.left_of, self.right_of = _Contexts(self.lefts, False), _Contexts(self.rights, True)


def han_before(c, a: int, n: int = 4) -> str:
    """What ``around`` gives left of a Chinese character: mostly the characters before it."""
    t, j = c.text, a
    while j > 0 and a - j < n and is_han(t[j - 1]):
        j -= 1
    if a - j == n or j == 0 or t[j - 1] in _CLOSING:
        return " ".join(t[j:a]) or "^"
    return c.before(bisect_left(c.starts, a), n)

def han_after(c, b: int, n: int = 4) -> str:
    """What ``around`` gives right of a Chinese character."""
    t, j = c.text, b
    while j < len(t) and j - b < n and is_han(t[j]):
        j += 1
    if j - b == n or j == len(t) or t[j] in _CLOSING:
        return " ".join(t[b:j]) or "$"
    return c.after(bisect_left(c.starts, b), n)


def _mention(c: Context, form: str, a: int, b: int, seed: str, tokens: tuple[str, ...], n: int = 2) -> Mention:
    left, right = c.around(a, b, n)
    return Mention("name", form, a, b, seed, left, right, "", tokens)


class _Contexts(dict):
    """Whether a context, or its part of two tokens next to the name, is in a sketch, remembered."""

    def __init__(self, sketch: Plain, right: bool) -> None:
        self.sketch, self.right = sketch, right

    def __missing__(self, context: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        parts = context.split(" ")
        near = " ".join(parts[:2] if self.right else parts[-2:])
        self[context] = known = context not in "^$" and (context in self.sketch or near in self.sketch)
        return known


def names(c: Context, known: Known | None) -> list[Mention]:
    """Titled words and pairs of capitalised words; with ``known`` also pairs of words, and
    Chinese surnames with one or two characters, that known tokens or contexts point to."""
    out: list[Mention] = []
    low = c.low
    if _LETTER.search(c.text):
        seen = set()
        for m in TITLED.finditer(c.text):
            w = m.group("w")
            if w.lower() in TITLES or len(w) < 2:
                continue
            capital = w[0].isupper() and not (m.group("t").isupper() and len(m.group("t")) > 3)
            if known is None and not capital:
                continue
            v = m.group("v")
            end = m.end("w")
            if v and (v[0].isupper() and capital or known is not None and v.lower() in known.tokens and w.lower() in known.tokens):
                end = m.end("v")
            seen.add(m.start("w"))
            out.append(_mention(c, "title", m.start(), end, "name" if capital else "", (w.lower(),)))
        pos = 0
        while m := CAPITALS.search(c.text, pos):
            pos = m.start("b")
            if m.group("a").lower() in TITLES or m.start("a") in seen:
                continue
            out.append(_mention(c, "capitals", m.start(), m.end(), "", (m.group("a").lower(), m.group("b").lower())))
        if known is not None:
            words = [len(t) > 1 and t[0].isalpha() and not is_han(t[0]) and t not in TITLES for t in low]
            last = len(low) - 1
            token, on_left, on_right = known.tokens.has, known.lefts.has, known.rights.has
            for i in range(last):
                if not words[i]:
                    continue
                j = i + 1
                if j < last and not words[j]:
                    # a comma or an initial may stand between
                    t = c.tokens[j][0]
                    if t == ",":
                        j += 1
                    elif len(t) == 1 and t.isalpha() and not is_han(t):
                        j += 1
                        if j < last and c.tokens[j][0] == ".":
                            j += 1
                if not words[j]:
                    continue
                w, v = low[i], low[j]
                pair = token[w] and token[v]
                left = f"{low[i - 2]} {low[i - 1]}" if i > 1 and low[i - 1] and low[i - 2] else c.before(i, 2)
                right = f"{low[j + 1]} {low[j + 2]}" if j + 1 < last and low[j + 1] and low[j + 2] else c.after(j + 1, 2)
                if pair or left != "^" and on_left[left] or right != "$" and on_right[right]:
                    out.append(Mention("name", "pair" if pair else "context", c.tokens[i][1], c.tokens[j][2], "", left, right, "", (w, v)))
    if _HAN.search(c.text):
        for m in HAN_NAME_TITLE.finditer(c.text):
            out.append(_mention(c, "han_title", m.start(), m.end(), "name", (m.group("sur"),), 4))
        if known is not None:
            token, left_of, right_of = known.tokens.has, known.left_of, known.right_of
            for m in HAN_SURNAME.finditer(c.text):
                a, b = m.start(), m.end()
                if b >= len(c.text) or not is_han(c.text[b]) or c.text[b] in _TITLE_STARTS and HAN_NAME_TITLE.match(c.text, a):
                    continue
                one, two = c.text[b], c.text[b + 1 : b + 2]
                hold = left_of[han_before(c, a)]
                near = token[one]
                if bool(two) and is_han(two) and (hold or near and token[two] or right_of[han_after(c, b + 2)]):
                    out.append(_mention(c, "han", a, b + 2, "", (m.group(), one, two), 4))
                if hold or near or right_of[han_after(c, b + 1)]:
                    out.append(_mention(c, "han", a, b + 1, "", (m.group(), one), 4))
            # other first characters, where the next ones stand in known names: a context or a
            # title must point there, and the share of the first one in such places decides
            for m in _HAN_RUN.finditer(c.text):
                t, end = c.text, m.end()
                for a in range(m.start(), end - 1):
                    if t[a] in SURNAMES or t[a : a + 2] in DOUBLE_SURNAMES or not token[t[a + 1]]:
                        continue
                    # inside a name with a listed surname
                    if a and (t[a - 1] in SURNAMES and token[t[a]] or t[a - 1 : a + 1] in DOUBLE_SURNAMES or a > 1 and t[a - 2 : a] in DOUBLE_SURNAMES):
                        continue
                    hold = left_of[han_before(c, a)]
                    for b in (a + 3, a + 2):
                        if b <= end and (b == a + 2 or token[t[a + 2]]) and (hold or right_of[han_after(c, b)] or t.startswith(_HAN_TITLES, b)):
                            out.append(_mention(c, "han_open", a, b, "", tuple(t[a:b]), 4))
                if _HAN_TITLE.search(t, m.start(), end):
                    for x in _HAN_TITLE.finditer(t, m.start() + 1, end):
                        a = x.start() - 1
                        if t[a] not in SURNAMES and t[max(0, a - 1) : a + 1] not in DOUBLE_SURNAMES and token[t[a]]:
                            out.append(_mention(c, "han_open", a, x.end(), "", (t[a],), 4))
    return out


