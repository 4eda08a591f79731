"""Mentions of personal data in one text: shapes, and what stands around them.

Everything here works on one text at a time and decides nothing beyond shape; which
mentions count is decided from the whole corpus (see pii.py).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from dataclasses import dataclass

from utterlake.llm.lookalike import CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES

# ---- fixed values: words of the languages at hand ----
DIGIT_WORDS = {
    **dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789")),
    **dict(zip("null eins zwei zwo drei vier fünf sechs sieben acht neun".split(), "01223456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
}
HAN_DIGITS = dict(zip("零〇一二三四五六七八九幺", "001234567891"))
TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
ONES = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "herr", "frau", "doktor", "señor", "señora", "señorita", "sr", "sra", "don", "doña", "doctor", "doctora"}
HAN_TITLES = "先生|女士|小姐|太太|师傅|師傅|夫人"
SURNAMES = set("王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧蕭程曹袁邓鄧许許傅沈曾彭吕呂苏蘇卢盧蒋蔣蔡贾賈丁魏薛叶葉阎閻余潘杜戴夏钟鍾汪田任姜范方石姚谭譚廖邹鄒熊金陆陸郝孔白崔康毛邱秦江史顾顧侯邵孟龙龍万萬段钱錢汤湯尹黎易常武乔喬贺賀赖賴龚龔文")
DOUBLE_SURNAMES = ("欧阳", "歐陽", "司徒", "司马", "司馬", "上官", "诸葛", "諸葛", "东方", "東方", "皇甫", "尉迟", "尉遲", "公孙", "公孫", "慕容", "夏侯", "令狐", "端木")
STREETS_EN = "street|st|road|rd|avenue|ave|lane|ln|close|terrace|drive|way|court|crescent|boulevard|blvd|square|place|grove|gardens|parade|highway"
STREETS_DE = "straße|strasse|str|weg|gasse|allee|platz|ring|damm|ufer|chaussee|pfad|steig"
STREETS_ES = "calle|c/|avenida|avda|paseo|plaza|camino|ronda|travesía|carretera|callejón|glorieta|vía"
STREETS_HAN = "大道|大街|胡同|路|街|巷|弄|里|道"
NOT_PERSONAL = {"order", "serial", "version", "invoice", "ticket", "bestellung", "bestellnummer", "seriennummer", "pedido", "serie", "versión", "factura"}
NOT_PERSONAL_HAN = ("订单号", "訂單號", "流水号", "流水號", "版本号", "版本號", "序列号", "序列號", "单号", "單號")

_INVISIBLE = {"Cf", "Cc"}


@dataclass
class Folded:
    text: str
    at: list[int] | None  # place in the original of each character, None if the same

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.at is None:
            return a, b
        return self.at[a], (self.at[b - 1] + 1 if b else 0)


# Texts of these characters only change in the width of marks, place by place.
_PLAIN = re.compile("[\x09\x0a\x0d\x20-\x7e一-鿿。、，！？À-ÖØ-öø-ÿ¿¡]*")
_OWN = re.compile("[\x09\x0a\x0d\x20-\x7e一-鿿。、，！？А-яЁёΆΈ-ΊΌΎ-ΡΣ-ώ]*")
_MARKS = str.maketrans("，！？", ",!?")
_LOOKALIKES = str.maketrans(GREEK_LOOKALIKES | CYRILLIC_LOOKALIKES)
_CYRILLIC, _GREEK, _LATIN_OR_HAN = re.compile("[Ѐ-ӿ]"), re.compile("[Ͱ-Ͽ]"), re.compile("[A-Za-z一-鿿]")


def fold(text: str) -> Folded:
    """Width, look-alike and invisible characters out of the way, places remembered."""
    if text.isascii():
        return Folded(text, None)
    if _PLAIN.fullmatch(text):
        return Folded(text.translate(_MARKS), None)
    cyr, gre = len(_CYRILLIC.findall(text)), len(_GREEK.findall(text))
    mapped = bool(cyr + gre) and max(cyr, gre) < len(_LATIN_OR_HAN.findall(text))
    if mapped:
        if _PLAIN.fullmatch(looks := text.translate(_LOOKALIKES)):
            return Folded(looks.translate(_MARKS), None)
    elif _OWN.fullmatch(text):
        return Folded(text.translate(_MARKS), None)
    out: list[str] = []
    at: list[int] = []
    odd = False
    for i, c in enumerate(text):
        if c.isascii() or "一" <= c <= "鿿":
            out.append(c)
            at.append(i)
            continue
        if mapped and (m := CYRILLIC_LOOKALIKES.get(c) or GREEK_LOOKALIKES.get(c)):
            out.append(m)
            at.append(i)
            odd = True
            continue
        kind = unicodedata.category(c)
        if kind in _INVISIBLE:
            odd = True
            continue
        if kind == "Mn" and out and len(n := unicodedata.normalize("NFC", out[-1] + c)) == 1:
            out[-1] = n
            odd = True
            continue
        n = " " if kind == "Zs" else unicodedata.normalize("NFKC", c)
        odd |= n != c
        out += n
        at += [i] * len(n)
    return Folded("".join(out), at if odd or len(out) != len(text) else None)


@dataclass
class Mention:
    group: str  # num, name, email, address
    form: str
    start: int
    end: int
    seed: str  # a kind, 'other', or ''
    left: str
    right: str
    shape: str = ""
    tokens: tuple[str, ...] = ()


_LETTER = re.compile("[A-Za-z]")
_DIGIT = re.compile(r"\d")
_HAN = re.compile("[㐀-鿿]")

# ---- email ----
_AT = r"(?:\s?@\s?|\s*[\[({]\s*(?:at|ät|arroba|艾特)\s*[\])}]\s*|\s+(?:at|ät|arroba)\s+|\s*艾特\s*)"
_SPELT_DOT = r"(?:\s*[\[({]\s*(?:dot|punkt|punto|[点點])\s*[\])}]\s*|\s+(?:dot|punkt|punto)\s+|\s*[点點]\s*)"
_JOIN = rf"(?:[._+\-]|{_SPELT_DOT}|\s+(?:underscore|dash|hyphen|plus|unterstrich|bindestrich|minus|guion\s+bajo|guion|guión\s+bajo|guión|más)\s+|\s*(?:下划线|底線|下劃線|减号|減號|加号|加號)\s*)"
_WORD = r"[a-z0-9]+"
# generic and country domains, and those reserved for documentation
_TOP = "com|org|net|edu|info|de|es|uk|cn|hk|test|example|invalid"
EMAIL = re.compile(rf"(?<![a-z0-9]){_WORD}(?:{_JOIN}{_WORD})*(?P<at>{_AT}){_WORD}(?:-{_WORD})*(?P<rest>(?:(?:\.|\s\.\s?|\.\s(?=(?:{_TOP})\b)|{_SPELT_DOT})[a-z0-9]+(?:-[a-z0-9]+)*)+)", re.I)

# ---- numbers ----
_SPOKEN = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPOKEN = re.compile(rf"(?<![\w])(?:plus\s+|más\s+)?(?:(?:double|triple|doble)\s+)?(?:{_SPOKEN})(?:[\s,\-]+(?:(?:double|triple|doble)\s+)?(?:{_SPOKEN}))+(?![\w])", re.I)
HAN_SPOKEN = re.compile("[零〇一二三四五六七八九幺]{7,}")
DATE = re.compile(r"(?<!\d)(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4})(?!\d)")
IDS = [
    ("ni", re.compile(r"(?<![a-z0-9])[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-d](?![a-z0-9])", re.I)),
    ("insurance", re.compile(r"(?<![a-z0-9])\d{2}\s?\d{6}\s?[a-z]\s?\d{3}(?![a-z0-9])", re.I)),
    ("nie", re.compile(r"(?<![a-z0-9])[xyz]\s?-?\d{7}\s?-?[a-z](?![a-z0-9])", re.I)),
    ("dni", re.compile(r"(?<![a-z0-9\-])\d{8}\s?-?[a-z](?![a-z0-9])", re.I)),
    ("hkid", re.compile(r"(?<![a-z0-9])[a-z]{1,2}\d{6}\s?\([0-9a]\)", re.I)),
    ("passport", re.compile(r"(?<![a-z0-9])[a-z]{1,2}\d{7,8}(?![a-z0-9])", re.I)),
    ("ssn", re.compile(r"(?<![\d\-])\d{3}([- ])\d{2}\1\d{4}(?![\d\-])")),
    ("han18", re.compile(r"(?<![a-z0-9])\d{17}[\dx](?![a-z0-9])", re.I)),
]
NUMBER = re.compile(r"(?<![A-Za-z0-9_.])(?:\+|00)?\(?\d[\d()]*(?:[ \t.\-/]{1,3}[\d()]*\d[\d()]*)*(?:\s*(?:ext|x|durchwahl)\.?\s*\d{1,5})?(?![A-Za-z0-9_])", re.I)

# ---- addresses ----
_NO_EN = rf"(?:\d{{1,4}}\s?[a-z]?|(?:{TENS})(?:[\s\-](?:{ONES}))?|(?:one|two|three)\s+hundred(?:\s+(?:and\s+)?(?:{TENS}|{ONES})(?:[\s\-](?:{ONES}))?)?|{ONES})"
_NO_NAME = "of|the|on|in|at|a|an|and|is|was|are|for|from|with|to|that|oh|zero|pieces|days|items|dollars|tennis|" + ONES
_UNIT_EN = r"(?:(?:flat|unit|apartment|apt|suite|room)\.?\s+\w{1,5},?\s+)?"
ADDRESS_EN = re.compile(rf"(?<![\w.\-]){_UNIT_EN}{_NO_EN},?\s+(?P<name>(?!(?:{_NO_NAME})\b)[^\W\d_]+(?:['’-][^\W\d_]+)?(?:\s(?!(?:{_NO_NAME})\b)[^\W\d_]+)?)\s+(?P<type>{STREETS_EN})\b\.?(?:,?\s+(?!is\b|and\b|the\b)(?:[A-Z][\w'-]+)(?:\s[A-Z][\w'-]+)?)?(?:,?\s+\d{{5}}(?!\d))?", re.I)
_NO_DE = r"(?:\d{1,4}\s?[a-z]?(?![\w])|(?:[a-zäöüß]{2,8}und)?(?:zwanzig|dreißig|vierzig|fünfzig|sechzig|siebzig|achtzig|neunzig)(?!\w))"
ADDRESS_DE = re.compile(rf"(?<!\w)(?P<name>[^\W\d_]{{3,}})(?:[\s-]?(?:straße|strasse|str)\.?|(?:{STREETS_DE})\.?)\s*,?\s*{_NO_DE}(?:,?\s+\d{{5}}\s+[^\W\d_]+)?", re.I)
_NO_ES = r"(?:n[úu]mero\s+|nº\s*)?\d{1,4}(?!\d)(?:\s?(?:bis))?"
ADDRESS_ES = re.compile(rf"(?<!\w)(?:{STREETS_ES})\.?\s+(?:de\s+(?:la\s+|los\s+|las\s+)?|del\s+)?[^\W\d_]+(?:\s+(?!con\b|y\b|es\b)[^\W\d_]+)?,?\s+{_NO_ES}(?:,?\s+piso\s+\d+\s?[a-z]?(?![\w]))?(?:,?\s+\d{{5}}\s+[^\W\d_]+)?", re.I)
_PLACE = "(?:(?![到在去喺住送的嘅往是係])[一-鿿]){2,3}"
_NO_HAN = "[0-9零〇一二三四五六七八九十百幺兩两]{1,6}"
ADDRESS_HAN = re.compile(rf"(?:{_PLACE}[省市縣县])?\s*(?:{_PLACE}[区區镇鎮])?\s*(?P<name>[一-鿿]{{2}})(?P<type>{STREETS_HAN})\s*{_NO_HAN}\s*[号號](?:\s*[0-9零一二三四五六七八九十]+\s*[号號]?[楼樓幢栋棟座])?(?:\s*[0-9零〇一二三四五六七八九十]+\s*[室房])?")
ADDRESS_WIDE = re.compile(r"(?<![\w.])\d{1,4}[a-z]?\s+[A-Z][a-z]+\s+[A-Z][a-z]+")

# ---- tokens ----
TOKEN = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+(?:['’-][^\W\d_㐀-䶿一-鿿]+)*|\d+|[^\w\s]|_")


def is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿"


class _Lower(dict):
    """Tokens as contexts hold them, remembered."""

    def __missing__(self, t: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[t] = low = "0" if t.isdigit() else t.lower() if t[0].isalnum() else ""
        return low


_LOW = _Lower()


@dataclass
class Context:
    """Tokens of a text, for what stands left and right of a span."""

    text: str

    def __post_init__(self) -> None:
        # in lower case; a number is 0, and a mark, which closes a context, is empty
        self.low = list(map(_LOW.__getitem__, TOKEN.findall(self.text)))
        self._tokens: list[tuple[str, int, int]] = []

    @property
    def tokens(self) -> list[tuple[str, int, int]]:
        """(token, begin, end); most texts never need their places."""
        if not self._tokens:
            self._tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(self.text)]
            self._starts = [a for _, a, _ in self._tokens]
        return self._tokens

    @property
    def starts(self) -> list[int]:
        return self._starts if self.tokens else []

    def before(self, i: int, n: int) -> str:
        """Up to ``n`` tokens before the i-th."""
        j = i
        while j > 0 and i - j < n and self.low[j - 1]:
            j -= 1
        return " ".join(self.low[j:i]) or "^"

    def after(self, i: int, n: int) -> str:
        """Up to ``n`` tokens from the i-th on."""
        j = i
        while j < len(self.low) and j - i < n and self.low[j]:
            j += 1
        return " ".join(self.low[i:j]) or "$"

    def around(self, a: int, b: int, n: int = 2) -> tuple[str, str]:
        """The ``n`` tokens before and after, in lower case; a mark or an end closes them."""
        return self.before(bisect_left(self.starts, a), n), self.after(bisect_left(self.starts, b), n)


def _valid_date(d: str) -> bool:
    y, m, day = int(d[:4]), int(d[4:6]), int(d[6:8])
    return 1900 <= y <= 2035 and 1 <= m <= 12 and 1 <= day <= 31


def _not_personal(c: Context, a: int, left_words: int = 4) -> bool:
    before = c.text[max(0, a - 24) : a]
    if any(before.rstrip(" :：").endswith(w) for w in NOT_PERSONAL_HAN):
        return True
    i = bisect_left(c.starts, a)
    return any(t.lower() in NOT_PERSONAL for t, _, _ in c.tokens[max(0, i - left_words) : i])


def _phone(digits: str, groups: str, text: str) -> bool:
    """Numbers in the usual national forms: Chinese, Hong Kong with its prefix, British, German
    and Spanish mobiles, ten North American digits in groups, German area codes."""
    n = len(digits)
    return bool(
        n == 11 and re.match(r"1[3-9]", digits)
        or n == 13 and re.match(r"861[3-9]", digits)
        or text.startswith(("(852)", "852 ", "852-")) and n == 11
        or n == 11 and digits.startswith("07")
        or n in (11, 12, 13) and re.match(r"01[5-7]", digits)
        or groups in ("3-3-4", "3-7", "spoken") and n == 10 and digits[0] in "23456789"
        or n == 9 and digits[0] in "67" and groups in ("9", "3-3-3", "3-2-2-2", "spoken")
        or groups in ("3-8", "3-7", "4-7", "4-8", "2-8", "2-7") and digits[0] == "0"
        or groups == "spoken" and digits[0] == "0" and n in (10, 11, 12)
        or text.lower().find("ext") > 0
    )


def numbers(c: Context, taken: list[tuple[int, int]]) -> list[Mention]:
    out: list[Mention] = []
    used = list(taken)

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in used)

    def add(a: int, b: int, seed: str, shape: str) -> None:
        used.append((a, b))
        left, right = c.around(a, b)
        out.append(Mention("num", "num", a, b, "other" if seed in ("", "phone") and _not_personal(c, a) else seed, left, right, shape))

    if len(_DIGIT.findall(c.text)) >= 6:  # no shape has fewer
        for m in DATE.finditer(c.text):
            used.append(m.span())
        for name, rx in IDS:
            for m in rx.finditer(c.text):
                if not free(*m.span()):
                    continue
                t = m.group().replace(" ", "")
                if name == "ssn" and len(re.findall(r"\d+", c.text[max(0, m.start() - 6) : m.start()])) and c.text[max(0, m.start() - 1) : m.start()] == "-":
                    continue
                bad = _not_personal(c, m.start())
                if name == "han18":
                    seed = "" if not _valid_date(t[6:14]) else "id_number"
                else:
                    seed = "id_number"
                add(*m.span(), "other" if bad else seed, f"{name}")
        for m in NUMBER.finditer(c.text):
            a, b = m.span()
            while b > a and not c.text[b - 1].isdigit() and c.text[b - 1] != ")":
                b -= 1
            t = c.text[a:b]
            digits = re.sub(r"\D", "", re.sub(r"(?i)(ext|x|durchwahl).*", "", t))
            if not 7 <= len(digits) <= 20 or not free(a, b):
                continue
            groups = "-".join(str(len(g)) for g in re.findall(r"\d+", t))
            plus = t.startswith("+")
            # a Chinese number runs into the digits of the next clause: ...890347号的
            if not plus and groups.isdigit() and len(digits) > 11 and c.text[b : b + 1] in ("号", "號", "个", "個", "块", "塊"):
                if len(digits) > 18 and _valid_date(digits[6:14]):
                    add(a, a + 18, "id_number", "han18")
                    continue
                if len(digits) < 15 and re.match("1[3-9]", digits):
                    add(a, a + 11, "phone", "11:1:11")
                    continue
            seed = "phone" if plus and len(digits) <= 15 or _phone(digits, groups, t) else ""
            add(a, b, seed, f"{'+' if plus else ''}{len(digits)}:{digits[0]}:{groups}")
    for rx, table, has in ((SPOKEN, DIGIT_WORDS, _LETTER), (HAN_SPOKEN, HAN_DIGITS, _HAN)):
        if not has.search(c.text):
            continue
        for m in rx.finditer(c.text):
            if not free(*m.span()):
                continue
            if table is HAN_DIGITS:
                digits = "".join(table[x] for x in m.group())
            else:
                digits, times = "", 1
                for w in re.findall(r"[^\W_]+", m.group().lower()):
                    if w in ("double", "doble", "triple"):
                        times = 3 if w == "triple" else 2
                    elif w in table:
                        digits += table[w] * times
                        times = 1
            if 7 <= len(digits) <= 20:
                if table is HAN_DIGITS:
                    seed = "id_number" if len(digits) == 18 and _valid_date(digits[6:14]) and not _not_personal(c, m.start()) else "phone" if len(digits) == 11 and re.match("1[3-9]", digits) else ""
                else:
                    seed = "phone" if _phone(digits, "spoken", "") else ""
                add(*m.span(), seed, f"{len(digits)}:{digits[0]}:spoken" if len(digits) != 18 else "han18")
    return out


def emails(c: Context) -> list[Mention]:
    out = []
    for m in EMAIL.finditer(c.text):
        at, rest = m.group("at"), m.group("rest")
        symbol = "@" in at
        if symbol and at[0].isspace() and not at[-1].isspace():
            continue  # a handle: "look at @name"
        if not symbol and at.strip().isalpha() and at.strip() != "艾特" and re.search(r"\.\s", rest):
            continue  # the word "at" and the end of a sentence
        last = re.split(r"[.\s\])}点點]+", rest)[-1]
        if not 2 <= len(last) <= 12 or last.isdigit():
            continue
        if re.fullmatch(r"\s\.\s?[A-Z][a-z]+", rest) and not at[0].isspace():
            continue
        left, right = c.around(*m.span())
        out.append(Mention("email", "email", m.start(), m.end(), "email", left, right, "@" if symbol else "spelt"))
    return out


# what an address of each form cannot do without
_HAS_EN = re.compile(rf"\s(?:{STREETS_EN})\b", re.I)
_HAS_DE = re.compile(rf"(?:{STREETS_DE}|straße|strasse|str)\.?\s*,?\s*[\da-zäöüß]", re.I)
_HAS_ES = re.compile(rf"(?<!\w)(?:{STREETS_ES})\.?\s.*\d", re.I | re.S)
_HAS_HAN = re.compile(rf"(?:{STREETS_HAN})\s*{_NO_HAN}\s*[号號]")


def addresses(c: Context, taken: list[tuple[int, int]]) -> list[Mention]:
    out, used = [], list(taken)
    latin, digit, han = _LETTER.search(c.text), _DIGIT.search(c.text), "号" in c.text or "號" in c.text
    for form, rx, has in (("en", ADDRESS_EN, _HAS_EN), ("de", ADDRESS_DE, _HAS_DE), ("es", ADDRESS_ES, _HAS_ES), ("han", ADDRESS_HAN, _HAS_HAN)):
        if not (han if form == "han" else latin and (form != "es" or digit)) or not has.search(c.text):
            continue
        for m in rx.finditer(c.text):
            if any(not (m.end() <= x or m.start() >= y) for x, y in used):
                continue
            used.append(m.span())
            left, right = c.around(*m.span())
            g = m.groupdict()
            out.append(Mention("address", form, m.start(), m.end(), "address", left, right, (g.get("type") or form).lower()))
    for m in ADDRESS_WIDE.finditer(c.text) if digit and latin else ():
        if all(m.end() <= x or m.start() >= y for x, y in used):
            left, right = c.around(*m.span())
            out.append(Mention("address", "wide", m.start(), m.end(), "", left, right, "wide"))
    return out
