"""Visually identical text written with different characters (problem 1).

Every token (a run of letters and marks) gets the intersection of its letters' resolved script sets (Unicode's script
extensions, with the East Asian writing systems as sets of scripts).  An empty intersection marks a mixed-script token.
Of its scripts those are candidates in which every letter can be spelt: a letter has a spelling in a script if a letter
of that script has the same prototype in Unicode's confusables data.  A sole candidate is the consistent script, as some
letter demands it; among several the nearest tokens of the line decide that leave no choice.  A token of one script
whose letters could all be Latin is a whole-script confusable, which is respelt unless one of the nearest tokens that
leave no choice is of another script.  Without any such token in the line the home script (Latin) decides.

Compatibility forms (full-width, mathematical, ligatures), decomposed accents, odd spaces and hyphens and invisible
characters are normalised as well.

Defined cases: null stays null, the empty string stays empty; emoji sequences, ordinals, fractions, superscripts,
single Roman-numeral signs, typographic punctuation and passages in other scripts are left as they are.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex

from .common import lines_with, put_lines

# Letters that look like the Latin letters below them, where Unicode's data say otherwise or nothing.
EXCEPTIONS = dict(zip("ӏԚκχηωլքȷʀɢʏʟʜɴƒıЗ", "lQkxnwlpjRGYLHNfi3", strict=True))
SCRIPTS = (
    "Latin Cyrillic Greek Armenian Hebrew Arabic Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai Lao Tibetan Myanmar Georgian Hangul Ethiopic Cherokee Canadian_Aboriginal Ogham Runic Khmer Mongolian "
    "Hiragana Katakana Bopomofo Han Yi Old_Italic Gothic Deseret Coptic Lisu Vai Carian Lycian Lydian Tifinagh Glagolitic Bamum Osage Elbasan Caucasian_Albanian Miao Warang_Citi Nko Syriac Thaana"
).split()
TOGETHER = {"Hiragana": ("Japanese",), "Katakana": ("Japanese",), "Han": ("Japanese", "Korean", "Chinese"), "Hangul": ("Korean",), "Bopomofo": ("Chinese",)}
HOME = "Latin"
SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
HYPHENS = "\u2010\u2011\ufe63\uff0d"

# A text without any of these can't be changed; the pattern is RE2 and Python alike.
SUSPECT = r"[\x{a0}\x{ad}\x{131}\x{180}-\x{1c3}\x{1dd}-\x{1e5}\x{21c}-\x{225}\x{234}-\x{1fff}\x{2000}-\x{2011}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{2100}-\x{218f}\x{2460}-\x{24ff}\x{2e80}-\x{10ffff}]"
_SUSPECT = re.compile("[\u00a0\u00adı\u0180-\u01c3\u01dd-\u01e5\u021c-\u0225\u0234-\u1fff\u2000-\u2011\u2028-\u202f\u205f-\u206f\u2100-\u218f\u2460-\u24ff\u2e80-\U0010ffff]")

_DECOMPOSED = re.compile("[A-Za-zÀ-ɏḀ-ỿ][\u0300-\u036f]+")
_COMPAT = re.compile("[\u2102-\u2149\ufb00-\ufb06\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\U0001d400-\U0001d7ff]+")
_ROMAN = re.compile("[\u2160-\u217f]")
_ROMAN_NUMERAL = re.compile("(?=[MDCLXVI])M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
_TOKEN = re.compile("(?:[^\\W\\d_]|[\u2160-\u217f])(?:[^\\W\\d_]|[\u2160-\u217f\u0300-\u036f])*")
_SPACE = re.compile(f"[{SPACES}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}\U000e0000-\U000e007f]")
_HYPHEN = re.compile(f"[{HYPHENS}]")
_NOT_COMPAT = frozenset("\u2103\u2109\u2100\u2101\u2105\u2106\u210a\u2114\u2116\u2117\u211e\u2120\u2121\u2122\u2123\u2125\u2126\u2127\u2129\u2132\u213a\u213b")


_data: list[bytes] = []


def unicode_data() -> bytes:
    """The confusables table of the Unicode library that Spark brings along (46 kB); operators hand it to the workers."""
    if not _data:
        import pyspark

        homes = [h for h in (os.environ.get("TINTERO_ICU"), os.path.join(os.environ.get("SPARK_HOME", ""), "jars"), os.path.join(os.path.dirname(pyspark.__file__), "jars")) if h]
        jars = [j for h in homes for j in sorted(glob.glob(os.path.join(h, "icu4j-*.jar")))]
        if not jars:
            raise FileNotFoundError("no icu4j archive among Spark's; name its folder in TINTERO_ICU")
        with zipfile.ZipFile(jars[0]) as z:
            _data.append(z.read(next(n for n in z.namelist() if n.endswith("/confusables.cfu"))))
    return _data[0]


def use(data: bytes) -> None:
    """Takes the table that the driver has read."""
    if not _data:
        _data.append(data)


@lru_cache(maxsize=1)
def prototypes() -> dict[str, str]:
    """What each character looks like, by Unicode's data: a header, then keys (character, length), values and strings."""
    raw = unicode_data()
    body = raw[struct.unpack(">H", raw[:2])[0] :]
    keys_at, n, values_at, _, strings_at, size = struct.unpack(">6I", body[12:36])
    strings = struct.unpack(f">{size}H", body[strings_at : strings_at + 2 * size])
    out = {}
    for key, value in zip(struct.unpack(f">{n}I", body[keys_at : keys_at + 4 * n]), struct.unpack(f">{n}H", body[values_at : values_at + 2 * n]), strict=True):
        length = (key >> 24) + 1
        units = (value,) if length == 1 else strings[value : value + length]
        out[chr(key & 0x1FFFFF)] = struct.pack(f">{length}H", *units).decode("utf-16-be", "replace")
    return out


_SCRIPT = {s: regex.compile(rf"\p{{scx={s}}}") for s in SCRIPTS}


@lru_cache(maxsize=1 << 16)
def scripts(ch: str) -> frozenset[str]:
    """The resolved script set of a character; empty for those that any script uses."""
    out = set()
    for name, test in _SCRIPT.items():
        if test.match(ch):
            out.update((name, *TOGETHER.get(name, ())))
    if not out and ch.isalpha():
        out.add(unicodedata.name(ch, "?").split()[0].title())
    return frozenset(out)


@lru_cache(maxsize=1)
def _spellings() -> dict[str, dict[str, list[str]]]:
    """By script and prototype the letters of that script which look so, in the order of their code points."""
    out: dict[str, dict[str, list[str]]] = {}
    looks = {c: c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"} | prototypes() | EXCEPTIONS
    for ch in sorted(looks):
        if ch.isalpha() and len(looks[ch]) == 1 and (ch.isascii() or not regex.match(r"\p{scx=Latin}", ch)) and unicodedata.normalize("NFKC", ch) == ch:
            for name in scripts(ch):
                out.setdefault(name, {}).setdefault(looks[ch], []).append(ch)
    return out


@lru_cache(maxsize=1 << 16)
def spelling(ch: str, script: str) -> str | None:
    """The letter of the script that looks like this one, of the same case if there is one; itself in its own script."""
    if script in scripts(ch) and not (script == HOME and is_odd_latin(ch)):
        return ch
    base, *marks = unicodedata.normalize("NFD", ch)
    look = EXCEPTIONS.get(base) or prototypes().get(base, base)
    if script == HOME and look.isdigit() and base in EXCEPTIONS:
        return look
    if len(look) > 1 and all(unicodedata.combining(c) for c in look[1:]) and is_odd_latin(base):
        look = look[0]
    fit = _spellings().get(script, {}).get(look, [])
    best = next((c for c in fit if c.isupper() == base.isupper()), fit[0] if fit else None)
    return best if best is None else unicodedata.normalize("NFC", best + "".join(marks))


@lru_cache(maxsize=1 << 16)
def is_odd_latin(ch: str) -> bool:
    """Whether a letter is a Latin one beyond the alphabets of Europe that looks like a plain one."""
    if ch in EXCEPTIONS and "Latin" in scripts(ch):
        return True
    return "\u0180" <= ch and "Latin" in scripts(ch) and unicodedata.normalize("NFKD", ch) == ch and bool(re.fullmatch("[A-Za-z][\u0300-\u036f]?", prototypes().get(ch, "")))


def _emoji(ch: str) -> bool:
    return bool(ch) and (ord(ch) >= 0x1F000 or "\u2600" <= ch <= "\u27bf" or ch in "\u2640\u2642\u2764\ufe0f\u20e3")


def _foreign_letter(ch: str) -> bool:
    return bool(ch) and ch.isalpha() and spelling(ch, HOME) is None and HOME not in scripts(unicodedata.normalize("NFKC", ch)[0])


def _drop_invisible(m: re.Match[str]) -> str:
    text, i = m.string, m.start()
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    ch = m.group()
    if _emoji(before) and (ch == "\u200d" and _emoji(after) or "\ufe00" <= ch <= "\ufe0f" or ch >= "\U000e0000"):
        return ch
    if "\ufe00" <= ch <= "\ufe0f" and (after == "\u20e3" or before and not before.isalnum() and not before.isspace()):
        return ch  # presentation of a symbol
    return ch if _foreign_letter(before) or ch in "\u200c\u200d" and _foreign_letter(after) else ""


def _plain_space(m: re.Match[str]) -> str:
    text, i = m.string, m.start()
    if m.group() == "\u3000" and (text[i - 1 : i] > "\u2e7f" or text[i + 1 : i + 2] > "\u2e7f"):
        return m.group()
    return " "


def _compat(m: re.Match[str]) -> str:
    text, i, j = m.string, m.start(), m.end()
    run = m.group()
    out = "".join(c if c in _NOT_COMPAT else unicodedata.normalize("NFKC", c) for c in run)
    if not all(c.isascii() or HOME in scripts(c) for c in out if c.isalpha()):
        return run
    lone_symbol = len(run) == 1 and "\u2100" <= run <= "\u214f" and run not in "\u212a\u212b" and not (text[i - 1 : i].isalpha() or text[j : j + 1].isalpha())
    return run if lone_symbol else out


def _respell(token: str, script: str) -> str | None:
    """The token in letters of the script, or None if some letter has no look-alike there."""
    out = []
    for ch in token:
        if _ROMAN.match(ch):
            out.append(unicodedata.normalize("NFKC", ch))
        elif unicodedata.combining(ch) or not scripts(ch):
            out.append(ch)
        elif (new := spelling(ch, script)) is not None:
            out.append(new)
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=1 << 16)
def _choices(token: str) -> tuple[str, tuple[str, ...]]:
    """(kind, scripts): ``one`` script without a choice, ``none`` (nothing to decide), or ``mixed`` or ``whole`` with the candidates."""
    if token.isascii():
        return "one", (HOME,)
    letters = [c for c in token if not unicodedata.combining(c) and not _ROMAN.match(c) and scripts(c)]
    roman = bool(_ROMAN.search(token))
    if not letters:
        if not roman:
            return "none", ()
        numeral = unicodedata.normalize("NFKC", token).upper()
        lone = len(token) == 1 or _ROMAN_NUMERAL.fullmatch(numeral) and (token.isupper() or token.islower()) and len(token) <= 4
        return ("none", ()) if lone else ("mixed", (HOME,))
    resolved = frozenset.intersection(*map(scripts, letters))
    odd = roman or any(map(is_odd_latin, letters))
    if HOME in resolved and not odd:
        return "one", (HOME,)
    if resolved and not odd:
        return ("whole", (HOME, min(resolved))) if _respell(token, HOME) is not None else ("one", (min(resolved),))
    count = Counter([HOME, *(s for c in letters for s in scripts(c))])
    fit = [s for s, _ in sorted(count.items(), key=lambda x: (-x[1], x[0] != HOME, x[0])) if _respell(token, s) is not None]
    return ("mixed", tuple(fit)) if fit else ("none", ())


def _last_known(scripts_of: list[str | None]) -> list[str | None]:
    """For each token the last script before it that is known."""
    out, last = [], None
    for s in scripts_of:
        out.append(last)
        last = s or last
    return out


def _tokens(text: str) -> str:
    """Respells mixed-script and whole-script confusable tokens."""
    found = list(_TOKEN.finditer(text))
    if not found or text.isascii():
        return text
    kinds = [_choices(m.group()) for m in found]
    sure = [fit[0] if kind == "one" or kind == "mixed" and (len(fit) == 1 or HOME not in fit) else None for kind, fit in kinds]
    before, after = _last_known(sure), _last_known(sure[::-1])[::-1]
    out, at = [], 0
    for k, m in enumerate(found):
        kind, fit = kinds[k]
        around = [s for s in (before[k], after[k]) if s is not None]
        if kind == "whole":
            chosen = HOME if all(s == HOME for s in around) else None
        elif kind == "mixed":
            chosen = sure[k] or next((s for s in around if s in fit), HOME)
        else:
            chosen = None
        if chosen is not None and (new := _respell(m.group(), chosen)) is not None and new != m.group():
            out += [text[at : m.start()], new]
            at = m.end()
    return "".join([*out, text[at:]]) if out else text


def normalize(text: str | None) -> str | None:
    """One consistent spelling of equal-looking text; text that needs nothing comes back as it is."""
    if not text or not _SUSPECT.search(text):
        return text
    if "\n" in text:
        return "\n".join([normalize(x) for x in text.split("\n")])  # type: ignore[misc]
    new = _INVISIBLE.sub(_drop_invisible, text)
    new = _SPACE.sub(_plain_space, new)
    new = _HYPHEN.sub("-", new)
    new = _COMPAT.sub(_compat, new)
    new = _DECOMPOSED.sub(lambda m: unicodedata.normalize("NFC", m.group()), new)
    return _tokens(new)


def normalized(column: pa.Array) -> list[str | None]:
    """The texts of a column in one consistent spelling."""
    texts = column.to_pylist()
    for row, numbers, lines in lines_with(column, SUSPECT):
        put_lines(texts, row, numbers, [normalize(x) or "" for x in lines])
    return texts


def confusable_rows(column: pa.Array) -> list[int]:
    """The rows of a column that ``normalize`` would change."""
    return [row for row, _, lines in lines_with(column, SUSPECT) if any(normalize(x) != x for x in lines)]


def is_confusable(text: str | None) -> bool:
    """Whether the text has a character that ``normalize`` would write otherwise."""
    return bool(text) and normalize(text) != text
