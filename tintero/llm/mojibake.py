"""Text decoded with the wrong character encoding (problem 2).

For every pair (encoding written, encoding read) the garbled form of each letter and mark of Spanish text is computed
once, also for text garbled two and three times.  Forms of two and more characters go into one Aho-Corasick automaton,
whose matches are replaced span by span; where several pairs give the same form, the pair that explains most forms of
the same line decides.  Pairs of single-byte encodings turn one letter into one other character, which may be meant;
there a word is taken for garbled if its restored form is a known accented word (or ends like one), or if the character
can't stand where it does (a symbol or capital inside a lower-case word, another script inside a Latin word).  Each
line has its own pair, and only the words and marks that the pair explains are replaced, by their places and outside
tags.  Letters lost to ``?`` or U+FFFD are found, and restored where only one known word fits.

Defined cases: null stays null and the empty string empty; foreign words and symbols that are meant are left; a line
without evidence of its own takes the record's pair for words which that pair explains; every other character stays.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa

from .common import TAG, lines_with, put_lines

LETTERS = "áéíóúüñÁÉÍÓÚÜÑ"
MARKS = "¿¡«»—\u2013\u2026\u201c\u201d\u2018\u2019ªº\u00b7"
OTHERS = "àèìòùâêîôûëïäöçãõåøßÀÈÌÒÙÂÊÎÔÛÄÖÇÃÕœ\u20ac\u00bd\u00b0\u00a9"
READ_AS = (
    "cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "iso8859_15", "gbk", "big5", "shift_jis", "euc_kr", "cp874", "cp1253", "cp1254", "cp1257", "iso8859_2", "iso8859_7", "euc_jp", "cp866",
)
TWICE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
MULTIBYTE = ("gbk", "big5", "euc_kr", "shift_jis", "euc_jp")
# Pairs of single-byte encodings whose odd characters alone are evidence, and those that need a known word besides.
ONE_BYTE = [("cp1252", d) for d in ("cp850", "cp437", "mac_roman", "cp1251", "koi8_r", "cp1250", "cp1253", "iso8859_7")] + [(e, "cp1252") for e in ("cp850", "mac_roman")]
ONE_BYTE_MORE = [
    (w, r) for w in ("cp1252", "cp850", "mac_roman") for r in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1253", "cp1257", "iso8859_2", "iso8859_7", "koi8_r", "cp866", "shift_jis") if w != r and (w, r) not in ONE_BYTE
]
MODELS = Path(__file__).parent / "models"

# RE2: a content without this can't be garbled (a necessary condition, cheaper than the automaton).
ORDINARY = "áéíóúüñÁÉÍÓÚÜÑ¿¡«»—\u2013\u2026\u201c\u201d\u2018\u2019ªº\u00b7\u00a9\u2605\u25c7\u2192\u2190\u203a\u00bd\u00d7\u00b0"
SUSPECT = (
    f"[^\\x00-\\x7f{ORDINARY}]|\\p{{L}}[\u00b7\u00bd\u00b0ªº\u201c\u201d\u2018\u2019\u00d7\u00a9\u203a\u2026«»—][\\p{{Ll}}]|\\p{{L}}\\?+\\p{{L}}|(?:^|[\\s>(—])\\?+\\p{{L}}"
    "|&(?:Atilde|Acirc|acirc|#19[45]|#226|#x[cC][23]|#xe2);"
)
SUSPECT_TITLE = SUSPECT + "|\\p{L}\\?"


def _read(data: bytes, encoding: str) -> str:
    """Decodes as browsers do: bytes without a character pass as controls."""
    if encoding != "cp1252":
        return data.decode(encoding)
    return "".join(bytes([b]).decode("latin-1" if b in b"\x81\x8d\x8f\x90\x9d" else "cp1252") for b in data)


@lru_cache(maxsize=1)
def accented_words() -> dict[str, int]:
    """Known words with an accent, trained from correct text (``train.py``)."""
    return json.loads((MODELS / "accented_words.json").read_text(encoding="utf-8"))


# Common words with an accent that few stories may hold.
COMMON = frozenset(
    "adiós además ahí allá allí análisis andén aquí árbol árboles así ataúd atrás aún avión azúcar baúl bebé búho cabaña cafés café cajón camión canción capitán cárcel caña cañón compañero compañía común corazón cuándo cuñado dátil débil "
    "décimo demás después detrás día días difícil dirección dólar dónde dragón dueña dueño él emoción enseñar época español española está están éxito extraña extraño fácil fantástico fénix epílogo frágil fútbol galán guión hábil habitación "
    "héroe héroes hígado huérfano húmedo inglés ilusión jabón japonés jardín joven jóvenes lágrima lágrimas lámpara lápiz latín león leña límite línea líquido lógica lúcido luciérnaga mágico magia mamá máquina más máscara mástil mañana médico "
    "mí milésima millón montaña montón móvil muñeca murciélago música niña niñas niño niños ningún número océano órbita oído órdenes otoño país pájaro pájaros papá párpado paño perdóname algún patrón peña pequeña pequeño periódico piña plátano portón "
    "príncipe prisión prólogo puño página qué quién quizá quizás ración rápido rápida rincón río ríos ruiseñor sábana según señal señales señor señora señorita sí sótano sueño sueños también tamaño té teléfono último última único única uña útil "
    "vacío valentía vehículo víctima viña volcán vía vía zángano".split()
)
# Endings that nearly always bear their accent.
_ENDING = re.compile(r"[a-zñü]{2,}(?:[cstxgnl]?ión|ón|ió|ía[sn]?|íamos|ábamos|áramos|iéramos|iéndo(?:me|te|se|l[aeo]s?)|ándo(?:me|te|se|l[aeo]s?)|ísim[ao]s?)")


def known(word: str) -> bool:
    """Whether a lower-case word is known to bear its accents, by the word or by its ending."""
    return word in accented_words() or word in COMMON or bool(_ENDING.fullmatch(word))


@lru_cache(maxsize=1)
def lost_index() -> dict[str, str]:
    """Known words by their form with lost letters, where only one fits."""
    forms: dict[str, set[str]] = {}
    for w in [*accented_words(), *COMMON]:
        forms.setdefault("".join(c if c.isascii() else "?" for c in w), set()).add(w)
    return {k: next(iter(v)) if len(v) == 1 else "" for k, v in forms.items()}


@lru_cache(maxsize=1)
def contexts() -> frozenset[str]:
    """Three-letter contexts of accented letters in known words, and those of a vowel that is no diphthong."""
    return frozenset(f"{v}{x}{c}" for v in "aeo" for x in "íú" for c in "bdlnrstz") | frozenset(f"^{w}$"[i : i + 3] for w in [*accented_words(), *COMMON] for i in range(len(w)) if not w[i].isascii())


@lru_cache(maxsize=1)
def sequences() -> dict[str, list[tuple[int, str]]]:
    """Garbled forms of several characters (or one of a multi-byte encoding) and what they stood for: (pair's number, text)."""
    out: dict[str, list[tuple[int, str]]] = {}
    chains = [(d,) for d in READ_AS] + [(d, e) for d in READ_AS for e in TWICE] + [(d, e, f) for d in TWICE for e in TWICE for f in TWICE]

    def put(garbled: str, meant: str, chain: int) -> None:
        if garbled != meant and not any(c.isascii() and c.isalnum() for c in garbled[:1]) and (len(garbled) > 1 or garbled > "\u2e7f") and (chain, meant) not in out.setdefault(garbled, []):
            out[garbled].append((chain, meant))

    for k, chain in enumerate(chains):
        for ch in LETTERS + MARKS + OTHERS:
            text = ch
            try:
                for read in chain:
                    text = _read(data := text.encode(), read)
            except UnicodeDecodeError:
                # a multi-byte reader takes the last byte together with the next letter
                if len(chain) == 1 and len(data := ch.encode()) == 3 and chain[0] in ("gbk", "big5", "euc_kr"):
                    for nxt in map(chr, range(0x40, 0x7B)):
                        try:
                            put(_read(data + nxt.encode(), chain[0]), ch + nxt, k)
                        except UnicodeDecodeError:
                            continue
                continue
            put(text, ch, k)
    if not out.get("â\u20ac"):
        out["â\u20ac"] = [(0, "\u201d")]
    return {g: x for g, x in out.items() if x}


@lru_cache(maxsize=1)
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for garbled, meant in sequences().items():
        a.add_word(garbled, (garbled, meant))
    a.make_automaton()
    return a


@dataclass(frozen=True)
class Pair:
    """A single-byte pair: its garbled characters, those within words, opening marks before a capital, whether odd characters are evidence, and letters that became marks."""

    table: dict[str, str]
    letters: re.Pattern[str]
    opening: re.Pattern[str] | None
    plain: bool
    marks: dict[str, str]


@lru_cache(maxsize=1)
def one_byte_tables() -> list[Pair]:
    """The single-byte pairs."""
    tables = []
    for wrote, read in ONE_BYTE + ONE_BYTE_MORE:
        table: dict[str, str] = {}
        marks: dict[str, str] = {}
        for ch in LETTERS + "¿¡—ªº«»":
            try:
                g = ch.encode(wrote).decode(read)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if g in MARKS and ch in LETTERS and ch.islower():
                marks[g] = ch
            if g != ch and not g.isascii() and (g == "\u00b7" or g not in MARKS) and not g.isspace() and (unicodedata.category(g) not in ("Cc", "Cf") or "\x80" <= g <= "\x9f"):
                table[g] = ch
        chars = re.escape("".join(g for g, ch in table.items() if ch in LETTERS))
        if chars:
            opening = "".join(g for g, ch in table.items() if ch in "¿¡—«" and g not in ORDINARY + OTHERS + "\u00bd\u00b0") + "".join(g for g, ch in table.items() if ch in "¿¡—" and g in "íóù")
            mark = re.compile(f"(?<![^\\W\\d_])[{re.escape(opening)}]+(?=[A-ZÁÉÍÓÚÑ][a-záéíóúñ])") if opening else None
            tables.append(Pair(table, re.compile(f"[{chars}]"), mark, (wrote, read) in ONE_BYTE, marks))
    tables += [Pair({"Ã": "Í"}, re.compile("Ã"), None, True, {}), Pair({"Ã": "Á"}, re.compile("Ã"), None, True, {})]  # the second byte was dropped
    return tables


def _east(ch: str) -> bool:
    return bool(ch) and "\u2e7f" < ch < "\ufe00" or "\uff65" <= ch <= "\uff9f"


def _matches(text: str) -> list[tuple[int, int, str]]:
    """Longest automaton matches from left to right that don't overlap, each with what it stood for.

    A form that several pairs give is read by the pair that explains most forms here, then as a Spanish letter, then in
    the order of the pairs.
    """
    found: list[tuple[int, int, list[tuple[int, str]]]] = []
    for end, (garbled, meanings) in automaton().iter(text):
        i, j = end + 1 - len(garbled), end + 1
        if _east(garbled[0]):
            before, after = text[i - 1 : i], text[j : j + 1]
            if any(_east(c) and c not in sequences() for c in (before, after)):
                continue
            near = before.isascii() and before.isalpha(), after.isascii() and after.isalpha()
            meanings = [(k, m) for k, m in meanings if (any(near) or after in ("¿", "¡") or m in "¿¡«»" or len(m) > 1) and (m not in MARKS or any(near))]
        if meanings:
            found.append((i, j, meanings))
    found.sort(key=lambda x: (x[0], -x[1]))
    kept, at = [], -1
    for i, j, meanings in found:
        if i >= at:
            kept.append((i, j, meanings))
            at = j
    votes = Counter(k for _, _, meanings in kept for k in {k for k, _ in meanings})
    return [(i, j, max(meanings, key=lambda x: (votes[x[0]], x[1] in LETTERS, x[1] in MARKS, -x[0]))[1]) for i, j, meanings in kept]


_ESCAPED = re.compile(r"&(?:Atilde|Acirc|acirc|#19[45]|#226|#x[cC][23]|#xe2);")
_REFERENCES = re.compile(r"(?<![^\x00-\x7f;])(?:&#?\w+;|[^\x00-\x7f])*&(?:Atilde|Acirc|acirc|#19[45]|#226|#x[cC][23]|#xe2);(?:&#?\w+;|[^\x00-\x7f])*")


def _decoded(m: re.Match[str]) -> str:
    """A run of references and other non-ASCII characters that was escaped after garbling, decoded; others stay."""
    new = re.sub(r"&#?\w+;", lambda r: c if not (c := html.unescape(r.group())).isascii() else r.group(), m.group())
    return new if _matches(new) else m.group()


def _references(text: str) -> str:
    """Decodes references to non-ASCII characters where garbled text was escaped afterwards."""
    return _REFERENCES.sub(_decoded, text) if "&" in text and _ESCAPED.search(text) else text


def _words_with(text: str, pattern: re.Pattern[str], more: object) -> list[tuple[int, str, int]]:
    """(start, word, end) of the words of letters and ``more`` around the pattern's matches, each once."""
    out, end = [], 0
    for m in pattern.finditer(text):
        if m.start() < end:
            continue
        i, j = m.start(), m.end()
        while i > end and (text[i - 1].isalpha() or text[i - 1] in more):  # type: ignore[operator]
            i -= 1
        while j < len(text) and (text[j].isalpha() or text[j] in more):  # type: ignore[operator]
            j += 1
        out.append((i, text[i:j], j))
        end = j
    return out


Span = tuple[int, int, str]
# Letters of other scripts that look like Latin ones; they say nothing about a wrong reading.
_ALIKE = frozenset("\u0441\u0443\u0421\u0423\u041d\u041a\u043e\u0440\u041e\u0420\u0430\u0410\u0435\u0415\u0445\u0425\u03bd\u03c1\u03c5\u03bf\u03ba")
# Nor do marks that may follow or break a word.
_UNSURE = _ALIKE | frozenset(MARKS)


def _explained(text: str, pair: Pair) -> tuple[int, int, int, list[Span]]:
    """(known words, odd characters, certain signs, spans to restore) of a text read by a pair."""
    near, table = contexts(), pair.table
    strong, odd, sure, spans = 0, 0, 0, []
    for m in pair.opening.finditer(text) if pair.opening else ():
        sure += 1
        spans.append((m.start(), m.end(), "".join(table[c] for c in m.group())))
    for start, word, end in _words_with(text, pair.letters, table):
        new = "".join(table.get(c, c) for c in word)
        cased = new.strip("¿¡—«»")
        low = cased.lower()
        if (pair.plain and (low in accented_words() or low in COMMON) or len(table) > 1 and known(low) and not _UNSURE.intersection(word)) and not known(word.lower()) and (cased.islower() or cased.isupper() or cased.istitle()) and any(c in LETTERS for c in new):
            strong += 1
            spans.append((start, end, new))
            continue
        if len(table) == 1:
            continue
        hits = [i for i, c in enumerate(word) if table.get(c, "") in LETTERS and c in table]
        ok = bool(hits)
        for i in hits:
            c, prev, nxt = word[i], word[i - 1 : i] if i else "", word[i + 1 : i + 2]
            fits = f"{prev or '^'}{new[i]}{nxt or '$'}".lower() in near
            if "\u0370" <= c <= "\u04ff":  # another script inside a Latin word
                case = new[i].islower() == prev.islower() if prev.isalpha() else new[i].isupper() == c.isupper()
                latin = prev.isascii() and prev.isalpha() or nxt.isascii() and nxt.isalpha()
                ok &= c not in _ALIKE and case and latin and (fits or "\u0430" <= c.lower() <= "\u044f")
                continue
            symbol = not c.isalpha() or c in "ªº"
            capital = c.isupper() and prev.islower()
            drawn = "\u2500" <= c <= "\u259f" or capital and nxt.islower()  # no word has those within
            ok &= (symbol or capital) and (drawn or new[i].islower() == (not prev or prev.islower()) and fits) and (prev != "l" or c != "\u00b7")
            sure += drawn
        if ok:
            odd += 1
            sure += any("Ѐ" <= word[i] <= "ӿ" for i in hits)
            spans.append((start, end, new))
    return strong, odd, sure, spans


def _one_byte(text: str) -> tuple[Pair, list[Span], int] | None:
    """The pair that explains the text best, the spans to restore and its known words; None if none does."""
    best, most, present = None, 0, {c for c in set(text) if not c.isascii()}
    odd_ones = present.difference(ORDINARY)
    for pair in one_byte_tables():
        # a pair that needs a known word besides leaves some character that Spanish text hasn't
        if (present if pair.plain else odd_ones).isdisjoint(pair.table):
            continue
        strong, odd, sure, spans = _explained(text, pair)
        score = 3 * strong + odd + sure
        if (strong or pair.plain and (odd > 1 or sure)) and spans and score > most:
            best, most = (pair, spans, strong), score
    return best


def _swept(text: str, pair: Pair) -> list[Span]:
    """All words of a line whose pair is certain that it makes Spanish ones of; marks only within a word."""
    out = []
    for start, word, end in _words_with(text, pair.letters, pair.table):
        new = "".join(pair.table.get(c, c) for c in word)
        bare = new.strip("¿¡—«»")
        odd = [c for c in word if pair.table.get(c, "") in LETTERS and c in pair.table]
        if len(bare) > 1 and not known(word.lower()) and all(c.isascii() or c in LETTERS for c in bare) and not any(c in MARKS and (word.startswith(c) or word.endswith(c)) for c in odd):
            out.append((start, end, new))
    for k, c in enumerate(text):
        if c in pair.marks and text[k - 1 : k].isalpha() and (text[k + 1 : k + 2].islower() or c in "¿¡"):
            out.append((k, k + 1, pair.marks[c]))
    return out


# Symbols that Spanish text may mean, and what never stands in it but as a garbled mark.
_MEANT = frozenset("\u00b1\u00be\u00bc\u00bd\u00b2\u00b3\u00b9\u00a7\u00b6\u00d7\u00f7\u00ae\u2122\u00a3\u00a5\u00a4\u00a2\u00b5\u00b0\u00a9\u00b7")


def _rest(text: str, pair: Pair, spans: list[Span]) -> list[Span]:
    """Characters outside the spans that the pair makes of marks: such as Spanish text has no use for, and odd letters at a word's edge."""
    taken = {k for i, j, _ in spans for k in range(i, j)}
    out = []
    for k, c in enumerate(text):
        meant = pair.table.get(c, "")
        if meant and (meant not in LETTERS or "\u2500" <= c <= "\u259f") and c not in LETTERS and c not in _MEANT and k not in taken and unicodedata.category(c) in ("So", "Sm", "Lu", "Ll", "No", "Sk"):
            edge = any(not x.isalpha() or pair.table.get(x, "") in MARKS for x in (text[k - 1 : k], text[k + 1 : k + 2]))
            if c not in OTHERS or edge:
                out.append((k, k + 1, meant))
    return out


_LOST = re.compile("[?\ufffd]+")


def _fitting(form: str) -> str | None:
    """The only known word of a lower-case form with ``?`` for each lost letter; '' if several fit, None if none does."""
    if (word := lost_index().get(form)) is not None or form.count("?") != 1 or form.startswith("?") or form.endswith("?"):
        return word
    at = form.index("?")
    before, after = form[:at], form[at + 1 :]
    if re.search("[iu]$", before) and re.match("[aeo]", after):
        return f"{before}ñ{after}"  # no accented vowel stands there
    fit = [w for c in "áéíóúñü" if _ENDING.fullmatch(w := before + c + after)]
    return fit[0] if len(fit) == 1 else None


def _lost(text: str) -> list[Span]:
    """Words with letters lost to ``?`` and their restored forms (themselves where several or none fit)."""
    index, todo, at, asked = lost_index(), [], 0, False
    for start, word, end in _words_with(text, _LOST, "?\ufffd"):
        between = text[at:start]
        opened, closed = between.rfind("¿"), max(between.rfind(c) for c in ".!\n")
        question = opened > closed or asked and closed < 0
        at, asked = end, question and "?" not in word
        core = re.sub("[?\ufffd]+", "?", word)
        if core in ("?", "") or _QUERY.match(text, end):
            continue
        low = "".join(c if c.isascii() else "?" for c in core.lower())
        inner = re.search("[A-Za-zÀ-ÿ]\\?[A-Za-zÀ-ÿ]", core)
        meant, lead = index.get(low), 0
        while meant is None and low[lead : lead + 1] == "?" and lead < 2:  # a lost dash or mark before the word
            lead += 1
            meant = index.get(low[lead:].strip("?") if core.count("?") == lead else low[lead:])
        if core.endswith("?") and not inner and not low.startswith("?"):
            if meant is None or question:
                continue
        elif meant is None and not (inner and (core[core.index("?") + 1 :][:1].islower() or core.isupper())):
            continue
        if meant is None and inner and not lead:
            end -= len(word) - len(word.rstrip("?\ufffd"))
            word, core, low = text[start:end], core.rstrip("?"), low.rstrip("?")
            meant = index.get(low) or (_fitting(low) if core.islower() else None)
        if meant:
            letters = [c for c in core if c != "?"]
            meant = meant.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else meant[0].upper() + meant[1:] if core[lead : lead + 1].isupper() else meant
            meant = word[: len(word) - len(word.lstrip("?\ufffd"))] + meant if lead else meant
        todo.append((start, end, meant or word))
    return todo


_QUERY = re.compile(r"\w*[=&/]")


_DIRTY = re.compile(
    f"[^\\x00-\\x7f{ORDINARY}]|[^\\W\\d_][\u00b7\u00bd\u00b0ªº\u201c\u201d\u2018\u2019\u00d7\u00a9\u203a\u2026«»—][a-záéíóúüñ]|[^\\W\\d_]\\?|(?:^|[^\\w]|[\\s>(—])\\?+[^\\W\\d_]"
    "|&(?:Atilde|Acirc|acirc|#19[45]|#226|#x[cC][23]|#xe2);"
)


def _dirty(text: str) -> str:
    """The lines that may hold garbled text."""
    return "\n".join(x for x in text.split("\n") if _DIRTY.search(x)) if "\n" in text else text


def _garbled(text: str) -> bool:
    if "\ufffd" in text or _matches(text) or _references(text) != text:
        return True
    plain = blanked(text)
    return _one_byte(plain) is not None or "?" in plain and bool(_lost(plain))


def is_garbled(text: str | None) -> bool:
    """Whether some passage of the text was garbled, recoverable or not."""
    return bool(text) and bool(text := _dirty(text)) and _garbled(text)


def repair(text: str | None) -> str | None:
    """The text with every garbled span replaced by what it stood for, as far as that can be known."""
    return text if text is None else restored(pa.array([text]), "\n" not in text)[0]


def garbled_rows(column: pa.Array, title: bool = False) -> list[int]:
    """The rows of a column with garbled text."""
    return [row for row, _, lines in lines_with(column, SUSPECT_TITLE if title else SUSPECT) if _garbled("\n".join(lines))]


def restored(column: pa.Array, title: bool = False) -> list[str | None]:
    """The texts of a column, repaired line by line; only lines that may hold garbled text are touched."""
    texts = column.to_pylist()
    for row, numbers, lines in lines_with(column, SUSPECT_TITLE if title else SUSPECT):
        if _garbled("\n".join(lines)) and (new := _repair(lines)) != lines:
            put_lines(texts, row, numbers, new)
    return texts


# It begins where a run of letters or of other characters begins, so each is read once.
_EAST_RUN = re.compile("(?:(?<![A-Za-z])[A-Za-z]+|(?<![A-Za-z\\x80-\\U0010ffff]))[^\\x00-\\x7f]*[\\u2e80-\\ufaff\\uff61-\\uff9f][^\\x00-\\x7f]*[a-z]*")


def _multibyte(m: re.Match[str]) -> str:
    """A run garbled by a multi-byte reader, whose bytes may be split across characters of the text."""
    for read in MULTIBYTE:
        try:
            data = m.group().encode(read)
        except UnicodeEncodeError:
            continue
        for wrote in ("utf-8", "cp1252", "cp850", "mac_roman"):
            try:
                new = data.decode(wrote)
            except UnicodeDecodeError:
                continue
            if new != m.group() and all(c.isascii() or c in LETTERS + MARKS + OTHERS for c in new) and (wrote == "utf-8" or known(new.lower())):
                return new
    return m.group()


def blanked(text: str) -> str:
    """The text with every character of its tags as a blank, so places stay."""
    last = text.rfind(">") + 1
    return TAG.sub(lambda m: " " * len(m.group()), text[:last]) + text[last:] if last else text


def _put(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for i, j, new in sorted(spans, key=lambda x: (x[0], -x[1])):
        if i >= at:
            out += [text[at:i], new]
            at = j
    return "".join([*out, text[at:]])


def _sequences_restored(line: str) -> str:
    for _ in range(3):
        spans = _matches(line)
        if not spans:
            break
        line = _put(line, spans)
    return line


def _repair(lines: list[str]) -> list[str]:
    """A record's suspect lines, repaired: matched sequences, then each line's single-byte pair, then lost letters."""
    new = [_sequences_restored(_EAST_RUN.sub(_multibyte, _references(x))) for x in lines]
    whole = _one_byte("\n".join(blanked(x) for x in new))
    for k, line in enumerate(new):
        plain = blanked(line)
        own = _one_byte(plain) if whole else None
        if own is None and whole is not None and ((spans := _explained(plain, whole[0])[3]) or not any(c.isalnum() and c not in whole[0].table for c in plain)):
            own = (whole[0], spans, 0)
        if own is not None:
            spans = own[1] + (_swept(plain, own[0]) if own[2] > 1 else [])
            line = _put(line, spans + _rest(plain, own[0], spans))
            plain = blanked(line)
        if "?" in plain or "\ufffd" in plain:
            line = _put(line, _lost(plain))
        new[k] = line
    return new
