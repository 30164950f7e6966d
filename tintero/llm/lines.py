"""Vectorised reading of the lines of HTML texts: words, tags and containers as hashes, in numpy.

One call takes a batch of texts and works on their UTF-8 bytes at once; there is no Python loop over characters, words
or ordinary lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

PRIME = np.uint64(1099511628211)
MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, PRIME, dtype=np.uint64), dtype=np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[48:58] = 48
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "()[]{}|/*:?!@#$%_=+"]] = True
_LETTERS = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_LETTERS = (_LETTERS ^ (_LETTERS >> np.uint64(29))) * MIX
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)([^>]*)>")
VOID = frozenset(["br", "hr", "img", "input", "meta", "link", "wbr", "source"])
CHUNK = 64  # texts read at once, so that the arrays stay in the processor's cache
CHUNK_SIZE = 400_000  # and characters, but for a longer text by itself


@dataclass
class Lines:
    """Lines of a batch of texts; ``doc`` and ``no`` give the text and the line's number in it."""

    doc: np.ndarray  # per line
    no: np.ndarray
    start: np.ndarray  # byte range of each line
    end: np.ndarray
    word_line: np.ndarray  # line of each word
    word_hash: np.ndarray  # uint64, of the lower-case word with digits as 0
    word_size: np.ndarray  # bytes
    word_cap: np.ndarray  # bool: begins with a capital
    word_first: np.ndarray  # bool: the line's first word
    word_digit: np.ndarray  # bool: has a digit
    word_link: np.ndarray  # bool: inside <a>
    mark_line: np.ndarray  # line of each punctuation mark
    mark_hash: np.ndarray
    tag_line: np.ndarray  # line of each tag token (names, attributes and their values)
    tag_hash: np.ndarray
    letters: np.ndarray  # per line, a sum over its letters in lower case, digits left out, whatever their order
    letter_count: np.ndarray  # letter bytes per line, at least its letters
    unbalanced: np.ndarray  # lines whose tags open or close a container beyond the line
    buffer: bytes

    def text(self, k: int) -> str:
        return self.buffer[self.start[k] : self.end[k]].decode("utf-8", "replace")


def chunks(sizes: list[int], most: int = CHUNK, budget: int = CHUNK_SIZE) -> list[slice]:
    """Slices of items in order, of at most ``most`` items and the budget in all, but at least one item each."""
    out, at = [], 0
    while at < len(sizes):
        stop, total = at, 0
        while stop < len(sizes) and stop - at < most and (stop == at or total + sizes[stop] <= budget):
            total += sizes[stop]
            stop += 1
        out.append(slice(at, stop))
        at = stop
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each byte range."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    starts, lengths = starts.astype(np.int32), (ends - starts).astype(np.int32)
    offsets = np.zeros(len(starts), dtype=np.int32)
    np.cumsum(lengths[:-1], out=offsets[1:])
    n = int(offsets[-1] + lengths[-1])
    within = np.arange(n, dtype=np.int32) - np.repeat(offsets, lengths)
    at = within + np.repeat(starts, lengths)
    if lengths.max() > 64:  # the powers repeat; the place is mixed in
        value = (data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[within & 63] + (within >> 6).astype(np.uint64)
    else:
        value = (data[at] + np.uint64(1)) * _POWERS[within]
    return (np.add.reduceat(value, offsets) * MIX) ^ (lengths.astype(np.uint64) * PRIME)


def _openings(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tags begin (a "<" before a letter, "/" or "!") and the byte after each."""
    lt = np.flatnonzero(raw == 60)
    after = _LOWER[raw[lt + 1]]
    some = ((after >= 97) & (after <= 122)) | (after == 47) | (after == 33)
    return lt[some], after[some]


def _layout(parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, its bytes, line starts, text and number of each line, which bytes are in tags) of texts one after another.

    A tag ends at the next ">" or line end.
    """
    buffer = b"\n".join(parts) + b"\n  "
    raw = np.frombuffer(buffer, dtype=np.uint8)
    end = np.flatnonzero(raw == 10).astype(np.int32)
    start = np.zeros_like(end)
    start[1:] = end[:-1] + 1
    doc_start = np.zeros(len(parts), dtype=np.int32)
    np.cumsum([len(p) + 1 for p in parts[:-1]], out=doc_start[1:])
    first = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(np.append(first, len(start))))
    no = np.arange(len(start), dtype=np.int32) - first[doc].astype(np.int32)
    lt, _ = _openings(raw)
    stop = np.sort(np.concatenate((np.flatnonzero(raw == 62), end)))
    gt = stop[np.searchsorted(stop, lt)] if len(lt) else lt
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    if len(lt):
        keep = np.concatenate(([True], lt[1:] > gt[:-1]))
        edge[lt[keep]] = 1
        edge[gt[keep]] -= 1
    return buffer, raw, start, doc, no, np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def read(texts: list[str], tags: bool = True) -> Lines:
    """Reads the lines of the texts; an empty text has one empty line.  Without ``tags`` only visible words are read."""
    buffer, raw, start, doc, no, in_tag = _layout([t.encode("utf-8", "replace") for t in texts])
    end = np.append(start[1:] - 1, len(raw) - 3).astype(np.int32)
    lt, after = _openings(raw)
    low = _LOWER[raw]
    letter = _WORD[raw]
    c2, c3, e2 = np.flatnonzero(raw == 0xC2), np.flatnonzero(raw == 0xC3), np.flatnonzero(raw == 0xE2)
    second = raw[c3 + 1]
    wide = c3[(second >= 0x80) & (second <= 0x9E)]
    low[wide + 1] += 0x20
    c2 = c2[(raw[c2 + 1] != 0xAA) & (raw[c2 + 1] != 0xBA)]
    letter[c2] = letter[c2 + 1] = False
    letter[e2] = letter[e2 + 1] = letter[e2 + 2] = False

    seen = letter & ~in_tag
    ws, we = _runs(seen)
    word_line = np.searchsorted(start, ws, side="right").astype(np.int32) - 1
    head = raw[ws]
    word_cap = (head >= 65) & (head <= 90)
    if len(wide):
        at = np.searchsorted(ws, wide)
        at = at[(at < len(ws)) & (ws[np.minimum(at, len(ws) - 1)] == wide)] if len(ws) else at[:0]
        word_cap[at] = True
    word_first = np.ones(len(ws), dtype=bool)
    word_first[1:] = word_line[1:] != word_line[:-1]
    word_digit = np.zeros(len(ws), dtype=bool)
    if len(ws):
        word_digit[np.searchsorted(ws, np.flatnonzero(_DIGIT[raw] & seen), side="right") - 1] = True
    none = np.zeros(0, dtype=np.int32)
    word_hash = _hashes(low, ws, we)
    if not tags:
        text = seen & ~_DIGIT[raw]
        at = np.flatnonzero(text)
        line = np.searchsorted(at, start)  # place of each line's first letter
        total = np.zeros(len(at) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[low[at]], out=total[1:])
        stop = np.append(line[1:], len(at))
        return Lines(doc, no, start, end, word_line, word_hash, we - ws, word_cap, word_first, word_digit, none, none, none, none, none, total[stop] - total[line], stop - line, none, buffer)

    sign = np.flatnonzero(_SIGN[raw] & ~in_tag)
    wide_mark = np.concatenate((c2, e2))
    wide_mark = wide_mark[~in_tag[wide_mark]]
    mark = np.concatenate((sign, wide_mark))
    key = raw[mark].astype(np.uint64)
    key[len(sign) :] = (key[len(sign) :] << np.uint64(16)) | (raw[wide_mark + 1].astype(np.uint64) << np.uint64(8)) | np.where(raw[wide_mark] == 0xE2, raw[wide_mark + 2], 0).astype(np.uint64)
    mark_line = np.searchsorted(start, mark, side="right").astype(np.int32) - 1

    ts, te = _runs((_WORD[raw] | (raw == 47)) & in_tag & ~_DIGIT[raw])
    tag_line = np.searchsorted(start, ts, side="right").astype(np.int32) - 1
    third, fourth = _LOWER[raw[lt + 2]], _LOWER[raw[np.minimum(lt + 3, len(raw) - 1)]]
    opens_a = lt[(after == 97) & ~_WORD[third]]
    closes_a = lt[(after == 47) & (third == 97) & ~_WORD[fourth]]
    word_link = np.searchsorted(opens_a, ws) > np.searchsorted(closes_a, ws)
    lt_line = np.searchsorted(start, lt, side="right") - 1
    closing = after == 47
    void = ((after == 98) & (third == 114)) | ((after == 104) & (third == 114)) | ((after == 105) & (third == 109) & (fourth == 103)) | (after == 33)
    balance = np.bincount(lt_line, np.where(void, 0, np.where(closing, -1, 1)), len(start))
    return Lines(doc, no, start, end, word_line, word_hash, we - ws, word_cap, word_first, word_digit, word_link, mark_line, key * MIX, tag_line, _hashes(low, ts, te), none, none, np.flatnonzero(balance), buffer)


_PAIRS = np.arange(1, 65537, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_PAIRS = (_PAIRS ^ (_PAIRS >> np.uint64(29))) * MIX


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, key) of every line with visible text.

    Lines have the same key if what they show agrees in its neighbouring characters when letter case, digits and white
    space are ignored; lines of digits alone have no key.
    """
    docs, nos, values = [], [], []
    for part in chunks([len(t) for t in texts]):
        raw, start, doc, no, in_tag = _layout([t.encode("utf-8", "replace") for t in texts[part]])[1:]
        low = _LOWER[raw]
        c3 = np.flatnonzero(raw == 0xC3)
        low[c3[(raw[c3 + 1] >= 0x80) & (raw[c3 + 1] <= 0x9E)] + 1] += 0x20
        at = np.flatnonzero(~in_tag & (raw > 32) & ~_DIGIT[raw])
        first = np.searchsorted(at, start)
        pair = low[at].astype(np.uint16)
        before = np.zeros(len(at), dtype=np.uint16)
        before[1:] = pair[:-1]
        before[first[first < len(at)]] = 0
        total = np.zeros(len(at) + 1, dtype=np.uint64)
        np.cumsum(_PAIRS[(before << np.uint16(8)) | pair], out=total[1:])
        stop = np.append(first[1:], len(at))
        some = np.flatnonzero(stop > first)
        docs.append(doc[some] + part.start)
        nos.append(no[some])
        values.append(total[stop[some]] - total[first[some]])
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(nos), np.concatenate(values)


def containers(lines: Lines) -> np.ndarray:
    """A hash of the tags left open before each line within its text (0 at top level).

    Only lines that open or close more than they hold are read in Python.
    """
    path = np.zeros(len(lines.doc), dtype=np.uint64)
    stack: list[str] = []
    doc, since, value = -1, 0, 0
    bounds: list[tuple[int, int, int]] = []
    doc_last = np.searchsorted(lines.doc, np.arange(lines.doc[-1] + 1 if len(lines.doc) else 0), side="right")
    for k in lines.unbalanced.tolist():
        d = int(lines.doc[k])
        if d != doc:
            if value:
                bounds.append((since, int(doc_last[doc]), value))
            stack, doc, value = [], d, 0
        elif value:
            bounds.append((since, k + 1, value))
        for m in _TAG.finditer(lines.text(k)):
            name = m.group(2).lower()
            if name in VOID or m.group(3).endswith("/"):
                continue
            if not m.group(1):
                stack.append(name + re.sub(r"\d+", "", m.group(3).lower()))
            else:
                while stack and not (top := stack.pop()).startswith(name):
                    pass
        since = k + 1
        value = hash_text(">".join(stack)) if stack else 0
    if value:
        bounds.append((since, int(doc_last[doc]), value))
    for a, b, v in bounds:
        path[a:b] = v
    return path


def hash_text(text: str) -> int:
    """A stable hash of a short text."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return int(_hashes(data, np.array([0]), np.array([len(data)]))[0]) or 1


def minhash(lines: Lines, keep: np.ndarray, rounds: int) -> np.ndarray:
    """(lines, rounds) minima of the hashes of the kept words; lines without any have the largest value."""
    out = np.full((len(lines.doc), rounds), np.iinfo(np.uint64).max, dtype=np.uint64)
    at, h = lines.word_line[keep], lines.word_hash[keep]
    if not len(at):
        return out
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    for r in range(rounds):
        salt = np.uint64((0xD6E8FEB86659FD93 * (2 * r + 3)) & 0xFFFFFFFFFFFFFFFF)
        v = (h ^ salt) * MIX
        out[at[begin], r] = np.minimum.reduceat(v ^ (v >> np.uint64(31)), begin)
    return out
