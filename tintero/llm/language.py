"""Languages of documents and of their segments (problem 8).

Multinomial naive Bayes over hashed character n-grams (three and four characters, and single ones for the script).
The matrix of log-probabilities is trained by ``train.py``, lies in ``models/`` and reaches every worker once; a batch
of texts is scored at once in numpy, as the rows its n-grams select summed by line.

Lines with at least ``LEAST_LETTERS`` letters are classified; between the lines of one text a change of language costs
``SWITCH`` nats, so a doubtful line follows its neighbours.  A segment is a maximal run of such lines in one language.
Its confidence is the posterior of all its lines' evidence together, so that of a long segment comes near 1; letters
drawn out (the same three times over) are no evidence.

Defined cases: a null text, or one without letters, has no segment and no language (null, confidence 0); a text whose
lines are all short is judged as a whole, without segments; lines of any length are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of
from .mojibake import MODELS

LANGUAGES = ("es", "pt", "en", "ca", "fr", "it", "de", "ru", "ja")
LEAST_LETTERS = 25
SWITCH = 1.0
BUCKETS = 1 << 15
MODEL = MODELS / "language.npz"
SAMPLE = 6_000  # documents the model is fitted on, at most
SCALE = 0.25  # n-grams overlap, so their evidence counts for less
CHUNK = 120_000  # characters scored at once


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and what it counts as (letters themselves, all else a blank)."""
    letter = np.zeros(0x32000, dtype=bool)
    for i in range(len(letter)):
        letter[i] = not 0xD800 <= i <= 0xDFFF and chr(i).isalpha()
    code = np.where(letter, np.arange(len(letter)), 32).astype(np.uint32)
    code[10] = 10
    code[39] = code[0x2019] = 39
    return letter, code


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, line starts, letters per line) of the lines of some texts one after another, in lower case."""
    letter, code = _tables()
    point = np.frombuffer(("\n".join(texts) + "\n").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    point = np.minimum(point, len(code) - 1)
    c = code[point]
    ends = np.flatnonzero(c == 10)
    start = np.zeros(len(ends), dtype=np.int64)
    start[1:] = ends[:-1] + 1
    return c, start, np.add.reduceat(letter[point].view(np.uint8), start, dtype=np.int32)


def _grams(c: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Buckets (3, characters) of the n-grams that begin at the characters from ``lo`` to ``hi``; 0 stands for none."""
    n = hi - lo
    wide = np.full(n + 3, 10, dtype=np.uint32)
    wide[: min(len(c), hi + 3) - lo] = c[lo : hi + 3]
    c = wide[:n]
    breaks = wide == 10
    b1, b2, b3 = breaks[1 : n + 1], breaks[2 : n + 2], breaks[3 : n + 3]
    a = c * np.uint32(0x9E3779B1)
    ab = (a ^ (a >> np.uint32(15))) + wide[1 : n + 1] * np.uint32(0x85EBCA77)
    tri = (ab ^ (ab >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + wide[2 : n + 2] * np.uint32(0x27D4EB2F)
    tri ^= tri >> np.uint32(15)
    four = (tri * np.uint32(0x165667B1)) ^ (wide[3 : n + 3] * np.uint32(0x9E3779B1))
    four = (four ^ (four >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    no3 = breaks[:n] | b1 | b2
    blank = (c == 32) & (wide[1 : n + 1] == 32)
    out = np.stack([a >> np.uint32(17), (tri * np.uint32(0x2C1B3C6D)) >> np.uint32(17), four >> np.uint32(17)]).astype(np.int32)
    same = (c == wide[1 : n + 1]) & (c == wide[2 : n + 2])  # a letter drawn out says nothing
    out[0][(c == 10) | (c == 32) | same] = 0
    out[1][no3 | blank | same] = 0
    out[2][no3 | b3 | blank | same] = 0
    return out


def _sums(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, scores by language) of the lines of some texts; a long text is summed in slices."""
    c, start, letters = _codes(texts)
    total = np.zeros((len(start), table.shape[1]), dtype=np.float32)
    for lo in range(0, len(c), CHUNK):
        hi = min(len(c), lo + CHUNK)
        first = int(np.searchsorted(start, lo, side="right")) - 1
        last = int(np.searchsorted(start, hi, side="left"))
        at = np.maximum(start[first:last] - lo, 0)
        for row in _grams(c, lo, hi):
            total[first:last] += np.add.reduceat(table[row], at, axis=0)
    return letters, total


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    with np.load(MODEL) as z:
        return z["weights"].astype(np.float32)


def line_scores(texts: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, letters, scores by language) of every line of the texts."""
    table = weights() if table is None else table
    docs, nos, letters, scores = [], [], [], []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) <= CHUNK):
            size += len(texts[stop]) + 1
            stop += 1
        part = texts[at:stop]
        count, total = _sums(part, table)
        per = np.array([t.count("\n") + 1 for t in part])
        docs.append(np.repeat(np.arange(at, stop), per))
        nos.append(np.arange(len(count)) - np.repeat(np.cumsum(per) - per, per))
        letters.append(count)
        scores.append(total)
        at = stop
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, table.shape[1]), np.float32)
    return np.concatenate(docs), np.concatenate(nos), np.concatenate(letters), np.concatenate(scores)


def _posterior(scores: np.ndarray) -> np.ndarray:
    z = scores * SCALE
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def _smooth(scores: np.ndarray) -> np.ndarray:
    """The best sequence of languages over the lines of one text."""
    best, back = scores[0].copy(), np.zeros(scores.shape, dtype=np.int64)
    for t in range(1, len(scores)):
        top = int(best.argmax())
        stay = best >= best[top] - SWITCH
        back[t] = np.where(stay, np.arange(len(best)), top)
        best = np.where(stay, best, best[top] - SWITCH) + scores[t]
    out = np.zeros(len(scores), dtype=np.int64)
    out[-1] = int(best.argmax())
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first line, language, confidence, lines) of every segment."""
    doc, no, letters, scores = line_scores(texts)
    some = letters >= LEAST_LETTERS
    doc, no, scores = doc[some], no[some], scores[some] * SCALE
    lang = scores.argmax(axis=1) if len(scores) else np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    stop = np.append(begin[1:], len(doc))
    mixed = np.minimum.reduceat(lang, begin) != np.maximum.reduceat(lang, begin) if len(begin) else np.zeros(0, bool)
    for a, b in zip(begin[mixed].tolist(), stop[mixed].tolist(), strict=True):
        lang[a:b] = _smooth(scores[a:b])
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])))) if len(doc) else np.zeros(0, np.int64)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0), empty
    count = np.diff(np.append(first, len(doc)))
    total = np.add.reduceat(scores, first, axis=0)
    z = np.exp(total - total.max(axis=1, keepdims=True))
    confidence = (z / z.sum(axis=1, keepdims=True))[np.arange(len(first)), lang[first]]
    return doc[first], no[first], lang[first], confidence, count


_SEGMENTS = pa.schema([("id", pa.int64()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("lines", pa.int32()), ("label", pa.string())])
_DOCUMENTS = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("label", pa.string())])


def _source(df: DataFrame, id_col: str, text_col: str, label_col: str | None) -> DataFrame:
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), label.alias("label"))


def document_segments(df: DataFrame, id_col: str, text_col: str, label_col: str | None = None) -> DataFrame:
    """(id, line_no, lang, confidence, lines, label) of every segment of every text; one pass, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, no, lang, confidence, count = segments([t or "" for t in batch.column(1).to_pylist()])
        at = pa.array(doc)
        return batch_of(_SEGMENTS, batch.column(0).take(at), no, [LANGUAGES[k] for k in lang], confidence, count, batch.column(2).take(at))

    return arrow_map(_source(df, id_col, text_col, label_col).where("text IS NOT NULL"), run, "id long, line_no int, lang string, confidence double, lines int, label string")


def document_languages(df: DataFrame, id_col: str, text_col: str, label_col: str | None = None) -> DataFrame:
    """(id, lang, confidence, label): the language of every document as a whole."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        doc, _, letters, scores = line_scores(texts)
        begin = np.searchsorted(doc, np.arange(len(texts)))
        total, count = np.add.reduceat(scores, begin, axis=0), np.add.reduceat(letters, begin)
        post, lang = _posterior(total), total.argmax(axis=1)
        named = [LANGUAGES[k] if n else None for k, n in zip(lang.tolist(), count.tolist(), strict=True)]
        return batch_of(_DOCUMENTS, batch.column(0), named, np.where(count > 0, post[np.arange(len(texts)), lang], 0.0), batch.column(2))

    return arrow_map(_source(df, id_col, text_col, label_col), run, "id long, lang string, confidence double, label string")


def mislabelled_segments(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, line_no, lang) of the segments in another language than the document's label names.

    ``labels`` (label, lang) is a dimension; labels that are null, unknown or name no language agree with nothing.
    """
    known = labels.where("label IS NOT NULL AND lang IS NOT NULL").select(F.col("label").alias("known_label"), F.col("lang").alias("known_lang")).dropDuplicates(["known_label"])
    found = document_segments(df, id_col, text_col, label_col)
    joined = found.join(known, F.col("label") == F.col("known_label"), "left")
    return joined.where(~F.col("lang").eqNullSafe(F.col("known_lang"))).select("id", "line_no", "lang")


def train_language(data: str, rounds: int = 3, alpha: float = 0.5) -> None:
    """Fits the matrix on at most ``SAMPLE`` labelled documents; lines that contradict their label are left out after the first round."""
    import pyarrow.parquet as pq

    names = {r["label"]: r["lang"] for r in pq.read_table(f"{data}/lang_labels.parquet").to_pylist()}
    docs = pq.read_table(f"{data}/documents.parquet", columns=["text", "lang"]).to_pylist()
    known = [(r["text"], LANGUAGES.index(names[r["lang"]])) for r in docs if r["text"] and names.get(r["lang"]) in LANGUAGES]
    by: dict[int, list[str]] = {}
    for k in np.random.default_rng(11).permutation(len(known)):
        text, lang = known[k]
        if len(by.setdefault(lang, [])) < SAMPLE // len(LANGUAGES):
            by[lang].append(text)
    table = None
    for step in range(rounds):
        counts = np.full((BUCKETS, len(LANGUAGES)), alpha)
        kept = seen = 0
        for lang, texts in by.items():
            for at in range(0, len(texts), 50):
                part = texts[at : at + 50]
                c, start, letters = _codes(part)
                grams, use = _grams(c, 0, len(c)), letters >= 10
                if table is not None:
                    use &= _sums(part, table)[1].argmax(axis=1) == lang
                kept, seen = kept + int(use.sum()), seen + int((letters >= 10).sum())
                mask = np.repeat(use, np.diff(np.append(start, grams.shape[1])))
                for row in grams:
                    counts[:, lang] += np.bincount(row[mask], minlength=BUCKETS)
        counts[0] = 1
        table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        table -= table.mean(axis=1, keepdims=True)
        table[0] = 0
        print("round", step, "lines kept", kept, "of", seen, flush=True)
    np.savez_compressed(MODEL, weights=table.astype(np.float16))
