"""Recurrent block labeller for page boilerplate (problem 3).

A text's lines are its leaf sequence.  Each line becomes a vector: the mean of its hashed words' vectors, sums of the
vectors of its punctuation and of its tag tokens, the vector of the containers open around it (its tag path) and a few
counts.  A bidirectional LSTM in numpy reads the whole sequence both ways, so each line is classified with the context
of the whole document.  The weights are trained by ``train.py`` and lie in ``models/``.

Defined cases: null texts and empty texts have no lines of the page; lines without visible text are never labelled;
texts of any length are read whole (long ones in batches of their own).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import confusables, mojibake
from .common import arrow_map, batch_of
from .lines import CHUNK, Lines, chunks, containers, read
from .mojibake import MODELS

MODEL = MODELS / "blocks.npz"
WORDS, MARKS, TAGS, PATHS = 4096, 256, 512, 256
WIDTHS = {"word": 16, "mark": 8, "tag": 8, "path": 8}
COUNTS = 9
HIDDEN = 24
STEPS = 256


def _bucket(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (size - 1)


class Batch:
    """Features of the lines of some texts, before the trained vectors are looked up."""

    def __init__(self, texts: list[str]) -> None:
        x: Lines = read(texts)
        n = len(x.doc)
        self.lines, self.n_docs = x, len(texts)
        self.words = np.bincount(x.word_line, minlength=n).astype(np.float32)
        marks = np.bincount(x.mark_line, minlength=n)
        self.visible = (self.words > 0) | (marks > 0)
        tags = np.bincount(x.tag_line, minlength=n)
        size = np.bincount(x.word_line, x.word_size, n)
        some = np.maximum(self.words, 1)
        last = np.ones(n, dtype=np.float32)
        last[:-1] = x.doc[1:] != x.doc[:-1]
        self.counts = np.stack(
            [
                np.log1p(self.words) / 3, np.log1p(size) / 5, np.bincount(x.word_line, x.word_cap, n) / some, np.bincount(x.word_line, x.word_digit, n) / some,
                np.bincount(x.word_line, x.word_link, n) / some, ~self.visible, x.no == 0, last, np.log1p(tags) / 2,
            ],
            axis=1,
        ).astype(np.float32)
        self.word_at, self.mark_at, self.tag_at = _bucket(x.word_hash, WORDS), _bucket(x.mark_hash, MARKS), _bucket(x.tag_hash, TAGS)
        path = containers(x)
        self.path_at = np.where(path == 0, 0, 1 + _bucket(path * np.uint64(0x9E3779B97F4A7C15), PATHS - 1) % (PATHS - 1)).astype(np.int64)


def _pool(at: np.ndarray, line: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """Sum of the table's rows ``at`` by line; ``line`` ascends."""
    out = np.zeros((n, table.shape[1]), dtype=np.float32)
    if len(at):
        begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        out[line[begin]] = np.add.reduceat(table[at], begin, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The labeller's parameters, forward pass and training."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = p

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        width = sum(WIDTHS.values()) + COUNTS
        p = {k: r.normal(0, 0.1, (n, WIDTHS[k])) for k, n in (("word", WORDS), ("mark", MARKS), ("tag", TAGS), ("path", PATHS))}
        for way in "fb":
            p["x" + way] = r.normal(0, 1 / np.sqrt(width), (width, 4 * HIDDEN))
            p["h" + way] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p["b" + way] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
        p["out"], p["bias"] = r.normal(0, 0.2, (2 * HIDDEN + width, 1)), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def save(self, path: object) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: object) -> Network:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def inputs(self, b: Batch) -> np.ndarray:
        x, n = b.lines, len(b.words)
        order = np.argsort(x.mark_line, kind="stable")
        return np.concatenate(
            [
                _pool(b.word_at, x.word_line, self.p["word"], n) / np.sqrt(np.maximum(b.words, 1))[:, None],
                _pool(b.mark_at[order], x.mark_line[order], self.p["mark"], n),
                _pool(b.tag_at, x.tag_line, self.p["tag"], n),
                self.p["path"][b.path_at],
                b.counts,
            ],
            axis=1,
        )

    def _run(self, x: np.ndarray, live: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H); ``live`` has the number of texts that reach each step (texts are sorted by length)."""
        steps, width = x.shape[0], x.shape[1]
        gates, lo, hi = None, 0, 0  # computed for some steps at a time
        h, c = np.zeros((width, HIDDEN), np.float32), np.zeros((width, HIDDEN), np.float32)
        out = np.zeros((steps, width, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            if not lo <= t < hi:
                lo, hi = (t, min(steps, t + STEPS)) if way == "f" else (max(0, t - STEPS + 1), t + 1)
                gates = x[lo:hi] @ self.p["x" + way] + self.p["b" + way]
            m = live[t]
            g = gates[t - lo, :m] + h[:m] @ self.p["h" + way]
            s = _sigmoid(g[:, : 3 * HIDDEN])
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            a = np.tanh(g[:, 3 * HIDDEN :])
            before, hidden = c[:m].copy() if keep is not None else c[:m], h[:m].copy() if keep is not None else None
            now = f * before + i * a
            tc = np.tanh(now)
            c[:m], h[:m] = now, o * tc
            out[t, :m] = h[:m]
            if keep is not None:
                keep.append((t, m, f, i, o, a, before, tc, hidden))
        return out

    @staticmethod
    def _pad(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        lengths = np.bincount(b.lines.doc, minlength=b.n_docs)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        live = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
        return rank[b.lines.doc], b.lines.no.astype(np.int64), live, int(lengths.max())

    def logits(self, b: Batch, keep: dict | None = None) -> np.ndarray:
        flat = self.inputs(b)
        col, row, live, steps = self._pad(b)
        x = np.zeros((steps, b.n_docs, flat.shape[1]), np.float32)
        x[row, col] = flat
        kf, kb = ([], []) if keep is not None else (None, None)
        hf, hb = self._run(x, live, "f", kf), self._run(x, live, "b", kb)
        top = np.concatenate([hf[row, col], hb[row, col], flat], axis=1)
        if keep is not None:
            keep |= {"x": x, "row": row, "col": col, "top": top, "kf": kf, "kb": kb, "flat": flat}
        return (top @ self.p["out"])[:, 0] + self.p["bias"][0]

    def probabilities(self, texts: list[str]) -> list[tuple[Batch, np.ndarray]]:
        """Per batch its features and each line's probability of being part of the page; texts of like length go together."""
        b = Batch(texts)
        return [(b, _sigmoid(self.logits(b)))]

    # training

    def _back(self, kept: list, x: np.ndarray, grad: np.ndarray, way: str, g: dict[str, np.ndarray]) -> np.ndarray:
        dx_gates = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        wh = self.p["h" + way]
        for t, m, f, i, o, a, before, tc, hidden in reversed(kept):
            d = grad[t, :m] + dh[:m]
            dcell = dc[:m] + d * o * (1 - tc * tc)
            dg = np.concatenate([dcell * before * f * (1 - f), dcell * a * i * (1 - i), d * tc * o * (1 - o), dcell * i * (1 - a * a)], axis=1)
            g["h" + way] += hidden.T @ dg
            dh[:m], dc[:m] = dg @ wh.T, dcell * f
            dx_gates[t, :m] = dg
        flat = dx_gates.reshape(-1, 4 * HIDDEN)
        g["x" + way] += x.reshape(-1, x.shape[2]).T @ flat
        g["b" + way] += flat.sum(0)
        return dx_gates @ self.p["x" + way].T

    def step(self, b: Batch, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        keep: dict = {}
        z = self.logits(b, keep)
        known = labels >= 0
        y = np.where(known, labels, 0).astype(np.float32)
        prob = _sigmoid(z)
        dz = np.where(known, prob - y, 0).astype(np.float32) / max(1, known.sum())
        loss = float((-np.log(np.clip(np.where(y > 0, prob, 1 - prob), 1e-7, 1)) * known).sum() / max(1, known.sum()))
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = keep["top"].T @ dz[:, None], dz.sum(keepdims=True)
        dtop = dz[:, None] @ self.p["out"].T
        x, row, col = keep["x"], keep["row"], keep["col"]
        grads = []
        for k, way, lo in (("kf", "f", 0), ("kb", "b", HIDDEN)):
            full = np.zeros((*x.shape[:2], HIDDEN), np.float32)
            full[row, col] = dtop[:, lo : lo + HIDDEN]
            grads.append(self._back(keep[k], x, full, way, g))
        dflat = dtop[:, 2 * HIDDEN :] + (grads[0] + grads[1])[row, col]
        at = np.cumsum([0, *WIDTHS.values()])
        dword = dflat[:, at[0] : at[1]] / np.sqrt(np.maximum(b.words, 1))[:, None]
        np.add.at(g["word"], b.word_at, dword[b.lines.word_line])
        np.add.at(g["mark"], b.mark_at, dflat[b.lines.mark_line, at[1] : at[2]])
        np.add.at(g["tag"], b.tag_at, dflat[b.lines.tag_line, at[2] : at[3]])
        np.add.at(g["path"], b.path_at, dflat[:, at[3] : at[4]])
        return loss, g

    def fit(self, fit: list[tuple[str, list[int]]], held: list[tuple[str, list[int]]], epochs: int, seed: int, size: int = 48) -> None:
        rng = np.random.default_rng(seed)
        m, v, n = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for epoch in range(epochs):
            rate, total = 0.01 * 0.5**epoch, 0.0
            order = np.argsort([len(y) for _, y in fit], kind="stable")
            groups = [order[k : k + size] for k in range(0, len(order), size)]
            for k in rng.permutation(len(groups)):
                part = [fit[j] for j in groups[k]]
                b = Batch([t for t, _ in part])
                # some words are hidden, so that the network leans on context as well
                b.word_at = np.where(rng.random(len(b.word_at)) < 0.1, rng.integers(0, WORDS, len(b.word_at)), b.word_at)
                loss, g = self.step(b, np.concatenate([np.array(y) for _, y in part]))
                total += loss
                n += 1
                for name in self.p:
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**n)) / (np.sqrt(v[name] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
            print("epoch", epoch, "loss", round(total / len(groups), 5), "held out", self.test(held), flush=True)

    def test(self, held: list[tuple[str, list[int]]]) -> dict[str, float]:
        tp = fp = fn = 0
        for k in range(0, len(held), CHUNK):
            part = held[k : k + CHUNK]
            for b, prob in self.probabilities([t for t, _ in part]):
                y = np.concatenate([np.array(y) for _, y in part])
                hit = (prob > 0.5) & (y >= 0)
                tp, fp, fn = tp + int((hit & (y == 1)).sum()), fp + int((hit & (y == 0)).sum()), fn + int((~hit & (y == 1)).sum())
        return {"precision": round(tp / max(1, tp + fp), 5), "recall": round(tp / max(1, tp + fn), 5)}


@lru_cache(maxsize=1)
def network() -> Network:
    return Network.load(MODEL)


def _clean(texts: list[str]) -> list[str]:
    """Garbled and confusable lines are read in their restored form; line numbers stay."""
    return confusables.normalized(pa.array(mojibake.restored(pa.array(texts, pa.string())), pa.string()))  # type: ignore[return-value]


def page_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, line number) of the lines with visible text that belong to the page around the main content."""
    if not texts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    docs, nos, texts = [], [], _clean(texts)
    order = sorted(range(len(texts)), key=lambda k: texts[k].count("\n"))  # texts of like length go together
    for some in chunks([len(texts[k]) + CHUNK * texts[k].count("\n") for k in order]):
        part = order[some]
        for b, prob in network().probabilities([texts[k] for k in part]):
            hit = np.flatnonzero((prob > 0.5) & b.visible)
            docs.append(np.array(part, dtype=np.int32)[b.lines.doc[hit]])
            nos.append(b.lines.no[hit])
    docs, nos = np.concatenate(docs), np.concatenate(nos)
    by = np.lexsort((nos, docs))
    return docs[by], nos[by]


_FOUND = pa.schema([("id", pa.int64()), ("line_no", pa.int32())])
_MAIN = pa.schema([("id", pa.int64()), ("main", pa.string())])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def boilerplate_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no) of all lines that are part of the page; one pass, no shuffle."""

    data = confusables.unicode_data()

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        confusables.use(data)
        some = batch.filter(batch.column(1).is_valid())
        docs, nos = page_lines(some.column(1).to_pylist())
        return batch_of(_FOUND, some.column(0).take(pa.array(docs)), nos)

    return arrow_map(_source(df, id_col, text_col).where(F.col("text") != ""), label, "id long, line_no int")


def main_content(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, main): each text without the lines of the page; null stays null."""

    data = confusables.unicode_data()

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        confusables.use(data)
        texts = batch.column(1).to_pylist()
        some = [k for k, t in enumerate(texts) if t]
        docs, nos = page_lines([texts[k] for k in some])
        for k in set(docs.tolist()):
            drop = set(nos[docs == k].tolist())
            texts[some[k]] = "\n".join(x for n, x in enumerate(texts[some[k]].split("\n")) if n not in drop)
        return batch_of(_MAIN, batch.column(0), texts)

    return arrow_map(_source(df, id_col, text_col), keep, "id long, main string")
