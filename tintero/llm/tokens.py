"""Encoding of a corpus with a public tokenizer (problem 6).

The tiktoken library runs over a rank file that lies in the tokenizers' folder, whose path is a parameter; a worker
loads it once.  Texts above ``LONG`` characters are first cut at safe boundaries: before a white space that follows
another character, or before a letter that follows a sign other than an apostrophe, as the pattern always ends a piece
there; so the ids are those of the whole text, in languages without spaces as well.

Defined cases: null and empty texts both have the empty list; text is encoded as it stands, and strings that look like
special tokens are ordinary text; decoding goes through raw bytes, so tokens that hold part of a character are safe.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

def _folder() -> str:
    """TINTERO_TOKENIZERS, else /opt/tokenizers, else where the package with the files is installed."""
    named = os.environ.get("TINTERO_TOKENIZERS") or "/opt/tokenizers"
    if not os.path.isdir(named) and (found := importlib.util.find_spec("public_tokenizers")) and found.origin:
        return os.path.dirname(found.origin)
    return named


FOLDER = _folder()
LONG = 20_000
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[^\s\p{L}\p{N}'])(?=\p{L})")


@lru_cache(maxsize=4)
def encoding(name: str, folder: str = FOLDER):  # noqa: ANN201
    """The tokenizer of a rank file ``<name>.tiktoken``, without special tokens."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: the pre-splitting pattern that belongs to the byte-level rank files.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pieces(text: str, long: int = LONG) -> list[str]:
    """The text in pieces whose encodings add up to its own."""
    if len(text) <= long:
        return [text]
    out, at = [], 0
    while len(text) - at > long:
        cut = _SAFE.search(text, at + long // 2)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@lru_cache(maxsize=4)
def encoder(name: str, folder: str = FOLDER) -> Callable[[str], list[int]]:
    """The encoding function of a vocabulary by its file: a rank file, a ``tokenizers`` file or a ``sentencepiece`` model."""
    if os.path.isfile(f"{folder}/{name}.tiktoken"):
        return encoding(name, folder).encode_ordinary
    if os.path.isfile(f"{folder}/{name}.json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(f"{folder}/{name}.json")
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=f"{folder}/{name}.model")
    return lambda text: p.encode(text, num_threads=1)


def encode(text: str | None, name: str, folder: str = FOLDER) -> list[int]:
    """The token ids of a text; those of null and empty texts are none.  Only rank files' texts are cut."""
    if not text:
        return []
    one = encoder(name, folder)
    if len(text) <= LONG or not os.path.isfile(f"{folder}/{name}.tiktoken"):
        return one(text)
    return [i for piece in pieces(text) for i in one(piece)]


def decode(ids: list[int], name: str, folder: str = FOLDER) -> str:
    """The text of token ids, joined as bytes before they are read as UTF-8."""
    enc = encoding(name, folder)
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", "replace")


def token_ids(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str = FOLDER) -> DataFrame:
    """(id, ids): every row's text as token ids; one pass, no shuffle."""
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [encode(t, tokenizer, folder) for t in batch.column(1).to_pylist()]
        offsets = np.zeros(len(each) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in each], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(each), dtype=np.int32, count=int(offsets[-1]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

    return arrow_map(_source(df, id_col, text_col), run, "id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str, folder: str = FOLDER) -> DataFrame:
    """(id, n_tokens): the number of tokens of every row's text."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t, tokenizer, folder)) for t in batch.column(1).to_pylist()], pa.int64())], schema=schema)

    return arrow_map(_source(df, id_col, text_col), run, "id long, n_tokens long")


def decoded(df: DataFrame, id_col: str, ids_col: str, tokenizer: str, folder: str = FOLDER) -> DataFrame:
    """(id, text): the texts of token ids."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode(x, tokenizer, folder) for x in batch.column(1).to_pylist()], pa.string())], schema=schema)

    ids: Column = F.col(ids_col).cast("array<int>")
    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), ids.alias("ids")), run, "id long, text string")


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
