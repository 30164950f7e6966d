"""Lines repeated across one site's documents (problem 5).

Numbers, dates and names are masked (their words are left out) and each line gets a MinHash signature in three bands of
two rows, plus a fourth band of all its letters regardless of order, by which lines of the same letters always meet.
Lines of one site with the same value of a band are clustered; a line belongs to a cluster if its masked words are
similar enough to those of the cluster's most frequent form, and what isn't similar is clustered again.

Pass one finds candidate clusters without shuffling lines: a batch reports only clusters that reach half the share of a
site's documents in it.  From that follows the most documents that a cluster can have (those reported, and less than
half the share of all others), and only clusters that may reach the bound are candidates.  Pass two reports the lines
that pass a filter of the candidates, whose size is fixed, with their exact keys and masked forms; counts are exact from
there on.  Counting is pre-aggregated and grouped by (site, key) or (site, form), so a site of any size is spread.  A
site with fewer than 2 / share documents in a batch reports all its bands of it, but its lines are candidates only if
they are in enough of its documents.

``repeated_lines`` gives the occurrences of lines that are the same but for letter case, digits and white space;
``without_repeated_lines`` also removes near-duplicate clusters of high document frequency.

Defined cases: null texts count for nothing; rows of a null site form a site of their own; lines with fewer than ten
letters never count, nor near-duplicates that keep less than that, or have two names to a word, when masked; each
row counts as one document, also one delivered again; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, bit_filter, materialize, may_hold, visible
from .lines import MIX, chunks, hash_text, minhash, read

LEAST_LETTERS = 10
SIMILAR = 0.8
ROWS = 2  # MinHash rows of a band
FINE_ROWS, FINE_BANDS = 4, 6  # of the bands by which masked forms meet
LEAST_WORD = 4  # bytes of a word that isn't left out as a function word
# Words of dates, masked like numbers.
DATE_WORDS = (
    "enero febrero marzo abril mayo junio julio agosto septiembre setiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday"
).split()
_DATES = np.sort(np.array([hash_text(w) for w in DATE_WORDS], dtype=np.uint64))
_ODD = re.compile("[^\x00-\xff\u2010-\u2027\u2030-\u203a\u2190-\u21ff\u2500-\u27bf]")
# Blanks and digits that the reader of bytes would take for letters.
_WIDE_BLANK = re.compile(r"[^\S\x00-\x7f]")
_WIDE_DIGIT = re.compile(r"[^\D\x00-\x7f]")
BANDS = 4
_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9AE16A3B2F90404F)


def exact_key(line: str) -> str | None:
    """What two lines have in common that count as the same: visible text without case, digits and amount of white space."""
    text = re.sub(r"\d+", "", visible(line)).lower()
    text = " ".join(text.split())
    return text if sum(map(str.isalpha, text)) >= LEAST_LETTERS else None


def _decoded(text: str) -> str:
    """References decoded (but not to tags or line ends); letters outside Latin-1 in lower case, blanks as spaces and no digits there."""
    if "&" in text:
        text = "\n".join(
            html.unescape(x.replace("&lt", "&amp;lt").replace("&gt", "&amp;gt")).replace("\n", " ").replace("\r", " ") if "&" in x else x for x in text.split("\n")
        )
    return _WIDE_DIGIT.sub("", _WIDE_BLANK.sub(" ", text)).lower() if _ODD.search(text) else text


def _dates(x) -> np.ndarray:  # noqa: ANN001
    at = np.minimum(np.searchsorted(_DATES, x.word_hash), len(_DATES) - 1)
    return x.word_digit | (_DATES[at] == x.word_hash)


def _masked(x) -> np.ndarray:  # noqa: ANN001
    """Which words stay: not numbers, words of dates, names (capitals within a line that has lower-case words) or short ones."""
    lower = np.bincount(x.word_line, ~x.word_cap & ~x.word_first, len(x.doc)) > 0
    name = x.word_cap & ~x.word_first & lower[x.word_line]
    return ~_dates(x) & ~name & (x.word_size >= LEAST_WORD)


def line_bands(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, bands) of every line with words; a band value of 0 stands for none."""
    docs, nos, values = [], [], []
    for part in chunks([len(t) for t in texts]):
        x = read([_decoded(t) for t in texts[part]], tags=False)
        some, bands = _bands(x, _masked(x))
        docs.append(x.doc[some] + part.start)
        nos.append(x.no[some])
        values.append(bands)
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((0, BANDS), np.uint64)
    return np.concatenate(docs), np.concatenate(nos), np.concatenate(values)


def _bands(x, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The lines with enough letters and their bands."""
    m = minhash(x, keep, ROWS * (BANDS - 1))
    bands = np.stack([*[m[:, ROWS * k] * MIX ^ m[:, ROWS * k + 1] ^ _SALT[k] for k in range(BANDS - 1)], x.letters ^ _SALT[-1]], axis=1)
    bands[m[:, 0] == np.iinfo(np.uint64).max, :-1] = 0
    some = np.flatnonzero(x.letter_count >= LEAST_LETTERS)
    return some, bands[some]


def masked_forms(texts: list[str]) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """By (text, line number) the hash of the masked form, its distinct words and finer bands; lines that keep too little are left out."""
    out = {}
    for part in chunks([len(t) for t in texts]):
        x = read([_decoded(t) for t in texts[part]], tags=False)
        keep, n = _masked(x), len(x.doc)
        size, words = np.bincount(x.word_line[keep], x.word_size[keep], n), np.bincount(x.word_line[keep], minlength=n)
        named = np.bincount(x.word_line[~_dates(x) & (x.word_size >= LEAST_WORD)], minlength=n)
        at, stop = np.cumsum(words) - words, np.cumsum(words)
        kept = x.word_hash[keep]
        m = minhash(x, keep, FINE_ROWS * FINE_BANDS).reshape(n, FINE_BANDS, FINE_ROWS)
        fine = (m * (np.arange(FINE_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))).sum(axis=2, dtype=np.uint64) * MIX ^ np.arange(FINE_BANDS, dtype=np.uint64)
        for k in np.flatnonzero((size >= LEAST_LETTERS) & (3 * words >= named)).tolist():
            own = np.unique(kept[at[k] : stop[k]])
            v = own * MIX
            out[int(x.doc[k]) + part.start, int(x.no[k])] = (int((v ^ (v >> np.uint64(31))).sum()), own, fine[k])
    return out


def _site_codes(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes, names and hashes of a batch's sites."""
    d = column.dictionary_encode()
    names = d.dictionary.to_pylist()
    return d.indices.to_numpy().astype(np.int64), names, np.array([hash_text(f"site {s}") for s in names], dtype=np.uint64)


_CANDIDATES = pa.schema([("site", pa.string()), ("value", pa.int64()), ("rows", pa.int64()), ("size", pa.int64())])
_LINES = pa.schema(
    [
        ("id", pa.int64()), ("line_no", pa.int32()), ("site", pa.string()), ("key", pa.binary()), ("first", pa.int32()), ("uid", pa.int64()),
        ("form", pa.int64()), ("words", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64())),
    ]
)
_LINES_SQL = "id long, line_no int, site string, key binary, first int, uid long, form long, words array<long>, bands array<long>"


def _source(df: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), site.alias("site"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())


def _candidates(source: DataFrame, share: float) -> DataFrame:
    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, names, hashes = _site_codes(batch.column(0))
        rows = np.bincount(codes, minlength=len(names))
        doc, _, bands = line_bands(batch.column(1).to_pylist())
        sites, values, counts, sizes = list(names), [None] * len(names), rows.tolist(), [0] * len(names)
        for k in range(BANDS):
            value = bands[:, k]
            some = value != 0
            # one entry per document and value, then documents per value of each site
            v, d = value[some] ^ hashes[codes[doc[some]]], doc[some]
            by = np.lexsort((d, v))
            v, d = v[by], d[by]
            once = np.ones(len(v), dtype=bool)
            once[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
            v, d = v[once], d[once]
            if not len(v):
                continue
            begin = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            n = np.diff(np.append(begin, len(v)))
            code = codes[d[begin]]
            hit = n >= np.maximum(1, share / 2 * rows[code] - 1e-9)
            sites += [names[c] for c in code[hit]]
            values += _mixed(v[begin[hit]]).view(np.int64).tolist()
            counts += n[hit].tolist()
            sizes += rows[code[hit]].tolist()
        return batch_of(_CANDIDATES, sites, values, counts, sizes)

    return arrow_map(source.select("site", "text"), report, "site string, value long, rows long, size long")


def _line_report(candidates: np.ndarray, forms: bool):  # noqa: ANN202
    """A batch function giving the lines that the filter of candidates lets pass, with exact keys (null for none).

    With ``forms`` each line has its masked form as well, and its words and bands where the form comes first in the batch.
    """
    serial = [0]

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, names, hashes = _site_codes(batch.column(1))
        texts = batch.column(2).to_pylist()
        doc, no, bands = line_bands(texts)
        full = bands ^ hashes[codes[doc]][:, None]
        hit = np.flatnonzero((may_hold(candidates, _mixed(full)) & (bands != 0)).any(axis=1))
        shapes = masked_forms(texts) if forms and len(hit) else {}
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40  # type: ignore[union-attr]
        ids = batch.column(0).to_pylist()
        rows: list[list] = [[] for _ in _LINES]
        last, parts, seen = -1, [], set()
        cache: dict[str, bytes | None] = {}
        shown: set[tuple[int, int]] = set()
        for k, d, n in zip(hit.tolist(), doc[hit].tolist(), no[hit].tolist(), strict=True):
            if d != last:
                last, parts, seen = d, texts[d].split("\n"), set()
            line = parts[n]
            if line not in cache:
                cache[line] = hashlib.blake2b(text.encode(), digest_size=12).digest() if (text := exact_key(line)) else None
            if (key := cache[line]) is None:
                continue
            form, words, own = None, None, None
            if (shape := shapes.get((d, n))) is not None:
                form = shape[0] - (1 << 64) if shape[0] >> 63 else shape[0]
                if (codes[d], form) not in shown:
                    shown.add((codes[d], form))
                    words, own = shape[1].view(np.int64).tolist(), shape[2].view(np.int64).tolist()
            for c, v in zip(rows, (ids[d], n, names[codes[d]], key, int(key not in seen), part | (serial[0] + d), form, words, own), strict=True):
                c.append(v)
            seen.add(key)
        serial[0] += len(texts)
        return batch_of(_LINES, *rows)

    return report


def _mixed(values: np.ndarray) -> np.ndarray:
    """Band values as the filter takes them."""
    v = values * MIX
    return v ^ (v >> np.uint64(32))


def _reported(df: DataFrame, id_col: str, site_col: str, text_col: str, share: float, least: int, forms: bool) -> tuple[DataFrame, DataFrame]:
    """(lines of candidate clusters, documents per site)."""
    source = _source(df, id_col, site_col, text_col)
    found = materialize(_candidates(source, share).groupBy("site", "value").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size")))
    totals = found.where("value IS NULL").select("site", F.col("rows").alias("total"))
    # the most documents a cluster can have: those reported, and less than half the share of all others
    most = F.col("rows") + share / 2 * (F.col("total") - F.col("size")) + 1e-9
    able = found.where("value IS NOT NULL").join(totals, "site").where(most >= _bound(share, least)).select("value")
    table = df.sparkSession.sparkContext.broadcast(bit_filter(able, "value"))
    return materialize(arrow_map(source, lambda batch: _line_report(table.value, forms)(batch), _LINES_SQL)), totals


def _excessive(lines: DataFrame, totals: DataFrame, share: float, least: int) -> DataFrame:
    """(site, key) of the lines in enough documents."""
    counts = lines.groupBy("site", "key").agg(F.sum("first").alias("n"))
    return counts.join(totals, "site").where(F.col("n") >= _bound(share, least)).select("site", "key")


def _bound(share: float, least: int) -> Column:
    return F.greatest(F.lit(float(least)), F.col("total") * share - 1e-9)


def repeated_lines(df: DataFrame, id_col: str, site_col: str, text_col: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """(id, line_no) of all occurrences of excessive lines.

    A line is excessive if it stands in at least ``least`` documents and the share ``share`` of its site's documents.
    Clusters of near-duplicates yield the candidates; which of their lines are the same is then settled by exact keys.
    """
    lines, totals = _reported(df, id_col, site_col, text_col, share, least, False)
    return lines.join(_excessive(lines, totals, share, least), ["site", "key"], "left_semi").select("id", "line_no")


def near_clusters(lines: DataFrame, totals: DataFrame, share: float, least: int, similar: float = SIMILAR) -> DataFrame:
    """(site, form) of the masked forms in near-duplicate clusters that stand in enough documents.

    The forms of a site that share a band meet at the most frequent of them; those at least ``similar`` to it (Jaccard,
    over distinct words) are its cluster.  The others are told apart by one more MinHash row and clustered again, as long
    as they could reach the bound; forms that have little in common part quickly, so the rounds are few.
    """
    shaped = lines.where("form IS NOT NULL")
    sizes = shaped.select("site", "form", "uid").distinct().groupBy("site", "form").agg(F.count(F.lit(1)).alias("n"))
    shapes = shaped.where("words IS NOT NULL").groupBy("site", "form").agg(F.first("words").alias("words"), F.first("bands").alias("bands"))
    band = sizes.join(shapes, ["site", "form"]).select("site", "form", "n", "words", F.explode(F.array_distinct("bands")).alias("band"))
    todo, found, step = materialize(band), None, 0
    while True:
        groups = todo.groupBy("site", "band").agg(F.sum("n").alias("most"), F.max_by(F.struct("form", "words"), F.struct("n", "form")).alias("lead"))
        able = groups.join(totals, "site").where(F.col("most") >= _bound(share, least)).select("site", "band", "lead")
        near = F.size(F.array_intersect("words", "lead.words")) >= similar * F.size(F.array_union("words", "lead.words")) - 1e-9
        met = materialize(todo.join(able, ["site", "band"]).withColumn("near", near))
        if met.isEmpty():
            break
        part = met.where("near").select("site", "form", "band", F.col("lead.form").alias("lead"))
        found = part if found is None else found.unionByName(part)
        step += 1
        row = F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(step))))  # noqa: B023
        todo = met.where("NOT near").select("site", "form", "n", "words", F.xxhash64("band", row).alias("band"))
    if found is None:
        return sizes.select("site", "form").limit(0)
    documents = shaped.select("site", "form", "uid").distinct().join(found, ["site", "form"]).select("site", "band", "lead", "uid").distinct()
    many = documents.groupBy("site", "band", "lead").agg(F.count(F.lit(1)).alias("n")).join(totals, "site").where(F.col("n") >= _bound(share, least))
    return found.join(many.select("site", "band", "lead"), ["site", "band", "lead"], "left_semi").select("site", "form").distinct()


def without_repeated_lines(df: DataFrame, id_col: str, site_col: str, text_col: str, share: float = 0.1, least: int = 5) -> DataFrame:
    """(id, text): every document without its site's excessive lines and near-duplicate clusters; null texts stay null.

    The line numbers travel to the documents by id, one small array each, so no group of documents is gathered.
    """
    lines, totals = _reported(df, id_col, site_col, text_col, share, least, True)
    same = lines.join(_excessive(lines, totals, share, least), ["site", "key"], "left_semi").select("id", "line_no")
    near = lines.join(near_clusters(lines, totals, share, least), ["site", "form"], "left_semi").select("id", "line_no")
    numbers = same.unionByName(near).groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, k: ~F.array_contains("drop", k.cast("int"))), "\n")
    return texts.join(numbers, "id", "left").select("id", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"))
