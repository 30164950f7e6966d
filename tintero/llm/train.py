"""Trains the models of this subpackage: ``python -m tintero.llm.train DATA_DIR [words] [blocks] [language] [unseen]``.

DATA_DIR holds the Parquet tables; the results go to ``models/``.  ``unseen`` trains no model to keep: it measures the
block labeller on kinds of page lines that its training has not seen.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter

import pyarrow.parquet as pq

from .mojibake import LETTERS, MODELS


def train_words(data: str, least: int = 12) -> None:
    """Accented words seen at least ``least`` times in lower case, so no names, in texts of Spanish characters only."""
    plain = re.compile(f"[\\x00-\\x7f{LETTERS}¿¡«»—\u2026ªº\u00b7\u00a9\u2605\u25c7\u2192\u2190\u203a\u00bd\u00d7\u00b0\u201c\u201d]*")
    words: Counter[str] = Counter()
    table = pq.read_table(f"{data}/chapters.parquet", columns=["title", "content_html"])
    for column in table.columns:
        for text in column.to_pylist():
            for line in (text or "").split("\n"):
                if plain.fullmatch(line):
                    words.update(w for w in re.findall(r"[^\W\d_]+", line) if w.islower() and not w.isascii() and any(c in LETTERS for c in w) and "ª" not in w and "º" not in w)
    kept = {w: n for w, n in sorted(words.items()) if n >= least}
    (MODELS / "accented_words.json").write_text(json.dumps(kept, ensure_ascii=False, indent=0), encoding="utf-8")
    print(len(kept), "accented words")


if __name__ == "__main__":
    steps = sys.argv[2:] or ["words", "blocks", "language"]
    if "words" in steps:
        train_words(sys.argv[1])
    if "blocks" in steps:
        from .blocks_train import train_blocks

        train_blocks(sys.argv[1])
    if "unseen" in steps:
        from .blocks_train import measure_unseen

        measure_unseen(sys.argv[1])
    if "language" in steps:
        from .language import train_language

        train_language(sys.argv[1])
