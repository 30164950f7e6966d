"""Training of the block labeller (problem 3): rules label a bounded sample, and the network learns from it.

The rules below are the teacher only; ``blocks.py`` uses nothing but the trained network.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow.parquet as pq

from . import blocks
from .common import visible
from .confusables import normalize
from .mojibake import repair
from .residue import column_evidence

SAMPLE = 12_000  # chapters the network is fitted on, at most

_MENU = (
    "al azar|artes marciales|autores|mi cuenta|últimos capítulos|fantasía|iniciar sesión|novelas completas|terminadas|registrarse|foro|novelas|modo oscuro|ranking|misterio|ayuda|géneros|romance|noticias"
    "|equipo|contacto|inicio|biblioteca|acción|populares|tienda|recientes|glosario|donaciones|buscar|aventura|horror|comedia|drama|ciencia ficción|portada|índice|archivos|etiquetas|publicidad|anuncio"
    "|advertisement|contenido patrocinado|entradas recientes|más leídos hoy|también te puede gustar|novelas relacionadas|lo último en .{1,40}|continúa después de la publicidad|patrocinado|comentarios|categorías|menú"
)
MENU = re.compile(rf"(?:{_MENU})(?:\s*[-|/·•›>]\s*(?:{_MENU}))*")
LINE = re.compile(
    r"^comparte est|^traducción: |^traducción y edición|^traductor del gremio|^publicado el \d|^si lees esto fuera|comentarios? en «|^edición de .*texto sin revisar|no aloja archivos|^gracias por leer en|derechos pertenecen a sus"
    r"|^tiempo de lectura|^por: |prohibida su reproducción|conserva esta copia|^aviso legal|^(?:\(c\)|©|copyright) ?\d|^deja tu comentario|^apoya al gremio|^autor original y trad|^(?:capítulo )?anterior ?[:(]|^enviar por correo"
    r"|^esta entrega de .* patrocina|^← .*→$|^« .+ \| .+ »$|^sigue a .* para recibir|^subido por|^el cuervo recuerda|^autor: |^no nos hacemos resp|^[^.—]{2,40} › .+|lectura libre, siempre|^si el capítulo no carga|^este capítulo fue subido"
    r"|^vota por esta|^copia número|^leer en orden ayuda|^adaptación de .*revisada|^¿has encontrado un error|^únete a nuestro|^la posada abre|cookies|valoramos tu privacidad|socios guardamos|^versión [\d.]+ revisada|^servido por|, traducida por "
    r"|^novela: .* — .*por |(?: ★ \d+| \(\d+\)| — hace \d+ días)$"
)
COMMENT = re.compile(r"^(?:sopa|luna|lobo|kuro|hada|gato|pixel|nube|rayo|tinta)[a-zñáéíóúü]+\d*(?: — | dice: |: )", re.I)
LISTED = re.compile(r"cap[ií]tulo \d+:", re.I)  # another chapter's title, as the chapter's own stands in <h1>
HEADING = re.compile(r"^\s*<h\d", re.I)


def teacher(line: str) -> int:
    """1 for a line of the page around the chapter, 0 for the chapter's own, -1 without visible text."""
    text = visible(line)
    if not text:
        return -1
    low = text.lower()
    return int(bool(MENU.fullmatch(low.strip(" .")) or LINE.search(low) or COMMENT.match(text) or LISTED.match(text) and not HEADING.match(line)))


def labelled(texts: list[str]) -> list[tuple[str, list[int]]]:
    out = []
    for text in texts:
        clean = normalize(repair(text)) or ""
        if clean.count("\n") == text.count("\n"):
            out.append((text, [teacher(x) for x in clean.split("\n")]))
    return out


def measure_unseen(data: str, share: int = 4, sample: int = 6_000, epochs: int = 3, seed: int = 7) -> None:
    """How well the network finds page lines of kinds it has never seen.

    Every ``share``-th kind of line (by a hash of its visible text without digits and names) is left out of the training:
    those lines have no label there, and recall is measured on them alone, in other chapters.
    """
    column = pq.read_table(f"{data}/chapters.parquet", columns=["content_html"]).column(0).combine_chunks()
    residue = {row for row, _, _ in column_evidence(column)}
    texts = [t for k, t in enumerate(column.to_pylist()) if t and k not in residue]
    order = np.random.default_rng(seed).permutation(len(texts))
    fit, held = labelled([texts[k] for k in order[:sample]]), labelled([texts[k] for k in order[sample : sample + 2000]])

    def unseen(line: str) -> bool:
        kind = " ".join(re.findall(r"[a-záéíóúñü]+", re.sub(r"(?<=\S )[A-ZÁÉÍÓÚÑ]\w*", "", visible(line)).lower())[:3])
        return zlib.crc32(kind.encode()) % share == 0

    hide = lambda docs: [(t, [-1 if y == 1 and unseen(x) else y for x, y in zip(t.split("\n"), ys, strict=True)]) for t, ys in docs]
    only = [(t, [y if y != 1 or unseen(x) else -1 for x, y in zip(t.split("\n"), ys, strict=True)]) for t, ys in held]
    net = blocks.Network.fresh(seed)
    net.fit(hide(fit), hide(held), epochs, seed)
    print("unseen kinds:", sum(y == 1 for _, ys in only for y in ys), "lines", net.test(only), flush=True)


def train_blocks(data: str, epochs: int = 5, seed: int = 7) -> None:
    column = pq.read_table(f"{data}/chapters.parquet", columns=["content_html"]).column(0).combine_chunks()
    residue = {row for row, _, _ in column_evidence(column)}
    texts = [t for k, t in enumerate(column.to_pylist()) if t and k not in residue]
    order = np.random.default_rng(seed).permutation(len(texts))
    fit = labelled([texts[k] for k in order[:SAMPLE]])
    held = labelled([texts[k] for k in order[SAMPLE : SAMPLE + 3000]])
    net = blocks.Network.fresh(seed)
    net.fit(fit, held, epochs, seed)
    net.save(blocks.MODEL)
