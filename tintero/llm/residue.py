"""Template residue, filler, error pages and script notices (problem 4).

All lines of a host's records are counted in normalised form (letter case, digits and the amount of white space
ignored).  Lines that stand in a large share of the host's records are its boilerplate and are subtracted from each
record in which something else remains; a record whose residual still holds evidence comes out as unusable.  Evidence
is a line, or a template's span over several lines, and is recognised by its form: delimiters around a name, a bare
value, filler words, a status code with its name, a fault report, or a request that scripts or cookies be switched on.

Lines are counted without shuffling the corpus: batches report only lines that reach half the share in them, from which
follows the most records that a line can stand in.  Where all lines of a piece of evidence may recur by that, the record's lines are counted exactly in a second pass, which a filter of fixed size keeps small; without
such records it isn't needed.

Defined cases: null and empty fields are never cases; rows of a null host count as one host of their own; a table
without rows gives none; every row counts, also repeated ones; a record that consists of recurrent lines only (a host
that failed often) is judged by all of its lines.
"""

from __future__ import annotations

import re
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, bit_filter, lines_with, materialize, may_hold, visible
from .lines import MIX, hash_text, keys

_NAME = r"(?:[a-z][a-z0-9_]*(?:[._-][a-z0-9_]+)*|[A-Z][A-Z0-9_]*(?:[._-][A-Z0-9_]+)*)"
# Delimiters that only templates use hold anything; those that texts use as well hold a name.
_FREE = r"\{\{[^{}]*\}\}|\{%[^{}%]*%\}|<%[^<>]*%>|<\?(?:php|=)(?:[^?]|\?(?!>))*|[$#]\{[^{}]*\}"
_NAMED = (
    rf"%%\s*[\w.]+\s*%%|\[\[\s*{_NAME}\s*\]\]|\{{\$?\s*{_NAME}\s*\}}|(?<![\w%])%{_NAME}%(?!\w)|(?<![\w@.])@{_NAME}@(?![\w.])|(?<!\w)__{_NAME}__(?!\w)"
    rf"|\[\s*{_NAME} (?:aquí|here)\s*\]|\[\s*(?:inserte?|insertar|insert)\b[^\]\n]*\]|\[[A-ZÁÉÍÓÚÑ]+(?:_[A-ZÁÉÍÓÚÑ\d]+)+\]|(?<![\w{{])\{{\d+\}}(?![\w}}])|(?<![\w%])%(?:\d+\$)?[sd](?!\w)|%\(\w+\)[sd]"
)
PLACEHOLDER = re.compile(f"{_FREE}|{_NAMED}")
_SPAN = re.compile(_FREE)
# Latin filler words, whole or cut short.
FILLER_WORD = re.compile(
    r"(?:lorem|ipsum|dolor[ei]?|sit|amet|consec\w*|adipis\w*|elit|sedo?|eiusm\w*|tempor\w*|incidid\w*|ut|labor\w*|et|magna|aliqu\w+|enim|ad|minim|veniam|quis|nostr[u]\w*|exercit\w*|ullamc\w*"
    r"|nisi|ea|commod\w*|consequat\w*|duis|aute|irur\w*|in|reprehend\w*|volupt\w*|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat\w*|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum)"
)
FILLER_SURE = frozenset("lorem ipsum amet adipis consec sedo elit nostru veniam fugiat aliqua adipiscing consectetur eiusmod incididunt nostrud ullamco".split())
FILLER = re.compile(
    r"(?:(?:prueba|test|asdf|qwerty|x{3,}|bla|blah)(?: (?:prueba|test|asdf|qwerty|x{3,}|bla|blah|texto))*(?: de (?:prueba|ejemplo|relleno|muestra))?|x{4,}"
    r"|(?:este es )?(?:un|el|una|la)? ?(?:bloque|texto|párrafo|parrafo|capítulo|línea|contenido|entrada) de (?:muestra|ejemplo|prueba|relleno)(?: para esta? \w+| para el \w+)?"
    r"|escrib[ae] aquí (?:tu|su|el) \w+(?: \w+){0,3}|aquí va el (?:contenido|texto|título)(?: del? \w+){0,2}|(?:contenido|texto|traducción|título|capítulo) (?:pendiente|por (?:añadir|traducir|definir))|borrador automático"
    r"|añadir (?:el )?(?:capítulo|texto|contenido) (?:más tarde|después|luego)|(?:insert|your|sample|placeholder|dummy|filler) (?:text|content|title)(?: here| goes here)?|content goes here|coming soon|tbd|título de (?:ejemplo|prueba)|hello world|hola mundo|sin contenido"
    r"|insert(?:e|ar|a)? (?:(?:el|su|tu|un) )?(?:texto|título|contenido|nombre|capítulo|imagen)(?: \w+){0,3} aqu[ií]"
    r"|(?:capítulo|entrada|documento|página|texto) sin (?:título|nombre|contenido)|(?:contenido|capítulo|texto) (?:próximamente|en preparación)|untitled(?: (?:chapter|document|page))?)",
    re.I,
)
# A note of work to be done, in capitals before the colon; and tokens of neighbouring keys.
TO_DO = re.compile(r"(?:TODO|FIXME|TBD)\s*:(?=.*[a-záéíóúñ])")
KEY_ROWS = ("qwertyuiop", "asdfghjklñ", "zxcvbnm")
_VALUE = r"(?:undefined|null|nil|none|nan|\(null\)|\[object object\]|<null>|n/a|#n/a|#ref!|#value!|true|false|\[\]|\{\}|\[object \w+\]|object reference not set(?: to an instance of an object)?)"
PROGRAM_VALUE = re.compile(rf"{_VALUE}(?: {_VALUE})*", re.I)
# What may stand around residue in a title or line, and what a story may have beside a number.
HEAD = re.compile(r"(?:cap(?:[ií]tulo|\.)?\s*)?\d+\s*[:.|\u00b7\u2013—-]+\s*", re.I)
TAIL = re.compile(r"\s+\d+$")
STORY = frozenset(("prueba", "test", "hello world", "hola mundo"))
# Names of failures: those of the HTTP standard and what Spanish servers call them.
_SINGLE = "|".join(x.phrase.lower() for x in HTTPStatus if x.value >= 400 and x.phrase.isalpha())
_PHRASES = "|".join(re.escape(x.phrase.lower()) for x in HTTPStatus if x.value >= 400 and x.phrase.isascii() and " " in x.phrase)
ERROR_NAME = (
    rf"(?:página no encontrada|no encontrad[oa]|(?:page |file )?not found|error interno(?: del servidor)?|acceso (?:denegado|prohibido|restringido)|access denied|forbidden|prohibido|no autorizado|unauthorized|servicio (?:temporalmente )?no disponible|service (?:temporarily )?unavailable"
    r"|puerta de enlace incorrecta|solicitud incorrecta|gateway time-?out|tiempo de espera agotado|request time-?out|demasiadas (?:peticiones|solicitudes)|web server is down|connection timed out|error"
    rf"|(?:la )?(?:página|web|sitio(?: web)?) (?:está )?en (?:construcción|mantenimiento)|(?:site |page )?under (?:construction|maintenance)|attention required|{_PHRASES})"
)
_CODE = r"[1-5]\d\d"
ERROR_LINE = re.compile(rf"(?:(?:http|error|status|código)[ :/]*)?(?:1\.1 )?(?:{_CODE})?[ :.,|\u2013—-]*{ERROR_NAME}[ !:.,|\u2013—-]*(?:\(?(?:error )?{_CODE}\)?|(?<=\| )\w+)?[.!\u2026]*|(?:http |error ){_CODE}[.!]*|{_CODE}[ :.,|\u2013—-]+(?:{_SINGLE})[.!]*", re.I)
# A thing that a server has, as the subject of a sentence, and what is wrong with it.
_THING = r"(?:la |el |esta |este |the |this |your )?(?:página|recurso|contenido|sitio(?: web)?|web|servicio|archivo|enlace|servidor|capítulo|page|resource|content|site|website|service|file|url|server)(?: (?:solicitad[oa]|requested|que (?:buscas?|solicitas?|intentas? (?:ver|abrir))|(?:that )?you(?: requested| are looking for|'re looking for)))?"
_FAULT = (
    r"(?:no (?:existe|está disponible|responde|funciona|se (?:ha )?(?:encontrado|encontró|pudo (?:encontrar|cargar|mostrar))|se puede (?:encontrar|cargar|mostrar)|fue encontrad[oa])|(?:está )?(?:temporalmente )?fuera de (?:servicio|línea)|(?:is|was)(?:n't| not) (?:available|found|working|responding)"
    r"|is (?:temporarily |currently )?(?:unavailable|down)|is no longer available|could(?:n't| not) be (?:found|loaded|displayed))"
)
_SORRY = r"(?:(?:lo sentimos|oops|whoops|ups|vaya|sorry|perdón)[,.!: ]+(?:looks like |parece que )?)?"
ERROR_TEXT = re.compile(
    rf"^{_SORRY}{_THING} {_FAULT}(?: (?:en este (?:momento|servidor|sitio)|temporalmente|at the moment|right now|on this server|o (?:fue|ha sido) \w+))?[.!\u2026]*(?: [A-ZÁÉÍÓÚ¿].*)?$|^{_SORRY}(?:por favor, |please )?(?:int[eé]nt[ae]lo|vuelv[ae] a intentarlo|try again)(?: de nuevo| otra vez)? (?:más tarde|later)[.!]*$|^error al (?:cargar|conectar|procesar|abrir|leer|mostrar|obtener|acceder|guardar)\b"
    r"|^http(?:/[\d.]+)? (?:error |status (?:code )?)?[1-5]\d\d\b|^(?:tu |su |la |your )?(?:sesión (?:ha )?(?:caducad[oa]|expirad[oa])|session (?:has )?expired)|^(?:your connection is not (?:private|secure)|(?:tu|su|la) conexión no es (?:privada|segura))"
    r"|^(?:internal|unexpected|unknown) error\b|^(?:whoops|oops)[,.! ]+(?:looks like )?something went wrong"
    r"|fatal error: |parse error: |syntax error, |(?:notice|warning|deprecated): .*(?:on line|, line|variable|offset|index|argument)|uncaught \w*(?:error|exception)|on line \d+|stack trace|traceback \(most recent|\bat [\w.$]+\([\w.]+:\d+\)"
    r"|^(?:nginx|apache|openresty|cloudflare|litespeed|iis)/?[\d.]*$|no se pudo cargar el (?:fragmento|capítulo|contenido|recurso)|no se pudo establecer (?:la )?conexión con la base de datos|error establishing a database connection"
    r"|^(?:id de la solicitud|request id|referencia del incidente|incident id|ray id|id del (?:error|incidente))\s*:|^la página que buscas no existe|the requested url .*not found|^comprueba la dirección o vuelve|^no tienes permiso para (?:ver|acceder)"
    r"|you don't have permission|estamos realizando tareas de mantenimiento|sitio en mantenimiento|^vuelve a intentarlo (?:dentro de|más tarde|en) ?(?:\d+ (?:minutos|segundos))?|^este proceso es automático|se ha superado el límite de (?:visitas|peticiones)|^el servidor no pudo completar"
    r"|the server encountered|nullpointerexception|sqlstate\[|you have an error in your sql|segmentation fault|object reference not set|undefined (?:variable|index|offset)|cannot read propert|memory size of \d+ bytes"
    r"|^(?:(?:lo sentimos|oops|ups|vaya|sorry)[,.!: ]+)?(?:se (?:ha producido|produjo)|ha (?:ocurrido|habido|surgido)|ocurrió|hubo) un (?:error|fallo)(?: (?:inesperado|interno|desconocido|técnico|grave|al (?:cargar|procesar|mostrar)\b.*|en el servidor))?[ .!\u2026]*$"
    r"|^(?:(?:oops|sorry)[,.!: ]+)?(?:something went wrong|an? (?:(?:unexpected|unknown|internal) )?error (?:has )?occurred)|^algo (?:salió|ha salido|fue) mal[ .!\u2026]*$|^error (?:inesperado|desconocido|interno|fatal|crítico)(?: del sistema)?[ .!:\u2026]*$"
    r"|^(?:esta|this) (?:página|web|page|site)\b.*(?:no está disponible|is (?:not available|unavailable|no longer available))",
    re.I,
)
# A request that something be switched on: its verb and its object may stand in either order.
_SWITCH = r"(?:(?:re|des)?activ\w+|(?:des)?habilit\w+|permit\w+|apagad\w+|enabl\w+|disabl\w+|turn(?:ed)? (?:on|off)|allow\w*|requier\w+|require[sd]?|necesit\w+|need(?:s|ed)?|bloque\w+|block\w*|admit\w+|soport\w+|supports?)"
_SCRIPTS = r"(?:java ?script|js|scripts|cookies|captcha|ad ?-?block(?:er)?s?|bloqueador(?:es)? de anuncios)"
SCRIPT = re.compile(
    rf"\b{_SWITCH}\b.*\b{_SCRIPTS}\b|\b{_SCRIPTS}\b.*\b{_SWITCH}\b|\b(?:navegador|browser) con (?:java ?script|scripts)\b|\b(?:sin|without) java ?script\b"
    r"|^(?:loading|cargando)(?: (?:capítulo|página|contenido|chapter|page|content))?[ .\u2026]*$|^just a moment[ .\u2026]*$|^un momento(?:, por favor)?[.\u2026]+$|^(?:comprobando|verificando|checking) (?:si|if|whether) |^(?:comprobando|verificando) que (?:eres|no eres|es usted)|^(?:comprobando|verificando|checking) (?:tu|su|your|el) (?:navegador|browser|conexión)|^completa (?:la verificación|el captcha)|^(?:verifi(?:ca|que)|demuestr[ae]|confirm[ae]) que (?:eres|es|no (?:eres|es) un)\b"
    r"|verify (?:that )?you are (?:a )?human|^(?:please wait|espere[, ]+por favor|espere un momento)[ .\u2026]*(?:redirig\w*|redirect\w*)?[ .\u2026]*$|ddos protection by|checking if the site connection is secure",
    re.I,
)
# Cookie notices ask for nothing: they tell what is used and offer to accept it.
_CONSENT = re.compile(r"\b(?:acept\w+|rechaz\w+|configurar|entendido|accept|reject|consulta la política|más información)\b", re.I)
# The name of a program's error, as it is written in code.
RAISED = re.compile(r"(?<!\w)(?:[A-Z][a-z]+)+(?:Error|Exception)\b\s*:")
# What a line of narration has and a notice of these kinds hasn't.
SPOKEN = re.compile(r"^[—\u2013«\u201c\"¿¡]|»|\u201d|—\w|\b(?:dijo|pensó|susurró|respondió|preguntó|murmuró|leyó|suspiró|tecleó|parpadeó|decía|gritó)\b", re.I)

# RE2, on fields and on lines: without a match there is no evidence.
SUSPECT = (
    r"(?i)%\(\w|(?:^|>|\n)\s*(?:(?:lo sentimos|oops|whoops|ups|vaya|sorry|perdón)[,.!: ]|(?:la |el |esta |este |the |this |your )?(?:página|recurso|contenido|sitio|web|servicio|archivo|enlace|servidor|capítulo|page|resource|content|site|website|service|file|url|server) (?:no|is|was|could|está|fuera|temp|que|sol|req|that|you|web)|(?:por favor, |please )?(?:int[eé]nt|vuelv[ae] a|try again)|(?:tu |su |la |your )?(?:sesión|session|conex|connection))|(?:capítulo|entrada|documento|página|texto) sin (?:título|nombre|contenido)|próximamente|en preparación|untitled|locked|\{\d+\}|%(?:\d+\$)?[sd]\b|\[[a-záéíóúñ]+_|\b(?:todo|fixme)\s*:|construcci|construction|went wrong|algo (?:sali|ha sal|fue)|fallo|attention required|restringido|available|disponible|required|unprocessable|conflict|gone\b|teapot|precondition|payload|payment|uri too|legal|expectation|unsupported|not (?:acceptable|allowed|implemented|satisfiable|extended)|already reported|insufficient|loop detected|variant also|misdirected|upgrade|demuestr|confirm|verifi|\{\{|\}\}|\{%|<%|<\?|%%|[$#]\{|\[\[|%[a-z][\w.-]*%|@[a-z][\w.-]*@|__[a-z][\w.-]*__|\{\$?\s*[a-z][\w.-]*\s*\}|\[\s*[a-z][\w.-]* (?:aquí|here)|\[\s*insert"
    r"|lorem|ipsum|amet\b|adipis|consec\b|fugiat|nostru|veniam|\b(?:elit|tempor|aliqua|sedo|nisi|labor|dolor|magna)\b|asdf|qwerty|prueba|\btest|xxx|\bbla\b|muestra|ejemplo|relleno|escrib[ae] aquí|aquí va|pendiente|por añadir|por traducir|borrador|añadir|insert|sample|placeholder|dummy|filler|goes here|coming soon|\btbd\b|\btodo\b[.\x{2026}]*\s*(?:<|$|\n)|hello world|hola mundo|sin contenido"
    r"|undefined|\bnull|\bnil\b|\bnone\b|\bnan\b|\[object|n/a|#ref|#value|(?:^|>|\n|\d\s*[:.|\x{b7}\x{2013}\x{2014}-]+)\s*(?:true|false|\[\]|\{\})|object reference"
    r"|error|no encontrad|not found|acceso|access denied|forbidden|prohibido\b|autorizado|unauthorized|no disponible|unavailable|bad (?:gateway|request)|gateway|puerta de enlace|solicitud|time-?out|espera agotado|demasiadas|too many|server is down|timed out|https? ?\d"
    r"|notice:|warning:|deprecated:|uncaught|on line|stack trace|traceback|nginx|apache|openresty|cloudflare|litespeed|no se pudo|request id|referencia del incidente|incident id|ray id|la página que buscas|requested url|comprueba la dirección|no tienes permiso|permission|mantenimiento|vuelve a intentarlo|proceso es autom|límite de|el servidor no|server encountered|exception|sqlstate|in your sql|segmentation|undefined|cannot read|memory size"
    r"|java ?script|scripts?\b|cookies|\bjs\b|captcha|ad ?-?block|bloqueador|loading|cargando|just a moment|un momento|comprobando|verificando|checking|completa |verifica que|demuestra que|confirma que|verify|please wait|espere|ddos|secure"
)


def _filler_words(text: str) -> bool:
    words = re.findall(r"[a-zñáéíóúü]+", text.lower())
    hits = [w for w in words if FILLER_WORD.fullmatch(w)]
    sure = {w for w in hits if w in FILLER_SURE}
    if len(words) < 3:
        return len(words) == 2 == len(hits) and bool(sure)
    return len(hits) >= 0.7 * len(words) and len(sure) >= 2 or "lorem ipsum" in text.lower()


def _typed_blindly(text: str) -> bool:
    """Whether every word is a run of neighbouring keys, such as nobody writes."""
    words = re.findall(r"[a-zñ]+", text.lower())
    return bool(words) and all(len(w) > 3 and any(w in row or w[::-1] in row for row in KEY_ROWS) for w in words) and text.replace(" ", "").isalpha()


def _numbered(bare: str, title: bool) -> set[str]:
    """What is left of a line without a number at its end, and of a title without its chapter number."""
    rest = HEAD.sub("", bare, count=1) if title and HEAD.match(bare) else bare
    return {x for x in (rest, TAIL.sub("", bare), TAIL.sub("", rest)) if x != bare and x.lower() not in STORY}


def evidence(line: str, title: bool = False) -> str | None:
    """The kind of evidence in one raw line: placeholder, filler, value, error or script; None without."""
    if PLACEHOLDER.search(line):
        return "placeholder"
    text = visible(line)
    if not text:
        return None
    bare = re.sub(r"\s*[|\u00b7\u2013—-]\s*(?:cap(?:ítulo|\.)?\s*)?\d*$", "", text) if title else text
    bare = bare.strip(" .\u2026!:")
    if not bare:
        return None
    if _filler_words(text) or FILLER.fullmatch(bare) or _typed_blindly(bare) or TO_DO.match(text):
        return "filler"
    if PROGRAM_VALUE.fullmatch(text.strip()) or title and PROGRAM_VALUE.fullmatch(bare):
        return "value"
    for part in _numbered(bare, title):
        if _filler_words(part) or FILLER.fullmatch(part):
            return "filler"
        if PROGRAM_VALUE.fullmatch(part):
            return "value"
    if ERROR_LINE.fullmatch(text) or ERROR_LINE.fullmatch(bare):
        return "error"
    if SPOKEN.search(text):
        return None
    if ERROR_TEXT.search(text) or RAISED.search(text):
        return "error"
    return "script" if SCRIPT.search(text) and not _CONSENT.search(text) else None


def units(value: str, title: bool = False) -> list[tuple[str, list[int]]]:
    """(kind, line numbers) of the evidence in a field: single lines, and templates that run over several."""
    found = [(kind, [k]) for k, x in enumerate(value.split("\n")) if (kind := evidence(x, title))]
    if "\n" in value:
        for m in _SPAN.finditer(value):
            if "\n" in m.group():
                first = value.count("\n", 0, m.start())
                found.append(("placeholder", list(range(first, first + m.group().count("\n") + 1))))
    return found


def column_evidence(column: pa.Array, title: bool = False) -> list[tuple[int, str, list[int]]]:
    """(row, kind, line numbers) over a column; RE2 leaves few rows and lines to look at."""
    texts: dict[int, str] = {}
    out = []
    for row, numbers, lines in lines_with(column, SUSPECT):
        out += [(row, kind, [no]) for no, line in zip(numbers, lines, strict=True) if (kind := evidence(line, title))]
        if any(_OPEN.search(x) for x in lines):
            texts[row] = column[row].as_py()
    for row, text in texts.items():
        out += [(row, kind, numbers) for kind, numbers in units(text, title) if len(numbers) > 1]
    return out


_OPEN = re.compile(r"\{\{|\{%|<%|<\?(?:php|=)|[$#]\{")
_SCHEMA = pa.schema(
    [
        ("host", pa.string()), ("field", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("total", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()),
        ("lines", pa.list_(pa.struct([("unit", pa.int32()), ("kind", pa.string()), ("key", pa.int64())]))),
    ]
)
_SQL = "host string, field string, key long, n long, size long, total long, uid long, id long, lines array<struct<unit:int,kind:string,key:long>>"
_COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _salts(hosts: list[str | None], field: str) -> np.ndarray:
    return np.array([hash_text(f"{field} of {h!r}") for h in hosts], dtype=np.uint64)


def _column_keys(column: pa.Array, hosts: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str | None], np.ndarray]:
    """(row, line number, key, host code) of a column's lines, the hosts by code and their rows with a text; keys tell hosts and fields apart."""
    some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    names = hosts.dictionary_encode(null_encoding="encode")
    codes, host_names = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary.to_pylist()
    doc, no, value = keys(column.take(pa.array(some)).to_pylist())
    row = some[doc]
    mixed = (value ^ _salts(host_names, field)[codes[row]]) * MIX
    return row, no, mixed ^ (mixed >> np.uint64(32)), codes[row], host_names, np.bincount(codes[some], minlength=len(host_names))


def _once(key: np.ndarray, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, rows that have it, host code) of each key."""
    by = np.lexsort((row, key))
    k, r = key[by], row[by]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    k, c = k[new], code[by][new]
    begin = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[begin], np.diff(np.append(begin, len(k))), c[begin]


def _first_pass(fields: list[str], share: float):  # noqa: ANN202
    """A batch function giving each host's rows, its lines that reach half the share in the batch, and the records with evidence."""
    serial = [0]

    def seek(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, ids = batch.column(0), batch.column(1)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0  # type: ignore[union-attr]
        rows: list[tuple] = []
        for k, name in enumerate(fields):
            column = batch.column(2 + k)
            line_row, line_no, key, code, host_names, sizes = _column_keys(column, hosts, name)
            rows += [(host_names[c], name, None, None, None, int(n), None, None, None) for c, n in enumerate(sizes) if n]
            value, n, c = _once(key, line_row, code)
            hit = n >= np.maximum(1, share / 2 * sizes[c] - 1e-9)
            rows += [(host_names[x], name, v, m, int(sizes[x]), None, None, None, None) for x, v, m in zip(c[hit].tolist(), value[hit].view(np.int64).tolist(), n[hit].tolist(), strict=True)]
            records: dict[int, list[tuple[str, list[int]]]] = {}
            for row, kind, numbers in column_evidence(column, name.endswith("title")):
                records.setdefault(row, []).append((kind, numbers))
            order = np.searchsorted(line_row, sorted(records))
            for row, at in zip(sorted(records), order.tolist(), strict=True):
                own = {}
                while at < len(line_row) and line_row[at] == row:
                    own[int(line_no[at])] = int(key[at].view(np.int64))
                    at += 1
                taken, lines = set(), []
                for u, (kind, numbers) in enumerate(records[row]):
                    taken.update(numbers)
                    # a line that shows nothing, or digits alone, is never boilerplate
                    lines += [{"unit": u, "kind": kind, "key": own.get(x)} for x in numbers]
                lines += [{"unit": -1, "kind": None, "key": v} for x, v in own.items() if x not in taken]
                rows.append((hosts[row].as_py(), name, None, None, None, None, (part << 40) | serial[0], ids[row].as_py(), lines))
                serial[0] += 1
        return batch_of(_SCHEMA, *(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA)))

    return seek


def _count_pass(fields: list[str], table: np.ndarray):  # noqa: ANN202
    """A batch function giving (key, records) of the lines that the filter lets pass."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = [], []
        for k, name in enumerate(fields):
            row, _, key, code, _, _ = _column_keys(batch.column(2 + k), batch.column(0), name)
            some = may_hold(table, key)
            value, n, _ = _once(key[some], row[some], code[some])
            found.append(value.view(np.int64))
            counts.append(n)
        return batch_of(_COUNTS, np.concatenate(found), np.concatenate(counts))

    return count


def unusable(df: DataFrame, id_col: str, host_col: str, fields: list[str], share: float = 0.1, least: int = 20) -> DataFrame:
    """(id, field, kind) of the fields that hold residue other than their host's boilerplate.

    A line is boilerplate if it stands in at least ``least`` records and the share ``share`` of its host's records with
    that field.  Names of other columns of ``df`` play no part.
    """
    source = df.select(F.col(host_col).cast("string").alias("host"), F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)])
    found = materialize(arrow_map(source, _first_pass(fields, share), _SQL))
    totals = found.where("total IS NOT NULL").groupBy("host", "field").agg(F.sum("total").alias("total"))
    lines = found.where("uid IS NOT NULL").select("uid", "id", "host", "field", F.explode("lines").alias("l")).select("uid", "id", "host", "field", "l.*")
    # the most records that a line can stand in: those reported, and less than half the share of all others
    reported = found.where("key IS NOT NULL").groupBy("key", F.col("host").alias("h"), F.col("field").alias("f")).agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    most = F.col("n") + share / 2 * (F.col("total") - F.col("size")) + 1e-9
    able = reported.join(totals, F.col("h").eqNullSafe(F.col("host")) & (F.col("f") == F.col("field"))).where((most >= share * F.col("total")) & (most >= least))
    # a piece of evidence is in doubt if all of its lines may recur; only the lines of records with such need a count
    some = able.select("key", F.lit(True).alias("seen"))
    marked = lines.join(some, "key", "left")
    doubtful = marked.where("unit >= 0").groupBy("uid", "unit").agg(F.bool_and(F.col("seen").isNotNull()).alias("all")).where("all").select("uid").distinct()
    sought = materialize(marked.where("seen").join(doubtful, "uid", "left_semi").select("key", F.col("host").alias("h"), F.col("field").alias("f")).distinct())
    if sought.isEmpty():
        recurrent = sought.select("key", F.lit(True).alias("recurs"))
    else:
        table = df.sparkSession.sparkContext.broadcast(bit_filter(sought, "key"))
        counts = arrow_map(source, lambda batch: _count_pass(fields, table.value)(batch), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        exact = counts.join(sought, "key").where(F.col("n") >= least).join(totals, F.col("h").eqNullSafe(F.col("host")) & (F.col("f") == F.col("field")))
        recurrent = exact.where(F.col("n") >= share * F.col("total") - 1e-9).select("key", F.lit(True).alias("recurs"))
    fresh = F.col("recurs").isNull()
    judged = lines.join(recurrent, "key", "left").groupBy("uid").agg(
        F.first("id").alias("id"), F.first("field").alias("field"), F.min(F.when(fresh, F.col("kind"))).alias("live"), F.min("kind").alias("any"), F.count_if(fresh & (F.col("unit") < 0)).alias("others")
    )
    kept = judged.where("live IS NOT NULL OR others = 0")
    return kept.groupBy("id", "field").agg(F.min(F.coalesce("live", "any")).alias("kind"))
