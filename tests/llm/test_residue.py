from __future__ import annotations

import pyarrow as pa
import pytest

from tintero.llm.residue import column_evidence, evidence, units, unusable

FOUND = {
    "placeholder": ["<p>{{ title }}</p>", "Capítulo {chapter.title}", "<p>Visitas: <%= ENTRY %></p>", "{% body %}", "%autor% | 3", "@contenido@", "__num__ | 4", "[[site.name]]", "[titulo aquí]", "${fecha}", "#{NOMBRE}", "%%num%%", "{{{x.y}}}"],
    "filler": ["<p>Lorem ipsum dolor sit amet</p>", "Elit tempor aliqua dolor", "prueba prueba prueba.", "asdf asdf asdf\u2026", "xxxx xxxx", "Escribe aquí tu texto\u2026", "Contenido pendiente", "Borrador automático.", "Párrafo de ejemplo"],
    "value": ["undefined", "<p>null</p>", "NaN", "None", "[object Object]", "(null)", "Object reference not set"],
    "error": ["<h1>Acceso denegado</h1>", "Error 503: Servicio no disponible", "HTTP 404 Página no encontrada", "Internal Server Error (500)", "404 - Page not found", "Error 429", "Fatal error: Uncaught TypeError in /srv/app/render.php on line 51", "nginx/1.74.0", "ID de la solicitud: 1b3", "ERROR: no se pudo cargar el fragmento a3"],
    "script": ["<noscript>Activa JavaScript para leer la novela.</noscript>", "Please enable JavaScript to view this page.", "Tu navegador bloquea los scripts", "Loading...", "Cargando capítulo", "Just a moment...", "Verifica que eres humano", "Un momento, por favor\u2026"],
}
CLEAN = [
    "Capítulo 5: Error 404, alma no encontrada", "«Error 404: alma no encontrada», leyó Brana en la ventana azul.", "La pantalla parpadeó: acceso denegado. Drosera suspiró y volvió a teclear.", "[Nivel: 215]", "{Habilidad: Paso de Bruma}", "[[Aviso del Sistema]] Játhen ha ascendido al rango 3.",
    "[Has obtenido una nueva habilidad]", "Capítulo 3: {Vacío}", "Capítulo 4: [Sistema] Nivel 4", "En la consola del gremio, Tané tecleó faro?piso=3 y esperó.", "El 50 % de los soldados de Brana, el 20 % del resto", "Este sitio utiliza cookies para medir visitas. Aceptar todo", "Si el capítulo no carga bien, refresca la página",
    "La variable que faltaba en el conjuro de Brana era la X, siempre la X.", "—Un momento, por favor.", "El dolor y la labor magna", "", "<p></p>", "correo@sitio.example",
]


@pytest.mark.parametrize(("kind", "line"), [(k, x) for k, v in FOUND.items() for x in v])
def test_evidence(kind, line):
    assert evidence(line) == kind


@pytest.mark.parametrize("line", CLEAN)
def test_no_evidence(line):
    assert evidence(line) is None


@pytest.mark.parametrize(("kind", "text"), [("value", x) for x in ("Capítulo 3: null", "Capítulo 5: [object Object]", "10 - None", "CAPÍTULO 7: undefined undefined", "undefined undefined", "undefined 4", "Capítulo 8: {}")] + [("filler", x) for x in ("Título de ejemplo 2", "Capítulo 4: Título de prueba", "12 — asdf asdf")])
def test_residue_beside_a_chapter_number(kind, text):
    assert column_evidence(pa.array([text]), True) == [(0, kind, [0])]


@pytest.mark.parametrize("text", ["Capítulo 3: «¿Quién es null?», preguntó Wilra", "Capítulo 5: Error 404, alma no encontrada", "Capítulo 9: La prueba", "Capítulo 9: Prueba", "Capítulo 1: Hola mundo", "Capítulo 6: Acceso denegado a Fenos", "Capítulo 2: {Vacío}", "Capítulo 12", "12 - 13"])
def test_titles_beside_a_chapter_number_that_tell_a_story(text):
    assert evidence(text, True) is None


def test_repeated_values_in_a_chapter():
    assert units("<p>undefined undefined</p>\n<p>Y nada más.</p>") == [("value", [0])]


def test_within_a_chapter():
    assert units("<p>Era de noche.</p>\n<p>Visitas: {{ n }}</p>") == [("placeholder", [1])]


EVERYDAY = {
    "placeholder": ["Hola, {{ " + "usuario.nombre_completo_del_lector | default('x') " * 4 + "}}", "[NOMBRE_DEL_AUTOR]", "Faltan {0} capítulos", "Traducido por %s", "<?php echo $titulo . str_repeat('x', 200) . $mas_texto_que_cabe_en_una_linea_corta_de_codigo . $y_todavia_mas; ?>", "[insertar aquí el nombre del capítulo]"],
    "filler": ["TODO: escribir capítulo", "INSERTE TEXTO AQUI", "qwertyuiop", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."],
    "value": ["undefined", "[object HTMLDivElement]", "N/A"],
    "error": ["Se ha producido un error inesperado.", "Página en construcción", "Attention Required! | Cloudflare", "Something went wrong", "404 Not Found", "HTTP 422 Unprocessable Content", "Esta página no está disponible en este momento.", "Algo salió mal", "An unexpected error occurred", "Acceso restringido"],
    "script": ["Por favor habilite JavaScript para continuar.", "Please enable JS and disable any ad blocker", "JavaScript must be enabled to view this site.", "Las cookies tienen que estar habilitadas para entrar", "Esta página requiere JavaScript."],
}


EVERYDAY["error"] += [
    "Error al cargar la página", "Lo sentimos, la página que busca no existe.", "La página solicitada no se ha encontrado", "HTTP Error 503. The service is unavailable.", "Internal error, please try again later", "Inténtelo de nuevo más tarde.", "El recurso solicitado no está disponible", "410 Gone",
    "SyntaxError: Unexpected token < in JSON at position 0", "Whoops, looks like something went wrong.", "Sesión caducada. Inicie sesión de nuevo.", "Sitio temporalmente fuera de servicio", "This page isn't working", "Your connection is not private", "Fatal error: Allowed memory size of 134217728 bytes exhausted",
]
EVERYDAY["filler"] += ["Contenido próximamente", "Capítulo sin título"]
EVERYDAY["placeholder"] += ["Hola, %(name)s"]
EVERYDAY["script"] += ["Verificando que eres humano. Esto puede tardar unos segundos.", "You need to enable JavaScript to run this app.", "Este sitio requiere cookies para funcionar", "We've detected that JavaScript is disabled in your browser."]


@pytest.mark.parametrize(("kind", "line"), [(k, x) for k, v in EVERYDAY.items() for x in v])
def test_everyday_lines(kind, line):
    assert evidence(line) == kind and column_evidence(pa.array([f"<p>uno</p>\n<p>{line}</p>\n<p>dos</p>"])) == [(0, kind, [1])]


@pytest.mark.parametrize(
    "line",
    ["Todo: la casa, el río, la noche.", "El mago necesitaba un nuevo conjuro.", "Hubo un error y todos lo pagaron caro aquella noche.", "Las cookies nos ayudan para medir visitas. Aceptar todo | Rechazar", "El 30 % de la guardia", "{Vacío}", "[SISTEMA]", "Se permitió un suspiro.", "Algo salió mal entre ellos desde el principio.", "La página en blanco lo esperaba.", "El error de Brana fue confiar en él.", "No encontrada entre los vivos, la buscaron entre los muertos.", "Prohibido el paso, decía el cartel.", "Bloqueó la puerta con una silla.", "Se produjo un error que nadie esperaba en el ritual.", "Comprobando su espada, siguió adelante.", "Un momento de silencio.", "Forbidden Kingdom", "Aquel muchacho sin nombre volvió", "El servidor no respondió a la llamada de su señor."],
)
def test_everyday_lines_of_stories(line):
    assert evidence(line) is None


def test_templates_over_several_lines():
    text = "<p>uno</p>\n{% if capitulo\n   and visible %}\n<p>dos</p>\n<?php\necho 1;\n?>\n<p>tres</p>"
    assert units(text) == [("placeholder", [4]), ("placeholder", [1, 2]), ("placeholder", [4, 5, 6])]
    assert column_evidence(pa.array([None, text, ""])) == [(1, k, n) for k, n in units(text)]


def test_a_host_that_failed_often_keeps_no_error_page(spark):
    error = "<h1>404 Not Found</h1>\n<p>Inicio - Ranking</p>"
    rows = [(k, "a", error if k % 4 == 0 else f"<p>Inicio - Ranking</p>\n<p>texto {'abcdefgh'[k % 8] * (k + 1)}</p>\n<p>Loading...</p>", "t") for k in range(200)]
    df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string, title string")
    assert sorted(r.id for r in unusable(df, "chapter_id", "site", ["title", "content_html"]).collect()) == list(range(0, 200, 4))
    assert sorted(r.id for r in unusable(df.repartition(7), "chapter_id", "site", ["content_html"]).collect()) == list(range(0, 200, 4))


def test_boilerplate_of_a_host_is_subtracted(spark):
    rows = [(k, "a", f"<p>texto {'x' * k}a</p>\n<p>Loading...</p>", "t") for k in range(30)] + [(100 + k, "b", "<p>Loading...</p>" if k == 0 else "<p>x</p>", "t") for k in range(30)] + [(200, None, "null", None), (201, "a", None, "undefined")]
    df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string, title string").withColumnRenamed("title", "title")
    found = sorted((r.id, r.field, r.kind) for r in unusable(df, "chapter_id", "site", ["title", "content_html"]).collect())
    assert found == [(100, "content_html", "script"), (200, "content_html", "value"), (201, "title", "value")]


def test_unseen_lines_are_told_apart_by_all_of_their_text(spark):
    rows = [(k, "a", "<%= x %>" + "<b class='" + "c" * 200 + f"{k}'></b>", None) for k in range(30)]
    df = spark.createDataFrame(rows, "chapter_id long, site string, content_html string, title string")
    assert unusable(df, "chapter_id", "site", ["title", "content_html"]).count() == 30


def test_operator_on_odd_rows(spark, odd_rows):
    assert unusable(odd_rows, "chapter_id", "site", ["title", "content_html"]).count() == 0
    assert unusable(odd_rows.limit(0), "chapter_id", "site", ["title"]).count() == 0
