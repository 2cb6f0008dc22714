"""Cases that cuts of the text problems once left out."""

import random
import re

from loomfacts.llm import handwritten as H
from loomfacts.llm import residue as R


def code(seed: int, functions: int) -> str:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    return "\n".join(f"function {word()}({word()}) {{\n  return {word()}({word()}.{word()}, {word()}) + {word()};\n}}" for _ in range(functions))


def copied(spark, sources: list[str]) -> set[int]:
    files = spark.createDataFrame([(i, f"r{i % 3}", f"src/f{i}.ts", s) for i, s in enumerate(sources)], "id long, repo_id string, relative_path string, source string")
    repos = spark.createDataFrame([(f"r{i}", f"Owner {i}") for i in range(3)], "repo_id string, owner string")
    return {r["id"] for r in H.not_handwritten(files, repos).where("third_party").collect()}


def test_short_renamed_and_touched_copies_are_found(spark):
    short, long = code(1, 1), code(2, 25)
    renamed = [re.sub(r"(?<!\.)\b([a-h]{5})\b", lambda m, k=k: f"{m[1]}{k}", long) for k in "xyz"]
    assert copied(spark, renamed) == {0, 1, 2}
    assert copied(spark, [short] * 3) == {0, 1, 2}
    assert copied(spark, ["package main"] * 3 + [""] * 3) == set()
    touched = ["\n".join(f"{x} // own" if i % 12 else f"let own{k} = {i}; {x}" for i, x in enumerate(long.split("\n"))) for k in range(3)]
    assert copied(spark, touched) == {0, 1, 2}


MESSAGES = {
    "filler": """Lorem ipsum dolor sit amet.|This is placeholder content.|Dummy paragraph|Sample copy only|Filler text here|xx xx xx xx xx xx xx xx|This copy only fills space|Replace before publishing|Your title here|Blindtext|Platzhaltertext
        Hier steht Ihr Text|Texte factice|Votre texte ici|Texto de relleno|Su texto aqui|Faux texte|The quick brown fox jumps|Write two sentences about it|Image goes here|Insert your name here|Describe your work here|To be filled in""",
    "error_page": """We cannot find this document.|You are not authorized to view this file.|You do not have the right to open it.|You do not have the right to view it.|Your IP has been blocked.|Your client sent too many requests|Your network sent more requests|You are not permitted to see it|You are not authorised to open it|The url has moved
        The site is not available|The view doesn't exist|The resource was not found|We couldn't find your page|No route matches this url|Oops! Something went wrong|Sorry, an error|Something went wrong on our end|You don't have permission to see it|Your session has ended|This file was removed|Is no longer public|We are down for maintenance
        An error occurred|The upstream did not respond|Temporarily unavailable|The server did not answer|Sign in to continue|Log in again to continue|TemplateError: x|Seite nicht gefunden|Die angeforderte Adresse|Zugriff verweigert|Interner Serverfehler|Sie haben keine Rechte|Sie haben keine Berechtigung|Page introuvable|Acces interdit
        Erreur interne du serveur|La page demandee|Veuillez vous connecter|Service indisponible|Pagina no encontrada|La direccion solicitada|Acceso denegado|Error interno del servidor|No tiene permiso|Servicio no disponible|Not found|Permission denied|Access is forbidden|Unauthorised|Bad request|Server error|Bad gateway|Gateway timeout
        Request time-out|Too many requests|Gone|Method not allowed|Not acceptable|Conflict|Payment required|Proxy error|Connection reset|Connection timed out|Payload too large|URI too long|Not implemented|I'm a teapot|HTTP 418|{"error": "x is not found"}|<h1>Forbidden</h1>""",
    "script_notice": """Enable scripting|Needs JavaScript to work|Scripts are disabled|JavaScript required:|Does not support JavaScript|Skripte aktivieren|Activer les scripts|Requiere JavaScript|<noscript>|Checking your browser before you enter|Verify you are human|Complete the captcha""",
}


def test_every_message_passes_the_stems():
    for kind, lines in MESSAGES.items():
        for x in (y.strip() for line in lines.split("\n") for y in line.split("|")):
            assert R.message_kind(x) == kind, x


def test_prose_that_begins_like_code_is_read(spark):
    prose = ["For {{customer_name}}, thanks for waiting.", "If you (the reader) see this: the page you requested does not exist.", "Import of ${FILE} failed.", "If {customer} is late, call us.", "Type your name(s) here; the page you requested does not exist.", "页面不存在", "访问被拒绝"]
    code = ["const x = `a ${b} c`;", "if (x) { y(${z}) }", "return f(${NAME})", "import { a } from '{{b}}'", "export const a = ${A}", "func (s *X) f(a ${T}) {", "for (const x of ${LIST}) {", "word", "词"]
    d = spark.createDataFrame(list(enumerate(prose + code)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in R.residue_documents(d).collect()) == list(range(len(prose)))


def test_recurring_error_pages_in_any_wording(spark):
    pages = [f"Feil {n}\n\nSiden /a/{n}.html finnes ikke." for n in (404, 410, 404, 503)] + [f"Rom {n}\n\nMøtet er i etasje {n}." for n in (404, 112, 503, 97)] + ["Feil 404\n\nAlene"]
    d = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")
    assert sorted((r["doc_id"], *r["kinds"]) for r in R.residue_documents(d).collect()) == [(i, "error_page") for i in range(4)]


def test_long_comments_are_read_whole():
    licence = "".join(f" * term {i} of a licence\n" for i in range(600))
    assert H.head_signals(f"/*\n{licence} */\n// Code generated by x. DO NOT EDIT.\nlet a\n", "Own Co") == (True, False)
    assert H.head_signals(f"/*\n{licence} * Copyright 2015 Other Project\n */\nlet a\n", "Own Co") == (False, True)
    assert H.head_signals(f"let a\n/*\n * @generated by x\n{licence} */\n", "Own Co") == (True, False)
    assert H.head_signals("let a = '/*' // @generated\nlet b // @generated by x\n", "Own Co") == (False, False)
