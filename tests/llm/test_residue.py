"""Prefilters and the alignment of residue."""

import re

import pytest

from loomfacts.llm import residue as R

MESSAGES = {
    "script_notice": ["Please enable JavaScript to view this page.", "Diese Anwendung läuft nur mit eingeschalteten Skripten.", "This app only works with JavaScript enabled.", "Veuillez activer JavaScript", "JavaScript を有効にしてください", "请启用JavaScript", "Checking your browser before accessing x.org", "Verifying you are human", "Cette page fonctionne uniquement avec JavaScript"],
    "error_page": [
        "404 Not Found", "HTTP 503", "Access denied", "The page you requested does not exist.", "We cannot find this document.", "You are not authorized to view this file.", "You do not have the right to open it.", "Your IP has been blocked.", "Your session has expired.", "An unexpected error has occurred",
        "Seite nicht gefunden", "Zugriff verweigert", "Dienst nicht verfügbar", "Dienst nicht verfugbar", "Page introuvable", "Accès refusé", "Página no encontrada", "Acceso denegado", "ページが見つかりません", "页面不存在", "访问被拒绝", '{"error": "denied", "status": 403}', "<title>502 Bad Gateway</title>", "The upstream server did not answer",
    ],
    "filler": ["Lorem ipsum dolor sit amet.", "This is placeholder content.", "Dummy paragraph", "xx xx xx xx xx xx xx xx", "Hier steht später der eigentliche Text.", "Write two sentences about it", "Your text goes here", "ダミーテキスト", "此处输入", "aquí va el texto final", "Votre texte ici", "Bitte warten Sie hier. Bitte warten Sie hier. Bitte warten Sie hier."],
}
NONE = ["The value is null.", "We measured 12 runs.", "No budget was exceeded today, and the graph has 404 nodes", "Keep it. Keep it. Keep it.", ""]


@pytest.mark.parametrize("kind,line", [(k, x) for k, v in MESSAGES.items() for x in v])
def test_messages(kind, line):
    assert R.message_kind(line) == kind
    assert R._message_kind(line, line.lower(), sum(R._FAMILY.values())) == kind  # as without the automaton


@pytest.mark.parametrize("line", NONE)
def test_no_messages(line):
    assert R.message_kind(line) is None


def test_every_fragment_is_lower_case():
    for family in R._FRAGMENTS.values():
        assert all(x == x.lower() and x for x in family)
        assert not any(re.search(r"[àâéèêíóúñüöä]", x) for x in family)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_slots_are_judged_by_all_records(spark):
    texts = ["Dear {{name}}, your order is ready.", "Dear undefined, your order is ready.", "Dear N/A, your order is ready.", "The value is undefined, which is fine.", "Nothing here to see at all."] + [None, "", "word"]
    d = docs(spark, texts)
    assert {r["doc_id"] for r in R.residue_documents(d).collect()} == {0, 1, 2}
    alone = docs(spark, ["Dear undefined, your order is ready.", "Dear N/A, your order is ready."])
    assert R.residue_documents(alone).count() == 0
    report = {r["kind"]: (r["found"], r["aligned"]) for r in R.alignment_report(d).collect()}
    assert report == {"placeholder": (3, 3)}
