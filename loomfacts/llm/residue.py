"""Texts with residue of a template, filler, an error page or a notice about scripts where content should stand."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, maybe_broadcast
from .parse_check import spread

#: A slot of a template counts as one for values if at least this share of its fillers are unfilled names.
SLOT_SHARE = 0.2
#: A page recurs if this many documents have its template; share of them that must hold a message, or a status of HTTP in
#: the first line (of which there must be several), for the page to be one of an error.
MIN_PAGES, PAGE_MESSAGES, PAGE_STATUSES = 3, 0.5, 0.9

# What shows or discusses a text instead of being it: code, quotes, log lines, usage lines.
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_INLINE = re.compile(r"``[^`\n]+``|`[^`\n]+`")
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|(?<![\w])'[^'\n]{1,200}'(?!\w)|‘[^’\n]{1,200}’(?!\w)|«\s[^»\n]{1,300}\s»|「[^」\n]{1,200}」|『[^』\n]{1,200}』|‹[^›\n]{1,200}›")
_SHOWN_LINE = re.compile(
    r"""(?ix)^\s*(?:
    \d{4}-\d\d-\d\d[T\ ]\d | \[?\d{1,2}:\d\d:\d\d | \[?(?:info|warn|warning|debug|trace|error|fatal)\b\]?[\s:]+(?=.*=) | usage\s*: | \$\s | //|/\*|\#include | --\w
    | .*\s--[a-z][\w-]*[\s=]  | [\w.\[\]]+\s*:?=\s*\S+.*[;){\]]\s*$ | [})\]];?\s*$
    )"""
)
_QUOTE = "\x02"
# A sentence that begins with a word of a language is code only with the structure of code, placeholders being masked.
_CODE_WORD = re.compile(r"(?i)\s*(?:const|let|var|func|function|return|import|export|package|if|for|while|switch|case|type)\b")
_CODE_FORM = re.compile(
    r"""(?ix)[;{}]\s*$ | \s(?:[:+\-*/|&]?=|=>|==+|!==?)(?:\s|$|\x02) | \w\((?!e?s\)) | ^\s*(?:if|for|while|switch)\s*\((?:[^()]*[=<>!&|;] | \s*[\w.$]+\s*\)\s*(?:[{;]|$|return\b)) | ^\s*(?:import|export)\s*[{*(] | ^\s*(?:return|case)\s*[\[{(\x02]"""
)

# Forms in which template languages write a name that is to be replaced.
_NAME = r"[A-Za-z_][\w.\- ]{0,40}?"
_STRONG = re.compile(
    rf"""(?x)
    \{{\{{\s*[^{{}}\n]{{1,60}}\}}\}} | \$\{{\s*{_NAME}\s*\}} | \$\(\s*{_NAME}\s*\) | \#\{{\s*{_NAME}\s*\}} | \{{%\s*[^%\n]{{1,60}}%\}} | <%=?\s*[^%\n]{{1,60}}%>
    | \[\[\s*{_NAME}\s*\]\] | @@\s*{_NAME}\s*@@ | (?<!\w)__[A-Za-z][A-Za-z]*(?:_[A-Za-z]+)*__(?!\w) | «{_NAME}» | (?<!\w)%[A-Za-z][A-Za-z_]{{2,40}}%(?!\w)
    | (?<!\w)XX[A-Z][A-Z_]{{2,40}}XX(?!\w) | <<\s*{_NAME}\s*>> | &lt;\s*{_NAME}\s*&gt; | (?<!\w)%\d\$[sd] | (?<![\w$])\{{\s*(?:[A-Za-z_]\w{{1,40}}|\d)\s*\}} | \[object\ Object\]
    | (?i:<\s*(?:insert|enter|your|paste|add|type)\b[^<>\n]{{1,60}}>) | (?i:\[\s*(?:insert|enter|your|paste|add|type|fill\ in)\b[^\[\]\n]{{1,60}}\](?!\()) | (?<![\w\]])\[[A-Z][A-Z_ ]{{2,40}}\](?![\w(\[])
    """
)
#: Failed values, defaults and blanks: only in a slot that elsewhere holds an unfilled name.
_WEAK = re.compile(r"(?<![\w.'-])(?:undefined|null|NaN|None|nil|N/A|TBD|TBA|TODO|FIXME|xxx+)(?![\w'-])|(?<!\S)(?:\.\.\.|…|\?\?\?|-{3,}|_{3,})(?!\S)", re.I)
_SYMBOLS, _MARKED = re.compile(r"\W+"), re.compile(r"\x00(.)\x01")
_NUMBER = re.compile(r"(?<![\w.])\d[\d.,:]*(?![\w])")
# Instructions of document templates, filler and sample text.
_INSTRUCTION = re.compile(
    r"(?i)(?:^|[.!?]\s)\W*(?:write (?:\w+ ){0,4}(?:sentences?|paragraphs?|words?) (?:on|about)\b|(?:example|description|content|text|summary|title|code|image)s? goes? here\b|(?:insert|add|put|enter) (?:your |the |a )?[\w ]{1,30} here\b|describe (?:your|the) [\w ]{1,30} here|to be (?:written|filled in)\W*$)"
)
_FILLER = re.compile(
    r"(?i)\blorem ipsum\b|\b(?:this is )?(?:sample|dummy|filler|placeholder) (?:text|copy|content|paragraph)\b(?=.{0,40}(?:goes|here|replace|only|fills|\d|\W*$))|this copy only fills|replace before publishing|\byour (?:text|title|content|name) (?:goes )?here\b|ダミーテキスト|ここに(?:テキスト|本文|文章)(?:が|を)|サンプルテキスト(?:です|が)|此处(?:输入|填写|为示例|为正文|放置)|(?:示例|占位)(?:文本|文字)|\bblindtext\b|platzhaltertext|hier steht (?:\w+ ){0,2}(?:ihr|dein|der|unser)(?: \w+)? text|\b(?:real|actual|final) (?:text|content|copy) (?:goes|comes|will (?:go|come|be|stand|follow)|follows)\b|\bici (?:viendra|suivra|sera|figurera|se trouvera) (?:le|votre|un) (?:\w+ )?texte|\baqu[ií] (?:va|ir[áa]|viene|vendr[áa]|aparecer[áa]) (?:el|su|tu|un) (?:\w+ )?texto|texte? (?:de remplissage|factice|d['’]exemple)|votre texte ici|texto de (?:relleno|ejemplo|muestra)|(?:su|tu) texto aqu[ií]|faux[- ]texte|the quick brown fox jumps"
)
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur mauris pellentesque vestibulum curabitur vulputate sodales cursus fringilla veniam".split()
)
# What browsers, servers and pages say in place of a page.
_STATUS_WORDS = r"(?:page |file |document |resource )?not found|(?:access |permission )?(?:denied|forbidden)|access is forbidden|unauthori[sz]ed|bad request|internal server error|server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|too many requests|gone|method not allowed|not acceptable|conflict|payment required|proxy error|connection (?:refused|reset|timed out)|payload too large|uri too long|not implemented|i'm a teapot"
_STATUS_LINE = re.compile(
    rf"(?i)^\W*(?:(?:http(?:/\d(?:\.\d)?)?|(?:http\s+)?(?:status|error|fehler|erreur))(?:\s+code)?\W*[45]\d\d\b\W*(?:(?:{_STATUS_WORDS})\b.{{0,80}})?$|[45]\d\d\b\W*(?:{_STATUS_WORDS})\W*$|(?:{_STATUS_WORDS})\W+\(?(?:http|error|code)?\W*[45]\d\d\)?\W*$|(?:error\W+)?(?:{_STATUS_WORDS})\W*$)"
)
_ERROR_SENTENCE = re.compile(
    r"""(?ix)(?:^|[\s>.!?。])(?:
    the\ (?:page|address|document|file|resource|content|url|view|site)\ (?:you\ (?:asked\ for|requested|are\ looking\ for|were\ looking\ for|tried\ to\ \w+)\ )?(?:does\ not\ exist|doesn['’]t\ exist|could\ not\ be\ found|cannot\ be\ found|can['’]t\ be\ found|has\ moved|has\ been\ (?:moved|removed)|was\ not\ found|is\ (?:not|no\ longer)\ available)
    | we\ (?:can['’]t|cannot|could\ not|couldn['’]t|were\ unable\ to)\ find\ (?:that|the|this|your)\ (?:page|address|document)
    | no\ \w+\ matches\ this\ (?:address|url) | (?:oops|sorry|uh[- ]oh|whoops)\W+\s*(?:something\ went\ wrong|an?\ (?:unexpected\ )?error) | something\ went\ wrong\ on\ our\ (?:side|end)
    | you\ (?:do\ not|don['’]t)\ have\ (?:permission|access|the\ right)\ to\ (?:view|access|see|open) | you\ are\ not\ (?:allowed|authori[sz]ed|permitted)\ to\ (?:view|access|see|open)
    | your\ session\ has\ (?:expired|ended|timed\ out) | your\ (?:address|ip|client|network)\ (?:address\ )?(?:has\ )?(?:sent\ (?:more|too\ many)\ requests|been\ blocked|is\ blocked) | this\ (?:document|page|file)\ (?:was|has\ been)\ removed | (?:is\ )?no\ longer\ public\b
    | (?:we\ are|this\ (?:site|page|service)\ is)\ (?:currently\ |temporarily\ )?(?:down|offline|closed|undergoing)\ (?:for\ )?(?:\w+\ )?maintenance | an?\ (?:unexpected\ |unknown\ |internal\ )?error\ (?:has\ )?occurred | the\ upstream\ (?:server\ )?did\ not\ (?:answer|respond) | temporarily\ unavailable\W*$
    | the\ server\ (?:could\ not|was\ unable\ to|cannot|did\ not)\ (?:handle|process|complete|respond|answer) | (?:please\ )?(?:log|sign)\ in\ (?:again\ )?to\ (?:continue|view\ this) | template\w*error\s*:
    | seite\ (?:wurde\ )?nicht\ gefunden | die\ (?:angeforderte|gew[üu]nschte)\ (?:adresse|seite)\b | zugriff\ verweigert | interner\ serverfehler | sie\ haben\ keine\ (?:berechtigung|rechte) | dienst\ nicht\ verf[üu]gbar
    | page\ (?:introuvable|non\ trouv[ée]e) | acc[èe]s\ (?:refus[ée]|interdit) | erreur\ interne\ du\ serveur | la\ page\ (?:demand[ée]e|que\ vous\ (?:demandez|cherchez)) | veuillez\ vous\ (?:re)?connecter | service\ (?:temporairement\ )?indisponible
    | p[áa]gina\ no\ encontrada | la\ (?:direcci[óo]n|p[áa]gina)\ solicitada | acceso\ denegado | error\ interno\ del\ servidor | no\ (?:tiene|tienes)\ permiso | servicio\ no\ disponible
    )|(?:ページ|お探しのページ)(?:が|は)?(?:見つかりません|存在しません)|アクセスが?(?:拒否|許可されて)|(?:内部)?サーバー(?:内部)?エラー|権限がありません|サービスを利用できません|(?:页面|网页)(?:不存在|未找到|找不到)|找不到(?:该|此|您要的|您访问的)?(?:页面|网页)|(?:访问被拒绝|拒绝访问|禁止访问)|(?:内部)?服务器(?:内部)?错误|您没有权限|服务(?:暂时)?不可用"""
)
_ERROR_JSON = re.compile(r"""(?i)^\s*\{\s*"(?:status|statuscode|code|error|errors|message|detail|title|type)"\s*:.*(?:\b[45]\d\d\b|error|denied|not found|forbidden).*\}""")
_ERROR_HTML = re.compile(rf"(?is)<(?:title|h1)>[^<]*(?:\b[45]\d\d\b|{_STATUS_WORDS})[^<]*</(?:title|h1)>")
_SCRIPT = r"(?:java\s?script|scripting|(?:client[-\ ]side\ )?scripts?|skript(?:en?)?|javascripts?)"
_SCRIPT_NOTICE = re.compile(
    rf"""(?ix)
    \b(?:enable|activate|allow|turn\ on|switch\ on|permit|unblock)\ (?:\w+\ )?{_SCRIPT}\b(?!\W*(?:rule|test|check|file))
    | \b(?:needs?|requires?|relies\ on|depends\ on)\ (?:to\ (?:enable|allow)\ )?{_SCRIPT}\b\W*(?:$|to\b|[.!,;])
    | \b{_SCRIPT}\ (?:must\ be|is|are|has\ to\ be|have\ to\ be|needs\ to\ be|seems?\ to\ be|appears?\ to\ be|was|were)\ (?:\w+\ )?(?:enabled|allowed|required|needed|disabled|blocked|turned\ off|switched\ off|turned\ on)
    | \b{_SCRIPT}\ (?:disabled|blocked|required|needed)\s*: | (?:does|do)\ not\ (?:support|run|allow)\ {_SCRIPT} | (?:doesn['’]t|don['’]t)\ (?:support|run|allow)\ {_SCRIPT}
    | (?:won['’]t|will\ not|does\ not|doesn['’]t|cannot|can['’]t)\ (?:\w+\ )?(?:work|run|start|load|be\ (?:shown|displayed))\ (?:properly\ |correctly\ )?(?:without|with)\ {_SCRIPT} | \bwithout\ {_SCRIPT}\W*(?:enabled|$)
    | \buse\ {_SCRIPT}\ to\ \w+\ .{{1,60}}(?:blocked|disabled|turned\ off|switched\ off) | (?:browser|page|site|app)\ .{{0,40}}{_SCRIPT}\ (?:switched|turned)\ off | <noscript>
    | (?:only\ (?:works?|runs?|starts?)|(?:works?|runs?|starts?)\ only)\ with\ (?:\w+\ ){{0,2}}{_SCRIPT}\b(?!\ off) | \bnur\ mit\ (?:\w+\ ){{0,2}}{_SCRIPT}\b | (?:uniquement|seulement)\ (?:avec|si)\ (?:\w+\ ){{0,2}}{_SCRIPT} | \bs[óo]lo\ (?:\w+\ )?con\ (?:\w+\ ){{0,2}}{_SCRIPT}
    | {_SCRIPT}\ (?:aktivieren|einschalten|erlauben|zulassen)|aktivieren\ sie\ (?:bitte\ )?{_SCRIPT}|{_SCRIPT}\ (?:ist|muss|wird)\ .{{0,30}}(?:deaktiviert|aktiviert|ben[öo]tigt|erforderlich|ausgeschaltet)|ben[öo]tigt\ {_SCRIPT}
    | (?:activer|autoriser|activez|autorisez)\ (?:le\ |les\ )?{_SCRIPT}|sans\ (?:le\ |les\ )?{_SCRIPT}|n[ée]cessite\ (?:le\ |les\ )?{_SCRIPT}|{_SCRIPT}\ (?:est|doit|sont)\ .{{0,30}}(?:d[ée]sactiv|activ|requis|n[ée]cessaire|bloqu)
    | (?:active|activar|habilite|habilitar|active\ usted|permita|habilita)\ (?:el\ |los\ )?{_SCRIPT}|(?:requiere|necesita)\ (?:el\ )?{_SCRIPT}|sin\ {_SCRIPT}|{_SCRIPT}\ (?:est[áa]|debe)\ .{{0,30}}(?:desactivad|activad|habilitad|bloquead)
    | {_SCRIPT}\s*(?:を有効|をオン|が無効|が必要|をご利用|を許可)|(?:启用|开启|打开|允许|需要)\s*{_SCRIPT}|{_SCRIPT}\s*(?:已禁用|被禁用|未启用)
    """
)
_BROWSER_CHECK = re.compile(r"(?i)\bchecking your browser before\b|verify(?:ing)? (?:that )?you are (?:a )?human|complete the captcha|ブラウザを確認しています|正在检查您的浏览器")
_LINE_ENDS = re.compile("[\r\u2028\u2029\x85\x0b\x0c]")
_QUOTES = "\"“„'‘«「『‹"
_SPLIT = re.compile(r"\n+|(?<=[.!?])\s+(?=\S)|(?<=[。！？])")


# Control tokens of language models.
_INVISIBLE = re.compile(r"<\|[A-Za-z_]{2,40}\|>|</?(?:s|pad|unk|mask|bos|eos|cls|sep)>|\[(?:PAD|UNK|CLS|SEP|MASK|BOS|EOS|/?INST)\]|<</?SYS>>|[\u200b-\u200f\u2060-\u2064\ufeff\u00ad]")
_LATIN_MARKS = re.compile(r"(?<=[A-Za-z])[\u0300-\u036f]+")


def _is_code(line: str) -> bool:
    """Whether the first sentence of the line begins with a word of a language and has the structure of code."""
    if not _CODE_WORD.match(line):
        return False
    bare = _QUOTED.sub(_QUOTE, _INLINE.sub(_QUOTE, line))
    return bool(_CODE_FORM.search(_SPLIT.split(_STRONG.sub("\x01", bare))[0]))


def content_lines(text: str) -> list[str]:
    """Lines of a text, without code and with quotes emptied; lines that show something (logs, usage, code) left out.

    Control tokens of language models and invisible characters are taken out, white space is made plain.
    """
    t = _INVISIBLE.sub("", _LINE_ENDS.sub("\n", text.replace("\r\n", "\n")))
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n", t)
    out = []
    for line in t.split("\n"):
        x = " ".join(line.split())
        if not x:
            continue
        if x[0] in "{<" and (_ERROR_JSON.match(x) or re.search(r"(?i)<(?:title|h1|noscript)>", x)):
            out.append(x)
        elif not _SHOWN_LINE.match(x) and not _is_code(x):
            if "`" in x:
                x = _INLINE.sub(_QUOTE, x)
            if any(c in x for c in _QUOTES):
                x = _QUOTED.sub(_QUOTE, x)
            out.append(x)
    return out


_WORD = re.compile(r"[^\W\d_]+")


def _repeated_words(x: str) -> bool:
    """One short word over and over."""
    w = _WORD.findall(x)
    return len(w) >= 8 and len(set(w)) <= max(1, len(w) // 8) and max(map(len, w)) <= 12


def _repeated_sentence(line: str) -> bool:
    """One sentence of several words at least three times and nothing else."""
    parts = [p.strip() for p in _SPLIT.split(line) if p.strip()]
    return len(parts) > 2 and len(set(parts)) == 1 and len(parts[0]) >= 12


def _latin_share(x: str) -> bool:
    w = _WORD.findall(x)
    return len(w) >= 8 and sum(t in _LATIN for t in w) >= 0.5 * len(w) and len({t for t in w if t in _LATIN and len(t) > 3}) >= 4


# For each family of messages the fragments of which each of its alternatives holds at least one, in any
# spelling of accents. A line without a fragment cannot match, so that they only save time.
_FRAGMENTS = {
    "script": ("script", "skript"),
    "browser": ("checking your browser", "are human", "are a human", "the captcha", "ブラウザを確認しています", "正在检查您的浏览器"),
    "error": (
        "exist", "be found", "has moved", "been moved", "been removed", "not found", "available", "find that", "find the", "find this", "find your", "matches this", "error", "went wrong", "permission", "have access", "the right to",
        "allowed", "authori", "permitted", "denied", "forbidden", "session has", "sent more", "too many requests", "been blocked", "is blocked", "was removed", "longer public", "maintenance", "occurred", "upstream",
        "the server", "to continue", "view this", "bad request", "bad gateway", "time-out", "timeout", "timed out", "gone", "not acceptable", "conflict", "payment required", "connection re", "too large", "too long", "not implemented", "teapot",
        "fehler", "erreur", "nicht gefunden", "angeforderte", "nschte", "verweigert", "sie haben keine", "gbar", "introuvable", "non trouv", "refus", "interdit", "la page ", "veuillez vous", "indisponible",
        "no encontrada", "solicitada", "denegado", "permiso", "no disponible", "ページ", "アクセス", "サーバー", "権限がありません", "サービスを利用できません", "页面", "网页", "访问", "服务器", "您没有权限", "服务",
    ),
    "filler": (
        "lorem ipsum", "sample text", "sample copy", "sample content", "sample paragraph", "dummy ", "filler ", "placeholder ", "copy only fills", "before publishing", " here", "ダミーテキスト", "ここに", "サンプルテキスト", "此处", "示例", "占位",
        "blindtext", "platzhaltertext", "hier steht", "remplissage", "texte factice", "text factice", "exemple", "votre texte ici", "texto de", "texto aqu", "aqu", "ici ", "real text", "real content", "real copy", "actual text", "actual content", "actual copy", "final text", "final content", "final copy", "faux texte", "faux-texte", "quick brown fox", "write ", "to be written", "to be filled",
    ),
    "latin": tuple(sorted(w for w in _LATIN if len(w) > 3)),
    "slot": ("undefined", "null", "nan", "none", "nil", "n/a", "tbd", "tba", "todo", "fixme", "xxx"),
}
_FAMILY = {f: 1 << i for i, f in enumerate(_FRAGMENTS)}


def _automaton() -> ahocorasick.Automaton:
    found: dict[str, int] = {}
    for family, fragments in _FRAGMENTS.items():
        for x in fragments:
            found[x] = found.get(x, 0) | _FAMILY[family]
    out = ahocorasick.Automaton()
    for x, bits in found.items():
        out.add_word(x, bits)
    out.make_automaton()
    return out


_AUTOMATON = _automaton()
_STATUS_NUMBER = re.compile(r"[45]\d\d")


def _families(low: str) -> int:
    bits = 0
    for _, b in _AUTOMATON.iter(low):
        bits |= b
    return bits


def message_kind(line: str) -> str | None:
    """filler, error_page or script_notice if the line is such a message itself."""
    low = line.lower()
    return _message_kind(line, low, _families(low))


def _message_kind(line: str, low: str, bits: int) -> str | None:
    if bits & _FAMILY["script"] and _SCRIPT_NOTICE.search(line) or bits & _FAMILY["browser"] and _BROWSER_CHECK.search(line):
        return "script_notice"
    if bits & _FAMILY["error"] and (_STATUS_LINE.match(line) or _ERROR_SENTENCE.search(line)):
        return "error_page"
    if (bits & _FAMILY["error"] or _STATUS_NUMBER.search(line)) and (_STATUS_LINE.match(line) or _ERROR_JSON.match(line) or _ERROR_HTML.search(line)):
        return "error_page"
    if bits & _FAMILY["filler"] and (_FILLER.search(line) or _INSTRUCTION.search(line)):
        return "filler"
    if len(line) >= 39 and _repeated_sentence(line):
        return "filler"
    if len(line) >= 15 and (_repeated_words(low) or bits & _FAMILY["latin"] and _latin_share(low)):  # eight words have 15 characters
        return "filler"
    return None


def _unmarked(line: str) -> str:
    """The line without accents on Latin letters."""
    return line if line.isascii() else unicodedata.normalize("NFC", _LATIN_MARKS.sub("", unicodedata.normalize("NFD", line)))


_MAY_BE_SLOT = re.compile(r"[{}$%\[\]<>&@«_]|XX|\.\.\.|…|\?\?\?|---")


def slots(unit: str) -> tuple[str, list[str]]:
    """The template of a unit, with all that may be a filled or unfilled slot cut out, and the kind of each slot.

    Kinds: s an unfilled name, w a failed value, default or blank, v a number, q something quoted.
    """
    marked = _STRONG.sub("\x00s\x01", unit)
    marked = _WEAK.sub("\x00w\x01", marked)
    marked = _NUMBER.sub("\x00v\x01", marked)
    marked = marked.replace(_QUOTE, "\x00q\x01")
    return _SYMBOLS.sub(" ", _MARKED.sub(" 0 ", marked).casefold()).strip(), _MARKED.findall(marked)


def _template_id(template: str) -> int:
    return xxhash.xxh64_intdigest(template.encode("utf-8", "replace")) - (1 << 63)


# Scripts without spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
_UNSPACED = re.compile(r"[\u0e01-\u0edf\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


_HTTP_STATUS = re.compile(r"(?<![\w.,:/-])(?:40\d|41[0-8]|42[1-689]|431|451|50[0-8]|51[01])(?![\w%/-]|[.,:]\d)")


def page_template(lines: list[str], slotted: bool) -> str:
    """The template of a whole page: all its lines without slots (if it may have any) and addresses."""
    page = "\n".join(lines)
    if "/" in page or "@" in page:
        page = "\n".join(" ".join("0" if "/" in w or "@" in w else w for w in x.split(" ")) for x in page.split("\n"))
    return slots(page)[0] if slotted else _SYMBOLS.sub(" ", _NUMBER.sub(" 0 ", page.replace(_QUOTE, " 0 ")).casefold()).strip()


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text in zip(b["doc_id"], b["text"]):
            if not text or len(text) < 12 and len(text.split()) < 2 and not _UNSPACED.search(text):
                continue
            lines, kinds, slotted = content_lines(text), set(), False
            for line in lines:
                low = line.lower()
                bits = _families(low)
                kind = _message_kind(line, low, bits) or (message_kind(_unmarked(line)) if not line.isascii() else None)
                if kind:
                    kinds.add(kind)
                    rows.append((doc, kind, _template_id(slots(line)[0]), 0, "m"))
                if bits & _FAMILY["slot"] or _MAY_BE_SLOT.search(line):
                    slotted = True
                    for unit in _SPLIT.split(line):
                        template, found = slots(unit)
                        if "s" in found or "w" in found:
                            t = _template_id(template)
                            rows += [(doc, "placeholder", t, i, k) for i, k in enumerate(found)]
            if lines:
                status = _HTTP_STATUS.search(lines[0])
                rows.append((doc, "error_page" if "error_page" in kinds else "page", _template_id(page_template(lines, slotted)), int(status.group()) if status else 0, "p"))
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "template", "slot", "filler"])


def residue_units(documents: DataFrame) -> DataFrame:
    """The places of ``documents`` which may be residue: doc_id, kind, template (a hash), slot, filler.

    A message (kind filler, error_page or script_notice) has the filler m; a sentence with placeholder or failed value
    gives a row for each of its slots; each page gives one with the filler p, its kind being error_page if it holds such a
    message, else page, and its slot the status of HTTP in its first line, else 0. Null, empty, blank and one-word texts give none;
    a text without spaces is one word only in scripts that put them.
    """
    return spread(documents.select("doc_id", "text").where(F.col("text").isNotNull())).mapInPandas(_units, "doc_id long, kind string, template long, slot long, filler string")


def induced_templates(units: DataFrame) -> DataFrame:
    """What all records of a template show of each of its slots: template, slot, kind, records, documents, names, failed, messages.

    Records are aligned by the template; a message is a slot of its own (kind its family). Aggregated before the shuffle,
    so that a template of very many records gathers nowhere; documents is counted from the pairs of template and document.
    """
    at = units.where("filler != 'p'").groupBy("template", "slot", "kind", "doc_id").agg(*[F.count_if(F.col("filler") == f).alias(c) for f, c in (("s", "names"), ("w", "failed"), ("m", "messages"))], F.count(F.lit(1)).alias("records"))
    return at.groupBy("template", "slot", "kind").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("records", "names", "failed", "messages")])


def judged_slots(templates: DataFrame) -> DataFrame:
    """Slots that are residue: template, slot, kind, documents, fillers (those that are residue there).

    A slot that retains a name in any record is one of names, in those records; if names are at least SLOT_SHARE of its
    fillers, failed values, defaults and blanks are residue too. A template of a message is residue as a whole.
    """
    fillers = F.when(F.col("messages") > 0, F.array(F.lit("m"))).when((F.col("names") > 0) & (F.col("names") >= SLOT_SHARE * F.col("records")), F.array(F.lit("s"), F.lit("w"))).when(F.col("names") > 0, F.array(F.lit("s")))
    return templates.select("template", "slot", "kind", "documents", fillers.alias("fillers")).where("fillers is not null")


def error_templates(units: DataFrame) -> DataFrame:
    """Templates of whole pages which recur and are judged to be error pages by what all their records hold: template, documents.

    Either enough of the records hold a message of an error page, or nearly all have a status of HTTP in the first line,
    and not all the same, as a number that is a slot of the server's page has.
    """
    one = units.where("filler = 'p'").groupBy("template", "doc_id").agg(F.max(F.col("kind") == "error_page").alias("message"), F.max("slot").alias("status"))
    n = F.count(F.lit(1))
    seen = one.groupBy("template").agg(n.alias("n"), F.count_if("message").alias("messages"), F.count_if(F.col("status") > 0).alias("statuses"), F.max("status").alias("most"), F.min(F.when(F.col("status") > 0, F.col("status"))).alias("least"))
    by_status = (F.col("statuses") >= PAGE_STATUSES * F.col("n")) & (F.col("most") > F.col("least"))
    return seen.where((F.col("n") >= MIN_PAGES) & ((F.col("messages") >= PAGE_MESSAGES * F.col("n")) | by_status)).select("template", F.col("n").alias("documents"))


def residue_documents(documents: DataFrame) -> DataFrame:
    """One row for each document with residue: doc_id and the kinds found (sorted array).

    Sentences are aligned by their template (all but their slots). A slot that retains a variable name is residue; a
    failed value, default or blank (undefined, null, TBD, ...) is residue only in a slot which in at least SLOT_SHARE
    of the records of its template retains a name, so that a sentence about null values is none. Messages of error
    pages, filler and script notices are residue where a line is such a message itself; a page in any wording is
    one if its template recurs and is judged an error page (``error_templates``). Code, quotes, log lines and usage lines are left out before. Null, empty, blank and one-word texts, and an empty table, give no rows; repeated
    rows give one row a doc_id; extra columns are ignored.
    """
    return residue_places(documents).groupBy("doc_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def residue_places(documents: DataFrame) -> DataFrame:
    """The places of residue: doc_id, kind, template, documents (that have this template)."""
    units = materialise(residue_units(documents), "residue")
    judged = materialise(judged_slots(induced_templates(units)), "judged")
    slots_of = units.where("filler in ('m', 's', 'w')").join(maybe_broadcast(judged), ["template", "slot", "kind"]).where(F.array_contains("fillers", F.col("filler"))).select("doc_id", "kind", "template", "documents")
    errors = materialise(error_templates(units), "pages")
    pages = units.where("filler = 'p'").join(maybe_broadcast(errors), "template").select("doc_id", F.lit("error_page").alias("kind"), "template", "documents")
    return slots_of.unionByName(pages).distinct()


def repeated_pages(documents: DataFrame, least: int = 2) -> DataFrame:
    """Message templates that stand in at least ``least`` documents: template, kind, documents."""
    return induced_templates(residue_units(documents)).where((F.col("messages") > 0) & (F.col("documents") >= least)).select("template", "kind", "documents")


def alignment_report(documents: DataFrame) -> DataFrame:
    """How many documents are found in all, and through a template that at least two documents have: kind, found, aligned."""
    best = residue_places(documents).groupBy("doc_id", "kind").agg(F.max("documents").alias("most"))
    return best.groupBy("kind").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("most") > 1).alias("aligned"))
