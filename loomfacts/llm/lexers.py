"""Tokens of Go and of JavaScript, TypeScript and their JSX forms, for the grammars in ``grammars``."""

from __future__ import annotations

import re


class LexError(Exception):
    """No token can be read: position and cause."""

    def __init__(self, at: int, cause: str) -> None:
        super().__init__(f"{cause} at {at}")
        self.at, self.cause = at, cause


# Reserved words and operators of the languages.
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_GO_OPS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~"
_JS_OPS = "**= <<= &&= ||= ??= === !== ... => ** ++ -- << <= == != && || ?? += -= *= /= %= &= |= ^= { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @"
_GO_ENDS = frozenset(["ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def _ops(text: str) -> str:
    """Alternatives for operators: single characters that begin no other one first, the others by their first character."""
    by: dict[str, list[str]] = {}
    for x in text.split():
        by.setdefault(x[0], []).append(x[1:])
    alone = "".join(re.escape(c) for c, rest in by.items() if rest == [""])
    grouped = [("/(?![*/])" if c == "/" else re.escape(c)) + "(?:" + "|".join(map(re.escape, sorted((r for r in rest if r), key=len, reverse=True))) + ")" + ("?" if "" in rest else "") for c, rest in by.items() if rest != [""]]
    return f"[{alone}]|" + "|".join(grouped)


_GO_ESC = r"\\(?:[abfnrtv\\{q}]|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}})"
_GO = re.compile(
    rf"""[ \t\r]*(?:(?P<word>[^\W\d]\w*)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<STR>"(?:[^"\\\n]|{_GO_ESC.format(q='"')})*"|`[^`]*`|'(?:[^'\\\n]|{_GO_ESC.format(q="'")})')
    |(?P<NUM>(?:0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?)
    |(?P<op>{_ops(_GO_OPS)})|(?P<end>\Z))""",
    re.X,
)


def lex_go(src: str) -> tuple[list[str], list[str], set[int], list[int], dict[int, int]]:
    """Kinds, texts, (unused) newlines, positions and (unused) bracket partners; semicolons are put in at line ends."""
    kinds: list[str] = []
    texts: list[str] = []
    starts: list[int] = []
    kind, text, start = kinds.append, texts.append, starts.append
    words, ends = GO_WORDS, _GO_ENDS
    at, n, last = 1 if src[:1] == "\ufeff" else 0, len(src), ""
    for m in _GO.finditer(src, at):
        g = m.lastgroup
        e = m.end()
        s = m[g]
        if m.start() != at:
            break
        at = e
        if g == "word":
            last = s if s in words else "ID"
        elif g == "op":
            last = s
        elif g == "STR" or g == "NUM":
            last = g
        elif g == "nl" or g == "bc" and "\n" in s:
            if last in ends:
                kind(";")
                text("\n")
                start(e)
            last = ""
            continue
        elif g == "end":
            break
        else:
            continue
        kind(last)
        text(s)
        start(e - len(s))
    else:
        at = min(at, n)
    if at < n:
        while src[at] in " \t\r":
            at += 1
        raise LexError(at, "unterminated comment" if src.startswith("/*", at) else "unterminated string" if src[at] in "\"'`" else "illegal character")
    if last in ends:
        kind(";")
        text("\n")
        start(n)
    kinds += ["EOF"] * 6
    texts += [""] * 6
    starts += [n] * 6
    return kinds, texts, set(), starts, {}


_JS_STR = r"""\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}|\r\n|[^xu])"""
_JS = re.compile(
    rf"""[ \t]*(?:(?P<nl>[\n\r\u2028\u2029]\s*)|(?P<lc>//[^\n\r\u2028\u2029]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<word>\#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{{4}})*)
    |(?P<STR>"(?:[^"\\\n\r]|{_JS_STR})*"|'(?:[^'\\\n\r]|{_JS_STR})*')
    |(?P<NUM>(?:0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?n?)(?![\w$]))
    |(?P<opt>\?\.(?!\d))|(?P<op>{_ops(_JS_OPS)})|(?P<tpl>`)|(?P<sp>[^\S\n\r\u2028\u2029\x1c-\x1f\x85]+|\ufeff+|\Z))""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*(?![\w$])")
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_NAME = re.compile(r"[^\W\d][\w\-]*|\$[\w\-]*")
_JSX_SPACE = re.compile(r"(?:\s+|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*)*")
_JSX_TEXT = re.compile(r"[^{}<>]+")
_JSX_STR = re.compile(r'"[^"]*"|\'[^\']*\'')
_JSX_TYPES = re.compile(r"<[^<>{}]*(?:<[^<>{}]*>[^<>{}]*)*>")
_GENERIC_ARROW = re.compile(r"<\s*(?:const\s+)?[^\W\d]\w*\s*(?:,|extends\b)")
#: After these a slash divides and ``<`` compares.
_OPERAND_ENDS = frozenset(["ID", "NUM", "STR", "TPL", "TPLT", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "J>", "J/>"])
_PAREN_WORDS = frozenset(["if", "while", "for", "with"])
#: A brace after these opens an object, so that an operand ends with its partner.
_OBJECT_BEFORE = frozenset("( [ , = return ? : += -= && || ?? ... typeof new in of throw case !== === == != + - * / ! default TPLH TPLM J{ => await yield".split()) - {"=>", ":"}


def lex_js(src: str, jsx: bool, fast: bool = False) -> tuple[list[str], list[str], set[int], list[int], dict[int, int]]:
    """Kinds, texts, the tokens after a line end, positions and, for ( and [ and {, the index of the partner.

    With ``fast`` lines that read the same wherever they stand come from a table of lines read before, and positions are
    left out.

    The lexer keeps a stack of what is open, which tells templates, JSX tags and children, and whether a slash begins a
    regular expression.
    """
    kinds: list[str] = []
    texts: list[str] = []
    newline: set[int] = set()
    starts: list[int] = []
    partner: dict[int, int] = {}
    kind, text, start = kinds.append, texts.append, starts.append
    words = JS_WORDS
    stack: list[tuple] = []  # (what is open, index of its token, extra)
    tags: list[str] = []
    at, n = 0, len(src)
    if src[:1] == "\ufeff":
        at = 1
    if src.startswith("#!", at):
        while at < n and src[at] not in "\n\r":
            at += 1
    match = _JS.match
    nl, last = False, ""
    operand_end = False  # whether the last token ends an operand
    known = _JS_LINES[jsx]
    fresh = fast  # at the beginning of a line

    def add(kind: str, text: str, pos: int) -> None:
        nonlocal nl, last
        if nl:
            newline.add(len(kinds))
            nl = False
        kinds.append(kind)
        texts.append(text)
        starts.append(pos)
        last = kind

    def template(pos: int, head: bool) -> int:
        """The part of a template from pos to its end or to the next substitution."""
        nonlocal operand_end
        e = _TPL.match(src, pos).end()
        if e >= n:
            raise LexError(pos, "unterminated template")
        if src[e] == "`":
            add("TPL" if head else "TPLT", "", pos)
            operand_end = True
            return e + 1
        add("TPLH" if head else "TPLM", "", pos)
        stack.append(("tpl", len(kinds) - 1, None))
        operand_end = False
        return e + 2

    def tag(pos: int) -> int:
        """A JSX tag from its < on; afterwards children or JavaScript follow."""
        nonlocal operand_end
        start = pos
        pos = _JSX_SPACE.match(src, pos + 1).end()
        closing = src[pos : pos + 1] == "/"
        if closing:
            pos = _JSX_SPACE.match(src, pos + 1).end()
        add("J</" if closing else "J<", "", start)
        name = ""
        while True:
            m = _JSX_NAME.match(src, pos)
            if not m:
                break
            add("JID", m.group(), pos)
            name += m.group()
            pos = _JSX_SPACE.match(src, m.end()).end()
            if src[pos : pos + 1] in (".", ":") and src[pos : pos + 1]:
                add(src[pos], src[pos], pos)
                name += src[pos]
                pos = _JSX_SPACE.match(src, pos + 1).end()
            else:
                break
        if closing:
            if src[pos : pos + 1] != ">":
                raise LexError(pos, "unterminated tag")
            if not tags or tags[-1] != name:
                raise LexError(start, "closing tag without opening tag")
            tags.pop()
            add("J>", "", pos)
            return after_element(pos + 1)
        stack.append(("tag", len(kinds) - 1, name))
        return pos

    def after_element(pos: int) -> int:
        nonlocal operand_end
        operand_end = True
        return pos

    while at < n:
        top = stack[-1][0] if stack else ""
        if top == "tag":
            at = _JSX_SPACE.match(src, at).end()
            if at >= n:
                break
            c = src[at]
            if c == ">":
                name = stack.pop()[2]
                add("J>", "", at)
                tags.append(name)
                stack.append(("kids", len(kinds), name))
                at += 1
            elif c == "/" and src[at + 1 : at + 2] == ">":
                stack.pop()
                add("J/>", "", at)
                at = after_element(at + 2)
            elif c == "{":
                add("{", "{", at)
                stack.append(("jsx{", len(kinds) - 1, None))
                operand_end = False
                last = "J{"
                at += 1
            elif c in "\"'":
                m = _JSX_STR.match(src, at)
                if not m:
                    raise LexError(at, "unterminated string")
                add("STR", m.group(), at)
                at = m.end()
            elif c == "<" and kinds[-1] in ("=",):
                at = tag(at)
            elif c == "<" and (m := _JSX_TYPES.match(src, at)):
                at = m.end()
            elif c in "=:.":
                add(c, c, at)
                at += 1
            else:
                m = _JSX_NAME.match(src, at)
                if not m:
                    raise LexError(at, "unexpected character in tag")
                add("JID", m.group(), at)
                at = m.end()
            continue
        if top == "kids":
            c = src[at]
            if c == "{":
                add("{", "{", at)
                stack.append(("jsx{", len(kinds) - 1, None))
                operand_end = False
                last = "J{"
                at += 1
            elif c == "<":
                if re.match(r"<\s*/", src[at : at + 40]):
                    stack.pop()
                at = tag(at)
            else:
                m = _JSX_TEXT.match(src, at)
                if not m:
                    raise LexError(at, "unexpected character in JSX text")
                add("JTXT", "", at)
                at = m.end()
            continue
        if fresh:
            fresh = False
            eol = src.find("\n", at)
            if eol < 0:
                eol = n
            line = src[at : eol - 1 if src[eol - 1 : eol] == "\r" else eol]
            t = known.get(line, 0)
            if t == 0:
                t = _read_line(line, "tsx" if jsx else "typescript")
            if t is not None and not (t[1] and t[1][0] in words and (last == "." or last == "?.")) and len(t[4]) <= len(stack) and all(stack[-1 - i][0] == o for i, o in enumerate(t[4])):
                k, x, brackets, end, _ = t
                if k:
                    base = len(kinds)
                    if nl:
                        newline.add(base)
                        nl = False
                    flag = None
                    for i, s, opens in brackets:
                        if s == "(" or s == "[":
                            stack.append((s, base + i, (last in _PAREN_WORDS or last == "ID" and base > 1 and texts[-1] == "await" and kinds[-2] == "for") if opens is None else opens))
                        elif s == "{":
                            stack.append((s, base + i, last in _OBJECT_BEFORE if opens is None else opens))
                        else:
                            _, j, flag = stack.pop()
                            partner[j] = base + i
                    kinds += k
                    texts += x
                    operand_end = end if end is not None else (bool(flag) if k[-1] == "}" else not flag) if k[-1] in (")", "]", "}") else last in _OPERAND_ENDS and base not in newline
                    last = k[-1]
                at = eol
                continue
        m = match(src, at)
        if m is None:
            while src[at] in " \t":
                at += 1
            raise LexError(at, "unterminated comment" if src.startswith("/*", at) else "unterminated string" if src[at] in "\"'" else "illegal character")
        g = m.lastgroup
        if g == "nl":
            nl = True
            at = m.end()
            fresh = fast and (not stack or stack[-1][0] in "([{")
            continue
        if g == "sp":
            at = m.end()
            continue
        if g == "lc":
            at = m.end()
            continue
        if g == "bc":
            at = m.end()
            s = m["bc"]
            if "\n" in s or "\r" in s:
                nl = True
            continue
        at = m.start(g)
        s = m[g]
        if g == "word":
            if nl:
                newline.add(len(kinds))
                nl = False
            start(at)
            text(s)
            at = m.end()
            if s in words and last != "." and last != "?.":
                last = s
                operand_end = s in _OPERAND_ENDS
            elif s[0] == "#":
                last = "PRIV"
                operand_end = True
            else:
                operand_end = s not in ("await", "yield", "of") or last == "." or last == "?."
                last = "ID"
            kind(last)
        elif g == "STR" or g == "NUM":
            if nl:
                newline.add(len(kinds))
                nl = False
            start(at)
            text(s)
            kind(g)
            last = g
            operand_end = True
            at = m.end()
        elif g == "tpl":
            at = template(at + 1, True)
        elif g == "opt":
            add("?.", "?.", at)
            operand_end = False
            at = m.end()
        else:
            if s[0] == "/" and not operand_end:
                r = _REGEX.match(src, at)
                if not r:
                    raise LexError(at, "unterminated regular expression")
                add("REGEX", "", at)
                operand_end = True
                at = r.end()
                continue
            if s[0] == "<" and jsx and not operand_end and not _GENERIC_ARROW.match(src, at):
                at = tag(at)
                continue
            before = last
            if s in ("(", "["):
                add(s, s, at)
                stack.append((s, len(kinds) - 1, before in _PAREN_WORDS or before == "ID" and len(kinds) > 2 and texts[-2] == "await" and kinds[-3] == "for"))
                operand_end = False
            elif s == "{":
                add(s, s, at)
                stack.append(("{", len(kinds) - 1, before in _OBJECT_BEFORE))
                operand_end = False
            elif s in (")", "]"):
                want = "(" if s == ")" else "["
                if not stack or stack[-1][0] != want:
                    raise LexError(at, f"unmatched {s}")
                _, i, control = stack.pop()
                add(s, s, at)
                partner[i] = len(kinds) - 1
                operand_end = not control
            elif s == "}":
                if not stack or stack[-1][0] not in ("{", "tpl", "jsx{"):
                    raise LexError(at, "unmatched }")
                what, i, obj = stack.pop()
                if what == "tpl":
                    at = template(at + 1, False)
                    continue
                add(s, s, at)
                partner[i] = len(kinds) - 1
                operand_end = bool(obj)
            else:
                add(s, s, at)
                if s == "++" or s == "--":
                    operand_end = before in _OPERAND_ENDS and (len(kinds) - 1) not in newline
                else:
                    operand_end = False
            at = m.end()
    nl = True
    for _ in range(6):
        add("EOF", "", n)
    return kinds, texts, newline, starts, partner


#: Lines whose tokens are kept; beyond it the table starts anew.
KEEP_LINES = 200_000


class _Lines(dict):
    """Tokens of whole lines. Code repeats its lines, so most of a text is put together from lines read before."""

    def keep(self, line: str, tokens: tuple | None) -> tuple | None:
        if len(self) >= KEEP_LINES:
            self.clear()
        self[line] = tokens
        return tokens


#: Comments that begin a line. Cut out before lines are read alone; a text with a string or comment left open on an earlier line is not read this way at all.
_COMMENT_LINES = re.compile(r"(?m)^[ \t]*/\*(?:[^*]|\*(?!/))*\*/")
_GO_LINES = _Lines()
_JS_LINES = {False: _Lines(), True: _Lines()}


#: Names that a grammar may ask for by their text.
_TOLD_APART = "as async await get set of let static from type interface namespace module declare abstract readonly public private protected override implements keyof unique infer is asserts satisfies enum accessor global require out yield assert target meta constructor".split()


def _name_or_number(not_after: str) -> re.Pattern:
    return re.compile(rf"(?<![\w$\\'#{not_after}])(?:[^\W\d]|\$(?!\{{))(?:\w|\$(?!\{{))*|(?<![\w.$\\])[1-9]\d*(?![\w.])")


_KEPT = {"go": {w: w for w in GO_WORDS}, "js": {w: w for w in JS_WORDS | set(_TOLD_APART)}}
_NAMES = {"": _name_or_number(""), "jsx": _name_or_number("</")}
_PLAIN_STRING = re.compile(r'"[^"\\\n]*"')


def _equal_go(m: re.Match) -> str:
    s = m[0]
    return _KEPT["go"].get(s) or ("1" if s[0] <= "9" and s[0] != "$" else "a")


def _equal_js(m: re.Match, kept: dict[str, str] = _KEPT["js"]) -> str:
    s = m[0]
    return kept.get(s) or ("1" if "0" < s[0] <= "9" else "a")


def shape(src: str, language: str) -> str:
    """The text with plain names, strings and numbers made equal, so that lines of one form become one line.

    It parses if and only if the text does, but for strings and names inside regular expressions, which are left to
    the second look that every failure gets. Names of tags are kept, since they must match.
    """
    if '"' in src:
        src = _PLAIN_STRING.sub('""', src)
    if language == "go":
        return _NAMES[""].sub(_equal_go, src)
    return _NAMES["jsx" if language in ("tsx", "jsx") else ""].sub(_equal_js, src)


def _read_line(line: str, language: str) -> tuple | None:
    """Reads a line by its shape, which far fewer lines have, and keeps the result for the line itself too."""
    known = _GO_LINES if language == "go" else _JS_LINES[language == "tsx"]
    form = shape(line, language)
    t = known.get(form, 0)
    if t == 0:
        if language == "go":
            try:
                k, x, *_ = lex_go(form + "\n")
                t = (k[:-6], x[:-6])
            except LexError:
                t = None
        else:
            t = _js_line(form, language == "tsx")
        known.keep(form, t)
    return known.keep(line, t)


def fast_go(src: str) -> tuple[list[str], list[str], set[int], dict[int, int]] | None:
    """The tokens of lex_go without positions, put together from lines; None if a line cannot be read alone."""
    kinds: list[str] = []
    texts: list[str] = []
    known = _GO_LINES
    if src[:1] == "\ufeff":
        src = src[1:]
    if "/*" in src:
        src = _COMMENT_LINES.sub("\n", src)
    for line in src.split("\n"):
        line = line.strip(" \t\r")
        if line:
            t = known.get(line, 0)
            if t == 0:
                t = _read_line(line, "go")
            if t is None:
                return None
            kinds += t[0]
            texts += t[1]
    kinds += ["EOF"] * 6
    texts += [""] * 6
    return kinds, texts, set(), {}


def fast_js(src: str, jsx: bool) -> tuple[list[str], list[str], set[int], dict[int, int]] | None:
    """The tokens of lex_js without positions, put together from lines; None if a line depends on those before it."""
    kinds: list[str] = []
    texts: list[str] = []
    newline: set[int] = set()
    partner: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    known, language = _JS_LINES[jsx], "tsx" if jsx else "typescript"
    if src[:1] == "\ufeff":
        src = src[1:]
    if "/*" in src:
        src = _COMMENT_LINES.sub("\n", src)
    lines = src.split("\n")
    if lines[0][:2] == "#!":
        lines[0] = ""
    for line in lines:
        line = line.strip(" \t\r")
        if not line:
            continue
        t = known.get(line, 0)
        if t == 0:
            t = _read_line(line, language)
        if t is None:
            return None
        k, x, brackets, _, _ = t
        if not k:
            continue
        base = len(kinds)
        newline.add(base)
        if base and kinds[-1] in (".", "?.") and x[0] in JS_WORDS:
            return None
        for i, s, _ in brackets:
            if s in "([{":
                stack.append((s, base + i))
            elif not stack or stack[-1][0] != _OPENS[s]:
                return None
            else:
                partner[stack.pop()[1]] = base + i
        kinds += k
        texts += x
    newline.add(len(kinds))
    kinds += ["EOF"] * 6
    texts += [""] * 6
    return kinds, texts, newline, partner


def _js_line(line: str, jsx: bool) -> tuple | None:
    """Kinds, texts, brackets and operand end of a line that reads the same wherever it stands.

    A bracket has its index, its text and whether it opens a control head or an object, None where the line before tells.
    """
    if "\r" in line or "\u2028" in line or "\u2029" in line or (jsx and "<" in line):
        return None
    kinds: list[str] = []
    texts: list[str] = []
    brackets: list[tuple[int, str, bool | None]] = []
    local: list[tuple[str, bool]] = []
    closers: list[str] = []  # openings of earlier lines that are closed here
    at, last, end, n = 0, "", None, len(line)  # end: whether the last token ends an operand, None where that depends on other lines
    while at < n:
        m = _JS.match(line, at)
        if m is None:
            return None
        g = m.lastgroup
        begin, at = m.start(g), m.end()
        if g in ("sp", "lc", "nl", "bc"):
            continue
        s = m[g]
        if g == "word":
            if s in JS_WORDS and last != "." and last != "?.":
                k, end = s, s in _OPERAND_ENDS
            else:
                k, end = ("PRIV" if s[0] == "#" else "ID"), s not in ("await", "yield", "of") or last in (".", "?.")
        elif g in ("STR", "NUM"):
            k, end = g, True
        elif g == "tpl" or s == "}" and local and local[-1][0] == "`":
            if g != "tpl":
                local.pop()
            e = _TPL.match(line, at).end()
            if e >= n:
                return None
            if line[e] == "`":
                k, end, at = ("TPL" if g == "tpl" else "TPLT"), True, e + 1
            else:
                k, end, at = ("TPLH" if g == "tpl" else "TPLM"), False, e + 2
                local.append(("`", False))
            s = ""
        elif s[0] == "/" and end is not True:
            r = _REGEX.match(line, begin) if end is False else None
            if not r:
                return None
            k, s, end, at = "REGEX", "", True, r.end()
        else:
            k = s
            if s in ("(", "["):
                local.append((s, last in _PAREN_WORDS or last == "ID" and len(kinds) > 1 and texts[-1] == "await" and kinds[-2] == "for"))
                brackets.append((len(kinds), s, local[-1][1] if kinds else None))
                end = False
            elif s == "{":
                local.append((s, last in _OBJECT_BEFORE))
                brackets.append((len(kinds), s, local[-1][1] if kinds else None))
                end = False
            elif s in (")", "]", "}"):
                brackets.append((len(kinds), s, None))
                if not local:
                    closers.append(_OPENS[s])
                    end = True if s == "]" else None
                else:
                    opened, flag = local.pop()
                    if opened != _OPENS[s]:
                        return None
                    end = flag if s == "}" else not flag
                    if opened_first := (not local and brackets[0][2] is None and brackets[0][0] == 0 and brackets[0][1] == opened):
                        end = None if opened_first else end
            elif s == "++" or s == "--":
                end = last in _OPERAND_ENDS if kinds else None
            else:
                end = False
        kinds.append(k)
        texts.append(s)
        last = k
    if any(o == "`" for o, _ in local):
        return None
    return kinds, texts, brackets, end, closers


_OPENS = {")": "(", "]": "[", "}": "{"}
