"""Parsing-expression grammars over tokens, compiled to Python functions with packrat memo tables.

Grammar text: one ``name <- expression`` a rule (a rule goes on until the next ``<-``). The results of every recursive
rule that stands in more than one place are kept in a memo table by position, so that the time of a parse is linear in
the text: a rule that stands in one place is tried at a position only once for each time the rule around it is. In
expressions:

    'x'   the token of kind x (punctuation or reserved word)     "x"   an identifier token with the text x
    NAME  a token class: one kind of token, or a set given to compile_grammar
    e1 e2   e1 / e2   e* e+ e?   &e !e   ( e )
    #name   a test or match written in Python (see ``builtins``)
"""

from __future__ import annotations

import re
from collections.abc import Callable

_TOKEN = re.compile(r"\s+|(?P<rule>[a-zA-Z_]\w*\s*<-)|(?P<lit>'[^']*')|(?P<word>\"[^\"]*\")|(?P<hash>#\w+)|(?P<name>[a-zA-Z_]\w*)|(?P<op>[/*+?&!()])|(?P<comment>;[^\n]*)")


def _read(text: str) -> tuple[dict[str, tuple], set[str]]:
    toks, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"grammar: {text[at : at + 30]!r}")
        if m.lastgroup and m.lastgroup != "comment":
            toks.append((m.lastgroup, m.group()))
        at = m.end()
    rules: dict[str, tuple] = {}
    i = 0

    def choice() -> tuple:
        nonlocal i
        alts = [seq()]
        while i < len(toks) and toks[i] == ("op", "/"):
            i += 1
            alts.append(seq())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def seq() -> tuple:
        items = []
        while i < len(toks) and toks[i][0] != "rule" and toks[i] not in (("op", "/"), ("op", ")")):
            items.append(prefixed())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefixed() -> tuple:
        nonlocal i
        if toks[i] in (("op", "&"), ("op", "!")):
            kind = "and" if toks[i][1] == "&" else "not"
            i += 1
            return (kind, prefixed())
        e = atom()
        while i < len(toks) and toks[i][0] == "op" and toks[i][1] in "*+?":
            e = ({"*": "star", "+": "plus", "?": "opt"}[toks[i][1]], e)
            i += 1
        return e

    def atom() -> tuple:
        nonlocal i
        kind, s = toks[i]
        i += 1
        if s == "(":
            e = choice()
            if toks[i] != ("op", ")"):
                raise ValueError("grammar: ) expected")
            i += 1
            return e
        if kind == "lit":
            return ("lit", s[1:-1])
        if kind == "word":
            return ("word", s[1:-1])
        if kind == "hash":
            return ("builtin", s[1:])
        return ("ref", s)

    while i < len(toks):
        name = toks[i][1][:-2].strip()
        i += 1
        rules[name] = choice()
    return rules, _recursive(rules)


def _recursive(rules: dict[str, tuple]) -> set[str]:
    """The rules that can come back to themselves and stand in more than one place."""
    places: dict[str, int] = {}

    def named(e: tuple) -> set[str]:
        kind, x = e
        if kind == "ref":
            places[x] = places.get(x, 0) + 1
            return {x} & rules.keys()
        return set() if kind in ("lit", "word", "builtin") else set().union(*map(named, x)) if kind in ("seq", "choice") else named(x)

    calls = {n: named(e) for n, e in rules.items()}
    out = set()
    for n in rules:
        seen: set[str] = set()
        todo = list(calls[n])
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += calls[m]
        if n in seen and places[n] > 1:
            out.add(n)
    return out


def compile_grammar(text: str, start: str, classes: dict[str, frozenset[str]], builtins: dict[str, str], track: bool) -> Callable:
    """A function (kinds, texts, newlines, match) -> (end or -1, furthest failure).

    ``classes`` names sets of token kinds; any other name that is no rule is a kind of token. ``builtins``: Python
    expressions for the position after a match at {i}, or -1. With ``track`` the furthest failure is kept (slower).
    """
    rules, memo = _read(text)
    nullable: dict[str, bool] = dict.fromkeys(rules, False)
    first: dict[str, set[str] | None] = {n: set() for n in rules}  # None: any

    def null(e: tuple) -> bool:
        kind, x = e
        if kind in ("star", "opt", "and", "not", "builtin"):
            return True
        if kind == "seq":
            return all(map(null, x))
        if kind == "choice":
            return any(map(null, x))
        return null(x) if kind == "plus" else kind == "ref" and nullable.get(x, False)

    def start_of(e: tuple) -> set[str] | None:
        kind, x = e
        if kind == "lit":
            return {x}
        if kind == "word":
            return {"ID"}
        if kind == "ref":
            return first[x] if x in rules else set(classes.get(x, {x}))
        if kind in ("star", "plus", "opt"):
            return start_of(x)
        if kind in ("and", "not"):
            return set()
        if kind == "builtin":
            return None
        out: set[str] = set()
        for y in x:
            s = start_of(y)
            if s is None:
                return None
            out |= s
            if kind == "seq" and not null(y):
                return out
        return out

    changed = True
    while changed:
        changed = False
        for n, e in rules.items():
            a, b = null(e), start_of(e)
            if a != nullable[n] or b != first[n]:
                nullable[n], first[n], changed = a, b, True

    lines: list[str] = []
    consts: dict[str, frozenset[str]] = {}
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"v{count}"

    def const(s: set[str] | frozenset[str]) -> str:
        for n, x in consts.items():
            if x == s:
                return n
        consts[n := f"S{len(consts)}"] = frozenset(s)
        return n

    def put(depth: int, s: str) -> None:
        lines.append(" " * depth + s)

    def fail(depth: int, i: str) -> None:
        if track:
            put(depth, f"if {i} > far: far = {i}")

    def test(e: tuple, i: str) -> str | None:
        """A condition for expressions that match one token."""
        kind, x = e
        if kind == "lit":
            return f"K[{i}] == {x!r}"
        if kind == "word":
            return f"X[{i}] == {x!r} and K[{i}] == 'ID'"
        if kind == "ref" and x not in rules:
            s = classes.get(x)
            return f"K[{i}] in {const(s)}" if s else f"K[{i}] == {x!r}"
        if kind == "choice" and all(y[0] == "lit" or y[0] == "ref" and y[1] not in rules for y in x):
            s = set().union(*[{y[1]} if y[0] == "lit" else set(classes.get(y[1], {y[1]})) for y in x])
            return f"K[{i}] in {const(s)}"
        return None

    def gen(e: tuple, i: str, out: str, d: int) -> None:
        kind, x = e
        if c := test(e, i):
            if track:
                put(d, f"if {c}: {out} = {i} + 1")
                put(d, "else:")
                put(d + 1, f"{out} = -1")
                fail(d + 1, i)
            else:
                put(d, f"{out} = {i} + 1 if {c} else -1")
        elif kind == "ref":
            f = first[x]
            if f is not None and not nullable[x]:
                if track:
                    put(d, f"if K[{i}] in {const(f)}: {out} = r_{x}({i})")
                    put(d, "else:")
                    put(d + 1, f"{out} = -1")
                    fail(d + 1, i)
                else:
                    put(d, f"{out} = r_{x}({i}) if K[{i}] in {const(f)} else -1")
            else:
                put(d, f"{out} = r_{x}({i})")
        elif kind == "builtin":
            put(d, f"{out} = {builtins[x].format(i=i)}")
            if track:
                put(d, f"if {out} < 0 and {i} > far: far = {i}")
        elif kind == "seq":
            put(d, f"{out} = -1")
            at, depth, last = i, d, len(x) - 1
            for k, y in enumerate(x):
                c = test(y, at)
                if c and not track:
                    put(depth, f"if {c}:")
                    depth += 1
                    nxt = fresh() if k < last else out
                    put(depth, f"{nxt} = {at} + 1")
                else:
                    nxt = fresh()
                    gen(y, at, nxt, depth)
                    if k < last:
                        put(depth, f"if {nxt} >= 0:")
                        depth += 1
                    else:
                        put(depth, f"{out} = {nxt}")
                at = nxt
        elif kind == "choice":
            depth = d
            put(d, f"{out} = -1")
            for k, y in enumerate(x):
                f = None if null(y) else start_of(y)
                if f is not None and test(y, i) is None and y[0] != "ref":
                    put(depth, f"if K[{i}] in {const(f)}:")
                    gen(y, i, out, depth + 1)
                    if track:
                        put(depth, "else:")
                        fail(depth + 1, i)
                else:
                    gen(y, i, out, depth)
                if k < len(x) - 1:
                    put(depth, f"if {out} < 0:")
                    depth += 1
        elif kind in ("star", "plus"):
            if kind == "plus":
                gen(x, i, out, d)
                put(d, f"if {out} >= 0:")
                d += 1
            else:
                put(d, f"{out} = {i}")
            put(d, "while True:")
            f = None if null(x) else start_of(x)
            if f is not None:
                put(d + 1, f"if K[{out}] not in {const(f)}:")
                fail(d + 2, out)
                put(d + 2, "break")
            t = fresh()
            gen(x, out, t, d + 1)
            put(d + 1, f"if {t} <= {out}: break")
            put(d + 1, f"{out} = {t}")
        elif kind == "opt":
            f = None if null(x) else start_of(x)
            put(d, f"{out} = {i}")
            if f is not None:
                put(d, f"if K[{i}] in {const(f)}:")
                t = fresh()
                gen(x, i, t, d + 1)
                put(d + 1, f"if {t} >= 0: {out} = {t}")
                if track:
                    put(d, "else:")
                    fail(d + 1, i)
            else:
                t = fresh()
                gen(x, i, t, d)
                put(d, f"if {t} >= 0: {out} = {t}")
        elif kind in ("and", "not"):
            t = fresh()
            c = test(x, i)
            if c:
                put(d, f"{out} = {i} if {'' if kind == 'and' else 'not '}({c}) else -1")
            else:
                gen(x, i, t, d)
                put(d, f"{out} = {i} if {t} {'>=' if kind == 'and' else '<'} 0 else -1")
        else:
            raise ValueError(kind)

    # Tokens and memo tables are globals of the compiled module: no functions are made, and no cycles left, by a parse.
    for n, e in rules.items():
        put(0, f"def r_{n}(i):")
        if track:
            put(1, "global far")
        if n in memo:
            put(1, f"o = m_{n}.get(i)")
            put(1, "if o is not None: return o")
        gen(e, "i", "o", 1)
        if n in memo:
            put(1, f"m_{n}[i] = o")
        put(1, "return o")
    for n in memo:
        put(0, f"m_{n} = {{}}")
    put(0, "far = 0")
    put(0, "def parse(kinds, texts, newlines, match):")
    put(1, "global K, X, N, M, far")
    put(1, "K, X, N, M, far = kinds, texts, newlines, match, 0")
    put(1, "try:")
    put(2, f"return r_{start}(0), far")
    put(1, "finally:")
    put(2, "; ".join(f"m_{n}.clear()" for n in memo) or "pass")
    scope: dict = dict(consts)
    exec(compile("\n".join(lines), f"<grammar {start}>", "exec"), scope)  # noqa: S102 - code made from the grammar above
    return scope["parse"]
