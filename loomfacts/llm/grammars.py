"""Grammars of Go, JavaScript, TypeScript, JSX and TSX over the tokens of ``lexers``."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from .lexers import JS_WORDS
from .peg import compile_grammar

GO = """
file <- 'package' ID ';' (import ';')* (top (';' / &EOF))* EOF
import <- 'import' (importspec / '(' (importspec sm)* ')')
importspec <- ('.' / ID)? STR
sm <- ';' / &')' / &'}'
top <- const / typedecl / var / func / ';'
const <- 'const' (constspec / '(' (constspec sm)* ')')
constspec <- idlist (type? '=' exprs)?
typedecl <- 'type' (typespec / '(' (typespec sm)* ')')
typespec <- ID tparams? '='? type
var <- 'var' (varspec / '(' (varspec sm)* ')')
varspec <- idlist (type ('=' exprs)? / '=' exprs)
func <- 'func' params? ID tparams? signature block?
tparams <- '[' tparam (',' tparam)* ','? ']'
tparam <- idlist union
idlist <- ID (',' ID)*
signature <- params result?
result <- params / type
params <- '(' (param (',' param)* ','?)? ')'
param <- ID '...'? type / '...' type / type
type <- '*' type / '(' type ')' / typelit / name ('[' types ']')?
typelit <- '[' ']' type / '[' '...' ']' type / '[' expr ']' type / 'map' '[' type ']' type / chan / 'func' signature / struct / interface
chan <- '<-' 'chan' type / 'chan' '<-'? type
name <- ID ('.' ID)?
types <- type (',' type)* ','?
struct <- 'struct' '{' (field sm)* '}'
field <- idlist type STR? / '*'? name ('[' types ']')? STR?
interface <- 'interface' '{' (element sm)* '}'
element <- ID signature / union
union <- '~'? type ('|' '~'? type)*
block <- '{' stmts '}'
stmts <- (';' / stmt (';' / &'}' / &'case' / &'default'))*
stmt <- const / typedecl / var / 'go' expr / 'defer' expr / 'return' exprs? / 'break' ID? / 'continue' ID? / 'goto' ID / 'fallthrough' / block / if / switch / select / for / ID ':' !'=' stmt? / simple
simple <- exprs (('++' / '--') / ASSIGN exprs / '<-' expr)?
if <- 'if' (simplen? ';')? exprn block ('else' (if / block))?
switch <- 'switch' (simplen? ';')? simplen? '{' clause* '}'
clause <- ('case' exprs / 'default') ':' stmts
select <- 'select' '{' (('case' simple / 'default') ':' stmts)* '}'
for <- 'for' (block / range block / simplen? ';' exprn? ';' simplen? block / exprn block)
range <- (exprsn (':=' / '='))? 'range' exprn
simplen <- exprsn (('++' / '--') / ASSIGN exprsn / '<-' exprn)?
exprs <- expr (',' expr)*
exprsn <- exprn (',' exprn)*
expr <- unary (BINARY unary)*
unary <- UNARY* operand post*
exprn <- unaryn (BINARY unaryn)*
unaryn <- UNARY* operandn post*
operand <- NUM / STR / name ('[' types ']')? literal / ID / 'func' signature block / typelit literal? / '(' expr ')'
operandn <- NUM / STR / ID / 'func' signature block / typelit literal? / '(' expr ')'
post <- '.' ID / '.' '(' ('type' / type) ')' / '[' index ']' / '(' args ')'
index <- slice / expr (',' expr)* ','?
slice <- expr? ':' (expr (':' expr)?)?
args <- (expr (',' expr)* '...'? ','?)?
literal <- '{' (item (',' item)* ','?)? '}'
item <- value (':' value)?
value <- literal / expr
"""

GO_CLASSES = {
    "ASSIGN": frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split()),
    "BINARY": frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split()),
    "UNARY": frozenset("+ - ! ^ * & <- ~".split()),
}

_JS = """
file <- entry* EOF
entry <- import / export / stmt
import <- 'import' (STR / importwhat "from" STR) with? SEMI
with <- ('with' / "assert") object
importwhat <- ID (',' (star / names))? / star / names
star <- '*' "as" ID
names <- '{' (spec (',' spec)* ','?)? '}'
spec <- SPECMOD (WORD / STR) ("as" (WORD / STR))?
export <- 'export' ('*' ("as" (WORD / STR))? "from" STR with? SEMI / names ("from" STR with?)? SEMI / 'default' exported / EXPORTMORE lexical / function / class / 'import' 'import')
exported <- function / class / EXPORTED assign SEMI
stmt <- block / var / 'if' '(' expr ')' stmt ('else' stmt)? / for / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'? / switch / try
  / 'return' (NONL expr)? SEMI / 'throw' NONL expr SEMI / ('break' / 'continue') (NONL ID)? SEMI / ';' / 'debugger' SEMI / 'with' '(' expr ')' stmt
  / function / class / STMTMORE ID ':' stmt / !'{' !'function' !'class' expr SEMI
block <- '{' stmt* '}'
lexical <- var / 'const' bindings SEMI
var <- ('var' / 'const' / "let" &LETS) bindings SEMI
bindings <- declared (',' declared)*
declared <- binding ANN ('=' assign)?
binding <- ID / BINDMORE'[' ','* (element (',' ','* / &']'))* ']' / '{' (property (',' property)*)? ','? '}'
element <- '...'? binding ('=' assign)?
property <- '...' binding / key ':' binding ('=' assign)? / ID ('=' assign)?
for <- 'for' "await"? '(' (('var' / 'const' / "let" &LETS) binding ANN ("of" assign / 'in' expr) / FORMORE lhs ("of" assign / 'in' expr) / (var_no_semi / expr)? ';' expr? ';' expr?) ')' stmt
var_no_semi <- ('var' / 'const' / "let" &LETS) bindings
switch <- 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' stmt*)* '}'
try <- 'try' block ('catch' ('(' binding ANN ')')? block ('finally' block)? / 'finally' block)
function <- ("async" NONL)? 'function' '*'? ID? TPARAMS params RETURNS BODY
params <- '(' (param (',' param)* ','?)? ')'
param <- PARAMMOD '...'? binding OPTION ANN ('=' assign)?
class <- decorator* CLASSMOD 'class' (!CLASSHEAD ID)? TPARAMS ('extends' lhs TARGS)? IMPLEMENTS '{' member* '}'
decorator <- '@' ('(' expr ')' / ID ('.' WORD)* ('(' args ')')?)
member <- ';' / "static" block / decorator* (MEMBERMOD !MEMBEREND)* '*'? (MEMBERMORE key (OPTION TPARAMS params RETURNS BODY / FIELDMARK ANN ('=' assign)? SEMI))
key <- WORD / STR / NUM / PRIV / '[' assign ']'
object <- '{' (entryof (',' entryof)* ','?)? '}'
entryof <- '...' assign / key ':' assign / (OBJECTMOD !OBJECTEND)* '*'? key TPARAMS params RETURNS body / ID ('=' assign)?
body <- '{' stmt* '}'
expr <- assign (',' assign)*
assign <- arrow / "yield" !YIELDEND NONL '*'? assign / cond (ASSIGN assign)?
arrow <- ("async" NONL)? (ID NONL '=>' / ARROWHEAD TPARAMS params RETURNS NONL '=>') (body / assign) / "async" NONL ID NONL '=>' (body / assign)
cond <- binary ('?' assign ':' assign)?
binary <- unary (BINOP unary / CAST)*
unary <- (UNARY / "await" &OPERAND / ASSERTION)* postfix
postfix <- lhs (NONL ('++' / '--'))?
lhs <- ('new' !'.')* (primary / 'new' '.' ID) tail*
tail <- '.' (WORD / PRIV) / '?.' ('(' args ')' / '[' expr ']' / template / WORD / PRIV) / '[' expr ']' / '(' args ')' / template TAILMORE
args <- (arg (',' arg)* ','?)?
arg <- '...'? assign
primary <- ("async" NONL)? 'function' '*'? ID? TPARAMS params RETURNS body / ID / 'this' / 'super' / 'null' / 'true' / 'false' / NUM / STR / REGEX / PRIV &'in' / '(' expr ')' / array / object / decorator* classexpr / template / 'import' &IMPORTTAIL / 'new' '.' ID PRIMARYMORE
classexpr <- 'class' (!CLASSHEAD ID)? TPARAMS ('extends' lhs TARGS)? IMPLEMENTS '{' member* '}'
array <- '[' ','* (arg (',' ','* / &']'))* ']'
template <- TPL / TPLH expr (TPLM expr)* TPLT
"""

#: What the common part leaves open, without types.
_PLAIN = {
    "ANN": "", "TPARAMS": "", "TARGS": "", "RETURNS": "", "BODY": "body", "OPTION": "", "FIELDMARK": "", "IMPLEMENTS": "", "CLASSMOD": "", "PARAMMOD": "", "SPECMOD": "",
    "EXPORTMORE": "", "EXPORTED": "", "STMTMORE": "", "FORMORE": "", "MEMBERMORE": "", "BINDMORE": "", "CAST": None, "ASSERTION": None, "TAILMORE": "", "PRIMARYMORE": "",
    "MEMBERMOD": '("static" / "async" / "get" / "set" / "accessor")', "ARROWHEAD": "#arrow",
}

_TYPED = {
    "ANN": "('!'? ':' type)?", "TPARAMS": "tparams?", "TARGS": "targs?", "RETURNS": "(':' returned)?", "BODY": "(body / SEMI)", "OPTION": "'?'?", "FIELDMARK": "('?' / '!')?", "IMPLEMENTS": '("implements" types)?',
    "CLASSMOD": '("abstract" / "declare")*', "PARAMMOD": 'decorator* (("public" / "private" / "protected" / "readonly" / "override") &MODNEXT)*', "SPECMOD": '("type" !"as" !\',\' !\'}\')?',
    "EXPORTMORE": "tsdecl / '=' expr SEMI / \"as\" \"namespace\" ID SEMI / \"type\" (names / '*' (\"as\" ID)?) (\"from\" STR)? SEMI / ", "EXPORTED": "tsinterface / ", "STMTMORE": "tsdecl / ", "FORMORE": "", "TAILMORE": "/ NONL '!' / targs &('(' / TPL / TPLH)", "PRIMARYMORE": "",
    "MEMBERMORE": "'[' ID ':' type ']' ':' type #semi / ", "BINDMORE": "'this' / ", "CAST": "NONL (\"as\" / \"satisfies\") ('const' / type)", "ASSERTION": None, "ARROWHEAD": "#arrow",
    "MEMBERMOD": '("static" / "async" / "get" / "set" / "accessor" / "public" / "private" / "protected" / "readonly" / "abstract" / "declare" / "override")',
}

_TYPES = """
tsdecl <- tsinterface / "type" NONL ID tparams? '=' type SEMI / enum / 'const' enum / ("namespace" / "module") NONL (ID ('.' ID)* / STR) (tsblock / SEMI) / "declare" NONL ("global" tsblock / tsdecl / function / class / var) / "abstract" NONL class / 'import' "type"? ID '=' ("require" '(' STR ')' / ID ('.' ID)*) SEMI / 'import' "type" importwhat "from" STR with? SEMI
tsblock <- '{' entry* '}'
tsinterface <- "interface" NONL ID tparams? ('extends' types)? members
enum <- 'enum' ID '{' ((WORD / STR / '[' assign ']') ('=' assign)? (',' / &'}'))* '}'
types <- type (',' type)*
tparams <- '<' tparam (',' tparam)* ','? '>'
tparam <- ('const' / 'in' / "out")* ID ('extends' type)? ('=' type)?
targs <- '<' type (',' type)* '>'
members <- '{' (tmember (';' / ',' / &'}' / NEWLINE))* '}'
tmember <- (("readonly" / "get" / "set" / "static") &KEYNEXT)* ('-' / '+')? (("readonly") &KEYNEXT)? ('[' ID ':' type ']' ':' type / '[' ID 'in' type ("as" type)? ']' (('-' / '+')? '?')? (':' type)? / ('new')? tparams? params (':' returned)? / key '?'? (tparams? params (':' returned)? / (':' type)?))
returned <- "asserts" (ID / 'this') ("is" type)? / (ID / 'this') "is" type / type
type <- functype / union ('extends' union '?' type ':' type)?
functype <- ("abstract"? 'new')? &#functype tparams? params '=>' returned
union <- '|'? inter ('|' inter)*
inter <- '&'? operator ('&' operator)*
operator <- (("keyof" / "unique" / "readonly" / "infer") &TYPENEXT)* tprimary (NONL '[' type? ']')*
tprimary <- members / tuple / '(' type ')' / STR / NUM / '-' NUM / TPL / TPLH type (TPLM type)* TPLT / 'true' / 'false' / 'null' / 'void' / 'this' / 'typeof' ('import' '(' STR ')' / ID / 'this') ('.' WORD)* targs? / 'import' '(' STR ')' ('.' WORD)* targs? / ID ('.' WORD)* (NONL targs)?
tuple <- '[' (titem (',' titem)* ','?)? ']'
titem <- '...'? (ID '?'? ':' type / type '?'?)
"""

_JSX = """
jsx <- 'J<' (JID (('.' / ':') JID)* JSXARGS attribute*)? ('J/>' / 'J>' (JTXT / jsxhole / jsx)* 'J</' (JID (('.' / ':') JID)*)? 'J>')
attribute <- JID (':' JID)? ('=' (STR / '{' expr '}' / jsx))? / '{' '...' expr '}'
jsxhole <- '{' ('...'? expr)? '}'
"""

_WORDS = frozenset(JS_WORDS | {"ID"})
JS_CLASSES = {
    "WORD": _WORDS,
    "ASSIGN": frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()),
    "UNARY": frozenset("! ~ + - ++ -- typeof void delete".split()),
    "LETS": frozenset(["ID", "[", "{"]),
    "MEMBEREND": frozenset("( = ; : ? ! } <".split()),
    "OBJECTEND": frozenset("( : , } = <".split()),
    "YIELDEND": frozenset(") ] } , ; : = EOF . ?".split()),
    "OPERAND": frozenset(_WORDS - {"in", "instanceof"} | set("NUM STR TPL TPLH REGEX ( [ { + - ! ~ J<".split())),
    "KEYNEXT": frozenset(_WORDS | {"STR", "NUM", "[", "PRIV"}),
    "MODNEXT": frozenset(["ID", "[", "{", "this"]),
    "TYPENEXT": frozenset(_WORDS | {"STR", "NUM", "[", "{", "(", "TPL", "TPLH"}),
    "IMPORTTAIL": frozenset(["(", "."]),
}

_GT = "'>' ('=' / '>' ('=' &#never / '>' ('=' &#never)?)?)?"


def _js_text(typed: bool, jsx: bool) -> str:
    fill = dict(_TYPED if typed else _PLAIN)
    fill["ASSERTION"] = "'<' type '>'" if typed and not jsx else None
    text = _JS
    if jsx:
        text = text.replace("PRIMARYMORE", " / jsx PRIMARYMORE") + _JSX.replace("JSXARGS", "targs?" if typed else "")
    for k, v in fill.items():
        text = text.replace(f" / {k}", "" if v is None else f" / {v}").replace(k, v or "")
    binop = "('**' / '*' / '/' / '%' / '+' / '-' / '<<' / '<=' / '<' / '==' / '!=' / '===' / '!==' / '&&' / '||' / '??' / '&' / '|' / '^' / 'instanceof' / 'in' / #greater)"
    text = text.replace("BINOP", binop).replace("OBJECTMOD", '("async" / "get" / "set")').replace("CLASSHEAD", '"implements" &(ID) ' if typed else "#never")
    text = text.replace("SEMI", "#semi").replace("NONL", "#nonl").replace("NEWLINE", "#newline")
    if typed:
        text += _TYPES.replace("SEMI", "#semi").replace("NONL", "#nonl").replace("NEWLINE", "#newline")
    # ``>``, ``>=``, ``>>`` and so on are single ``>`` tokens, since type arguments may end with several.
    text = text.replace("cond (ASSIGN assign)?", "cond ((ASSIGN / '>' '>' '>'? '=') assign)?")
    return text


_BUILTINS = {
    "semi": "({i} + 1 if K[{i}] == ';' else {i} if {i} in N or K[{i}] == '}}' or K[{i}] == 'EOF' else -1)",
    "nonl": "({i} if {i} not in N else -1)",
    "newline": "({i} if {i} in N else -1)",
    "never": "-1",
    # An arrow function's parameters: the partner of the parenthesis is followed by => or, with types, by a colon.
    "arrow": "({i} if K[{i}] == '<' or (K[{i}] == '(' and {i} in M and K[M[{i}] + 1] in ('=>', ':')) else -1)",
    "functype": "({i} if K[{i}] == '<' or (K[{i}] == '(' and {i} in M and K[M[{i}] + 1] == '=>') else -1)",
    # > >= >> >>> as binary operators; with = after >> or >>> it is an assignment.
    "greater": "({i} + (1 if K[{i} + 1] not in ('>', '=') else 2 if K[{i} + 1] == '=' else (2 if K[{i} + 2] not in ('>', '=') else -1 - {i} if K[{i} + 2] == '=' else 3 if K[{i} + 3] != '=' else -1 - {i})) if K[{i}] == '>' else -1)",
}


@cache
def parser(language: str, track: bool) -> Callable:
    """The compiled parser of a language; with ``track`` it reports the furthest failure."""
    if language == "go":
        return compile_grammar(GO, "file", GO_CLASSES, {}, track)
    typed, jsx = language in ("typescript", "tsx"), language in ("tsx", "jsx")
    return compile_grammar(_js_text(typed, jsx), "file", JS_CLASSES, _BUILTINS, track)
