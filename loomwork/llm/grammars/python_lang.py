"""Python 3: tokens with indentation, and a grammar flattened where precedence does not matter for validity."""

from __future__ import annotations

import re
import unicodedata

from ..peg import Grammar, LexError, Token

#: Words that cannot be names (fixed values).
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
GRAMMAR = Grammar("""
file <- (NEWLINE / stmt)* EOF
stmt <- compound / simple_stmts
simple_stmts <- simple (';' simple)* ';'? NEWLINE
simple <- assignment / type_alias / star_exprs / return_stmt / import_stmt / raise_stmt / 'pass' / 'break' / 'continue'
  / ('global' / 'nonlocal') NAME (',' NAME)* / 'del' del_targets / assert_stmt / yield_expr
%return_stmt <- 'return' star_exprs?
%raise_stmt <- 'raise' (expr ('from' expr)?)?
%assert_stmt <- 'assert' expr (',' expr)?
%type_alias <- &'type' NAME NAME type_params? '=' expr
%import_stmt <- 'import' dotted_as (',' dotted_as)* / 'from' ('.' / '...')* (dotted / &'import') 'import' import_names
%dotted <- NAME ('.' NAME)*
%dotted_as <- NAME ('.' NAME)* ('as' NAME)?
%import_names <- '*' / '(' name_as (',' name_as)* ','? ')' / name_as (',' name_as)*
%name_as <- NAME ('as' NAME)?

assignment <- single_target ':' expr ('=' (yield_expr / star_exprs))? / (targets '=')+ (yield_expr / star_exprs) !'=' / single_target augassign (yield_expr / star_exprs)
%augassign <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**='
targets <- star_target (',' star_target)* ','?
%star_target <- '*'? target
target <- atom_trailers_target / NAME !trailer_start / '(' targets? ')' !trailer_start / '[' targets? ']' !trailer_start
%single_target <- atom_trailers_target / NAME / '(' single_target ')'
atom_trailers_target <- atom (trailer &trailer)* ('.' NAME / '[' slices ']')
%trailer_start <- '.' / '(' / '['
del_targets <- del_target (',' del_target)* ','?
%del_target <- atom_trailers_target / NAME / '(' del_targets? ')' / '[' del_targets? ']'

compound <- function_def / if_stmt / class_def / with_stmt / for_stmt / try_stmt / while_stmt / match_stmt
block <- NEWLINE INDENT stmt+ DEDENT / simple_stmts
%decorators <- ('@' named NEWLINE)+
function_def <- decorators? 'async'? 'def' NAME type_params? '(' params? ')' ('->' expr)? ':' block
class_def <- decorators? 'class' NAME type_params? ('(' phases? ')')? ':' block
%type_params <- '[' type_param (',' type_param)* ','? ']'
%type_param <- ('**' / '*')? NAME (':' expr)? ('=' expr)?
%params <- (front (',' star_params)? / star_params) ','?
%front <- plain (',' plain)* (',' '/' (',' plain)* (',' preset)* / (',' preset)+ (',' '/' (',' preset)*)?)? / preset (',' preset)* (',' '/' (',' preset)*)?
%plain <- NAME (':' expr)? !'='
%preset <- NAME (':' expr)? '=' expr
%star_params <- ('*' NAME (':' star_expr)? / '*' &(',' NAME)) (',' NAME (':' expr)? ('=' expr)?)* (',' rest_param)? / rest_param
%rest_param <- '**' NAME (':' expr)?
%lambda_params <- (lambda_front (',' lambda_star)? / lambda_star) ','?
%lambda_front <- lambda_plain (',' lambda_plain)* (',' '/' (',' lambda_plain)* (',' lambda_preset)* / (',' lambda_preset)+ (',' '/' (',' lambda_preset)*)?)? / lambda_preset (',' lambda_preset)* (',' '/' (',' lambda_preset)*)?
%lambda_plain <- NAME !'='
%lambda_preset <- NAME '=' expr
%lambda_star <- ('*' NAME / '*' &(',' NAME)) (',' NAME ('=' expr)?)* (',' '**' NAME)? / '**' NAME
%if_stmt <- 'if' named ':' block ('elif' named ':' block)* else_block?
%else_block <- 'else' ':' block
%while_stmt <- 'while' named ':' block else_block?
%for_stmt <- 'async'? 'for' targets 'in' star_exprs ':' block else_block?
%with_stmt <- 'async'? 'with' ('(' with_item (',' with_item)* ','? ')' ':' / with_item (',' with_item)* ':') block
%with_item <- expr ('as' star_target)?
%try_stmt <- 'try' ':' block (finally_block / except_block+ else_block? finally_block?)
%except_block <- 'except' '*'? (expr (',' expr)* ('as' NAME)?)? ':' block
%finally_block <- 'finally' ':' block
match_stmt <- &'match' NAME subject ':' NEWLINE INDENT case_block+ DEDENT
%subject <- star_expr (',' star_expr)* ','?
%case_block <- &'case' NAME patterns ('if' named)? ':' block
%patterns <- pattern (',' pattern)* ','?
%pattern <- '*' NAME / disj ('as' NAME)?

star_exprs <- star_expr (',' star_expr)* ','?
%star_expr <- '*' bitor / expr
named <- NAME ':=' expr / expr !':='
%yield_expr <- 'yield' ('from' expr / star_exprs?)
expr <- disj ('if' disj 'else' expr)? / 'lambda' lambda_params? ':' expr
disj <- inversion (('and' / 'or') inversion)*
%inversion <- 'not'* bitor (compare bitor)*
%compare <- '==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not'?
bitor <- unary (binary unary)*
%binary <- '+' / '-' / '*' / '/' / '//' / '%' / '@' / '&' / '|' / '^' / '<<' / '>>' / '**'
%unary <- ('+' / '-' / '~')* 'await'? primary
primary <- atom trailer*
trailer <- '.' NAME / '(' args? ')' / '[' slices ']'
atom <- NAME / NUMBER / (STRING / formatted)+ !BYTES / BYTES+ !(STRING / FSTART) / 'True' / 'False' / 'None' / '...' / paren / list_atom / brace
%paren <- '(' (yield_expr / named comp / star_named (',' star_named)* ','?)? ')'
%list_atom <- '[' (named comp / star_named (',' star_named)* ','?)? ']'
%star_named <- '*' bitor / named
%brace <- '{' (pair comp / named comp / pair_or (',' pair_or)* ','? / star_named (',' star_named)* ','?)? '}'
%pair <- expr ':' expr
%pair_or <- '**' bitor / pair
%comp <- ('async'? 'for' targets 'in' disj ('if' disj_or_lambda)*)+
%disj_or_lambda <- NAME ':=' expr / disj / 'lambda' lambda_params? ':' expr
%formatted <- FSTART field* FEND
field <- '{' (yield_expr / star_exprs) '='? ('!' ('r' / 's' / 'a'))? (':' field*)? '}'
args <- named comp &')' / phases
phases <- (positional (',' positional)* (',' keyword)* (',' last_keyword)* / keyword (',' keyword)* (',' last_keyword)* / last_keyword (',' last_keyword)*) ','?
%positional <- '*' expr / !(NAME '=') named
%keyword <- NAME '=' expr / '*' expr
%last_keyword <- NAME '=' expr / '**' expr
slices <- slice (',' slice)* ','?
%slice <- expr? ':' expr? (':' expr?)? / '*' bitor / named
""")
_OPS = r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=]"
_TOKEN = re.compile(
    r"""(?x)
      (?P<space>[ \t\f]+ | \\\r?\n | \#[^\r\n]*)
    | (?P<NL>\r\n|\n|\r)
    | (?P<str>(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:'''|\"\"\"|'|\"))
    | (?P<NAME>[^\W\d]\w*)
    | (?P<NUMBER>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+
        |(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))
    | (?P<OP>"""
    + _OPS
    + ")"
)
_BODY = {
    "'": re.compile(r"(?:[^'\\\r\n]|\\(?:\r\n|.|\n))*'", re.S),
    '"': re.compile(r'(?:[^"\\\r\n]|\\(?:\r\n|.|\n))*"', re.S),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.S),
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.S),
}
_INDENT = re.compile(r"[ \t\f]*")
_PAIRS = {")": "(", "]": "[", "}": "{"}


_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{(?P<name>[^}]+)\}|[\s\S])")
#: What stands in the brackets that are open for a field of a formatted string, and for one within a field's format.
FIELD, NESTED = "field", "nested"


def _part(quote: str, escapes: bool) -> re.Pattern:
    """What goes on to the next field or the end of a formatted string; without escapes, of a field's format."""
    q, lines = quote[0], "" if len(quote) == 3 else r"\r\n"
    inner = rf"|{q}(?!{q}{q})" if len(quote) == 3 else ""
    if not escapes:
        return re.compile(rf"(?:[^{q}{{}}{lines}]{inner})*")
    return re.compile(rf"(?:[^{q}\\{{}}{lines}]|\\N\{{[^}}'\"]+\}}|\\(?:\r\n|[^{{}}])|\\(?=[{{}}])|\{{\{{|\}}\}}{inner})*")


_LITERAL = {q: _part(q, True) for q in _BODY}
_FORMAT = {q: _part(q, False) for q in _BODY}


def _check_escapes(text: str, start: int, end: int, is_bytes: bool) -> None:
    """Raises where a literal has an escape that is cut short or names no character."""
    for m in _ESCAPE.finditer(text, start, end):
        kind = m[0][1]
        if is_bytes and kind in "uUN":
            continue
        if kind in "xuUN" and len(m[0]) == 2:
            raise LexError(m.start(), "bad escape")
        if m["name"]:
            try:
                unicodedata.lookup(m["name"])
            except KeyError:
                raise LexError(m.start(), "unknown character name") from None


def _literal(text: str, at: int, inside: list, open_: list, out: list[Token]) -> int:
    """Goes over a literal part of the innermost formatted string, into its next field or past its end."""
    quote, raw, start = inside[-1]
    m = _LITERAL[quote].match(text, at)
    at = m.end()
    if not raw and "\\" in m[0]:
        _check_escapes(text, m.start(), at, False)
    if text.startswith(quote, at):
        out.append(Token("FEND", "", at))
        inside.pop()
        return at + len(quote)
    if text.startswith("{", at):
        return _field(FIELD, at, open_, out)
    raise LexError(at if text.startswith("}", at) else start, "single '}'" if text.startswith("}", at) else "unterminated string", at >= len(text))


def _format(text: str, at: int, inside: list, open_: list, out: list[Token]) -> int:
    """Goes over the format of a field, into a field within it or past the end of the field it belongs to."""
    quote, _, start = inside[-1]
    at = _FORMAT[quote].match(text, at).end()
    if text.startswith("{", at):
        return _field(NESTED, at, open_, out)
    if not text.startswith("}", at):
        raise LexError(start, "field without its end", at >= len(text))
    out.append(Token("OP", "}", at))
    return (_literal if open_.pop()[0] == FIELD else _format)(text, at + 1, inside, open_, out)


def _field(kind: str, at: int, open_: list, out: list[Token]) -> int:
    out.append(Token("OP", "{", at))
    open_.append((kind, at))
    return at + 1


def tokens(text: str) -> list[Token]:
    """Formatted strings become FSTART, the tokens of their fields in braces, and FEND; literal parts give no tokens."""
    out: list[Token] = []
    inside: list[tuple[str, bool, int]] = []  # open formatted strings: quote, raw, place
    at, indents, open_, fresh, n = 1 if text.startswith("﻿") else 0, [0], [], True, len(text)
    if "\0" in text:
        raise LexError(text.index("\0"), "null character")
    while at < n:
        if fresh and not open_:
            m = _INDENT.match(text, at)
            at = m.end()
            if at < n and text[at] not in "\r\n#" and not (text[at] == "\\" and text[at + 1 : at + 2] in ("\r", "\n")):
                width = len(m[0].rpartition("\f")[2].expandtabs(8))
                if width > indents[-1]:
                    indents.append(width)
                    out.append(Token("INDENT", "", at))
                while width < indents[-1]:
                    indents.pop()
                    out.append(Token("DEDENT", "", at))
                if width != indents[-1]:
                    raise LexError(at, "indentation that fits no block")
            fresh = False
            continue
        if open_ and open_[-1][0] in (FIELD, NESTED) and text[at] in ":!}" and not text.startswith("!=", at):
            out.append(Token("OP", text[at], at))
            at += 1
            if text[at - 1] == ":":
                at = _format(text, at, inside, open_, out)
            elif text[at - 1] == "}":
                at = (_literal if open_.pop()[0] == FIELD else _format)(text, at, inside, open_, out)
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise LexError(at, "bad character")
        kind, t = m.lastgroup, m[0]
        if kind == "NL":
            if not open_:
                if out and out[-1].kind not in ("NEWLINE", "INDENT", "DEDENT"):
                    out.append(Token("NEWLINE", "", at))
                fresh = True
        elif kind == "str":
            quote, marks = t.lstrip("rRbBfFuU"), t.rstrip("\"'").lower()
            if "f" in marks:
                out.append(Token("FSTART", "", at))
                inside.append((quote, "r" in marks, at))
                at = _literal(text, m.end(), inside, open_, out)
                continue
            body = _BODY[quote].match(text, m.end())
            if not body:
                raise LexError(at, "unterminated string", True)
            if "b" in marks and not body[0].isascii():
                raise LexError(at, "bytes that are not ASCII")
            if "r" not in marks and "\\" in body[0]:
                _check_escapes(text, body.start(), body.end(), "b" in marks)
            out.append(Token("BYTES" if "b" in marks else "STRING", "", at))
            at = body.end()
            continue
        elif kind == "NAME":
            out.append(Token("KEY" if t in KEYWORDS else "NAME", t, at))
        elif kind == "NUMBER":
            if m.end() < n and (text[m.end()].isalnum() or text[m.end()] == "_") and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", text[m.end() :]):
                raise LexError(at, "bad number")
            if re.fullmatch(r"0[0-9_]*[1-9][0-9_]*", t):
                raise LexError(at, "leading zeros in a number")
            out.append(Token("NUMBER", "", at))
        elif kind == "OP":
            if t in "([{":
                open_.append((t, at))
            elif t in ")]}":
                if not open_ or open_[-1][0] != _PAIRS[t]:
                    raise LexError(at, "closing bracket without its opening one")
                open_.pop()
            out.append(Token("OP", t, at))
        at = m.end()
    if open_:
        raise LexError(open_[-1][1], "bracket never closed", True)
    if out and out[-1].kind not in ("NEWLINE", "INDENT", "DEDENT"):
        out.append(Token("NEWLINE", "", n))
    out += [Token("DEDENT", "", n)] * (len(indents) - 1)
    return [*out, Token("EOF", "", n)]
