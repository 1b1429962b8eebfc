"""POSIX shell with the common extensions of bash."""

from __future__ import annotations

import re

from ..peg import Grammar, LexError, Token

GRAMMAR = Grammar("""
script <- nl* (item nl*)* EOF
%nl <- NEWLINE
clist <- nl* (item nl*)+
item <- and_or (';' / '&' / NEWLINE / &')' / &';;' / &';&' / &';;&' / &EOF)
and_or <- pipeline (('&&' / '||') nl* pipeline)*
pipeline <- 'time'? '!'* command (('|' / '|&') nl* command)*
command <- compound redirect* / function / simple
function <- WORD '(' ')' nl* compound redirect* / 'function' WORD ('(' ')')? nl* compound redirect*
simple <- (redirect / ASSIGN)+ (command_word (word / redirect / ASSIGN)*)? / command_word (word / redirect / ASSIGN)*
%command_word <- !reserved WORD
%word <- WORD
%reserved <- 'if' / 'then' / 'elif' / 'else' / 'fi' / 'do' / 'done' / 'case' / 'esac' / 'while' / 'until' / 'for' / 'select' / 'function' / '{' / '}' / '!' / '[['
redirect <- IO? ('<' / '>' / '>>' / '>|' / '<>' / '<&' / '>&' / '&>' / '&>>' / '<<<' / '<<' / '<<-') (WORD / ASSIGN)
compound <- '{' clist '}' / '(' clist ')' / for / case / if / loop / condition / ARITH
%loop <- ('while' / 'until') clist 'do' clist 'done'
%for <- ('for' / 'select') WORD nl* ('in' (WORD / ASSIGN)* (';' / NEWLINE) / ';')? nl* 'do' clist 'done' / 'for' ARITH ';'? nl* 'do' clist 'done'
%if <- 'if' clist 'then' clist ('elif' clist 'then' clist)* ('else' clist)? 'fi'
%case <- 'case' (WORD / ASSIGN) nl* 'in' nl* case_item* 'esac'
%case_item <- !'esac' '('? (WORD / ASSIGN) ('|' (WORD / ASSIGN))* ')' (nl* clist / nl*) ((';;' / ';&' / ';;&') nl* / &'esac')
%condition <- '[[' (!']]' (WORD / ASSIGN / '&&' / '||' / '(' / ')' / '<' / '>' / '!' / '|' / NEWLINE))+ ']]'
""")
_OP = re.compile(r"&>>|<<<|<<-|;;&|&&|\|\||;;|;&|\|&|&>|<<|>>|<&|>&|<>|>\||[;&|()<>]")
_SPACE = re.compile(r"(?:[ \t\r]|\\\r?\n)+")
_PLAIN = re.compile(r"[^\s'\"\\$`;&|()<>]+")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")


def _closed(text: str, at: int, open_: str, close: str) -> int:
    """Index behind the ``close`` that ends what begins at ``at``; quotes inside are skipped."""
    depth, n, start = 1, len(text), at
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "'":
            at = _single(text, at)
        elif c == '"':
            at = _double(text, at)
        elif c == "`":
            at = _back(text, at)
        elif c == "#" and open_ == "(" and text[at - 1] in " \t\n;":
            at = text.find("\n", at)
            if at < 0:
                break
        elif c == open_:
            depth, at = depth + 1, at + 1
        elif c == close:
            depth, at = depth - 1, at + 1
            if not depth:
                return at
        else:
            at += 1
    raise LexError(start, f"'{open_}' never closed", True)


def _bodies(text: str, at: int, end: int) -> None:
    """Parse the commands of every $(...), `...`, <(...) and >(...) between ``at`` and ``end``; those in them are parsed with them."""
    quoted = False
    while at < end:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "'" and not quoted:
            at = _single(text, at)
        elif c == '"':
            quoted, at = not quoted, at + 1
        elif c == "`":
            stop = _back(text, at)
            _parse(re.sub(r'\\([`\\$"])' if quoted else r"\\([`\\$])", r"\1", text[at + 1 : stop - 1]), at + 1)
            at = stop
        elif text.startswith("$(", at) or c in "<>" and not quoted and text.startswith("(", at + 1):
            stop = _closed(text, at + 2, "(", ")")
            if text.startswith("$((", at) and text[stop - 2 : stop] == "))":
                at += 3  # arithmetic: only the commands in it
            else:
                _parse(text[at + 2 : stop - 1], at + 2)
                at = stop
        else:
            at += 1


def _parse(body: str, at: int) -> None:
    """The commands of a substitution that begins at ``at``; LexError if they are not valid."""
    try:
        toks = tokens(body)
    except LexError as e:
        raise LexError(at + min(e.at, len(body)), e.why) from None
    if not GRAMMAR.accepts(toks):
        raise LexError(at + min(toks[GRAMMAR.furthest(toks)[0]].at, len(body)), "bad command in a substitution")


def _array(text: str, at: int, end: int) -> None:
    """The items of an array are words."""
    for t in tokens(text[at:end]):
        if t.kind not in ("WORD", "ASSIGN", "NEWLINE", "EOF"):
            raise LexError(at + t.at, "bad item of an array")


def _single(text: str, at: int) -> int:
    end = text.find("'", at + 1)
    if end < 0:
        raise LexError(at, "unterminated string", True)
    return end + 1


def _back(text: str, at: int) -> int:
    start, at = at, at + 1
    while at < len(text):
        if text[at] == "`":
            return at + 1
        at += 2 if text[at] == "\\" else 1
    raise LexError(start, "unterminated `", True)


def _double(text: str, at: int) -> int:
    start, at = at, at + 1
    while at < len(text):
        c = text[at]
        if c == '"':
            return at + 1
        if c == "\\":
            at += 2
        elif c == "`":
            at = _back(text, at)
        elif text.startswith("$(", at):
            at = _closed(text, at + 2, "(", ")")
        elif text.startswith("${", at):
            at = _closed(text, at + 2, "{", "}")
        else:
            at += 1
    raise LexError(start, "unterminated string", True)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, n, pending = 1 if text.startswith("﻿") else 0, len(text), []
    while at < n:
        if m := _SPACE.match(text, at):
            at = m.end()
            continue
        c = text[at]
        if c == "#":
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif c == "\n":
            out.append(Token("NEWLINE", "", at))
            at += 1
            for end_word, dash, began in pending:
                while True:
                    if at >= n:
                        raise LexError(began, "here-document never closed", True)
                    stop = text.find("\n", at)
                    line = text[at : n if stop < 0 else stop].rstrip("\r")
                    at = n if stop < 0 else stop + 1
                    if (line.lstrip("\t") if dash else line) == end_word:
                        break
            pending = []
        elif text.startswith("((", at) and (not out or out[-1].kind in ("NEWLINE", "OP") or out[-1].text in ("for", "if", "while", "until", "do", "then", "!", "else")):
            at0, at = at, _closed(text, at + 1, "(", ")")
            if text[at - 2 : at] != "))":  # a subshell in a subshell
                out += [Token("OP", "(", at0)]
                at = at0 + 1
            else:
                out.append(Token("ARITH", "\0", at0))
        elif (m := _OP.match(text, at)) and not (c in "<>" and text.startswith("(", at + 1)):
            out.append(Token("OP", m[0], at))
            at = m.end()
        else:
            start = checked = at
            plain = True
            while at < n:
                c = text[at]
                if m := _PLAIN.match(text, at):
                    at = m.end()
                    if text[at - 1] == "=" and text.startswith("(", at) and _ASSIGN.fullmatch(text, start, at):
                        open_, at, plain = at + 1, _closed(text, at + 1, "(", ")"), False
                        _array(text, open_, at - 1)
                        checked = at
                    continue
                plain = plain and c not in "'\"\\$`"
                if c == "'":
                    at = _single(text, at)
                elif c == '"':
                    at = _double(text, at)
                elif c == "`":
                    at = _back(text, at)
                elif c == "\\":
                    at += 2
                elif text.startswith("$((", at) or text.startswith("$(", at):
                    at = _closed(text, at + 2, "(", ")")
                elif text.startswith("${", at):
                    at = _closed(text, at + 2, "{", "}")
                elif text.startswith("$'", at):
                    m = re.compile(r"(?:[^'\\]|\\.)*'", re.S).match(text, at + 2)
                    if not m:
                        raise LexError(at, "unterminated string", True)
                    at = m.end()
                elif c == "$":
                    at += 1
                elif c in "<>" and text.startswith("(", at + 1):
                    at, plain = _closed(text, at + 2, "(", ")"), False
                else:
                    break
            at = min(at, n)
            word = text[start:at]
            if not plain:
                _bodies(text, checked, at)
            if out and out[-1].text in ("<<", "<<-"):
                pending.append((re.sub(r"['\"\\]", "", word), out[-1].text == "<<-", start))
            if at < n and text[at] in "<>" and word.isdigit():
                out.append(Token("IO", "\0", start))
            elif _ASSIGN.match(word):
                out.append(Token("ASSIGN", "\0", start))
            else:
                out.append(Token("WORD", word if plain else "\0", start))
    if pending:
        raise LexError(pending[0][2], "here-document never closed", True)
    return [*out, Token("EOF", "", n)]
