"""Credentials embedded in source code: find them, and mask them without breaking the code.

A text is scanned by literal and context rules. Literals that hold base64, hex,
percent or backslash escapes are decoded, layer by layer until nothing decodes,
inflated where they are compressed, and scanned again; a find in a decoded layer
marks the whole enclosing literal. Decoded bytes are also parsed as key
containers by their binary grammar (p1_containers).

Null and empty texts have no finds. Every text is scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import functools
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .p1_containers import key_container

#: Inflated bytes are scanned in pieces of this size that overlap by the second, so that their memory is bounded.
PIECE_BYTES, OVERLAP = 16_000_000, 1_000_000


class Find(NamedTuple):
    start: int
    end: int
    kind: str
    layers: int


# --- fixed values: name parts that mean a secret, and those that take it back ---
SECRET_NAME = (
    r"pass(?:word|wd|phrase|code)?|passw|pwd|pw|secret(?:[._-]?key)?|token|tok|auth(?:orization)?|cred(?:ential)?s?"
    r"|api[._-]?key|apikey|access[._-]?key|account[._-]?key|shared[._-]?key|sign(?:ing|ature)?[._-]?key"
    r"|private[._-]?key|secret[._-]?access[._-]?key|client[._-]?secret|encryption[._-]?key|master[._-]?key"
    r"|hmac(?:[._-]?(?:seed|key))?|salt|sig|login|seed|key[._-]?text|bearer"
    r"|密码|口令|密钥|令牌"
)
#: A name that ends (but for a number) in one of these names a secret.
NAME_END = re.compile(rf"(?i)(?:^|[^A-Za-z]|(?<=[a-z])(?=[A-Z]))(?:{SECRET_NAME})(?:[._-]?\d+)?$")
CAMEL_END = re.compile(
    r"(?:[a-z0-9](?:Pass(?:word|wd|phrase)?|Pwd|Secret|Token|Key|Cred(?:ential)?s?|Auth)|^(?:accessToken|sharedKey|apiKey|secretKey|accountKey|privateKey|clientSecret|authToken))$"
)
#: Camel-case names that end in Key are keys of rows as often as secrets; only these stems count.
KEY_STEM = re.compile(r"(?i)(?:access|shared|api|secret|account|private|sign|signing|auth|client|encryption|master|storage)[._-]?key\d*$")
SOFT_NAME = re.compile(r"(?i)(?:auth|tok|token|cred|creds|credential|credentials|login|sig|salt|seed|key[._-]?text|pw)\d*$")
#: A line end or tab written as an escape, as in a script within a JSON text: what follows begins anew.
WRITTEN = r"(?<=\\[nrt])"
PLACEHOLDER = re.compile(
    r"(?ix)^(?: [x*.#?_\-•]+ | <[^>]*> | \[[^\]]*\] | \{\{.*\}\} | \$\{[^}]*\} | \$\([^)]*\) | \$[A-Za-z_]\w* | %\([^)]*\)s | %[A-Za-z_]+% | \{\w*\}"
    r" | @[A-Za-z_.]+@ | :\w+ | (?:your|my|the|some|any|enter|insert|change|replace|put|todo|fixme)[ _-]?.* | change[_-]?me | example.* | sample.* | dummy.* | placeholder.*"
    r" | none | null | nil | true | false | undefined | n/?a | tbd | redacted | masked | hidden | removed | secret | password | passwd | pwd | pass | token"
    r" | (?:pass(?:word)?|token|secret|key)[_-]?(?:here|placeholder|value) | not[_-]?set | unset | empty | default | ENC\(.*\) | vault:.* | env:.* | file:.* | secretsmanager:.* | arn:.* )$"
)
TOKEN = re.compile(
    rf"""(?x)(?:(?<![A-Za-z0-9_])|{WRITTEN})(?:
      gh[pousr]_[A-Za-z0-9]{{30,}} | github_pat_[A-Za-z0-9_]{{40,}} | gl(?:pat|dt|rt|soat|cbt|ptt)-[A-Za-z0-9_\-]{{16,}}
    | xox[abeoprs]-[A-Za-z0-9\-]{{12,}} | xapp-[A-Za-z0-9\-]{{16,}} | dapi[0-9a-f]{{30,}}(?:-\d)? | dop_v1_[0-9a-f]{{60,}} | dkea[0-9a-f]{{30,}}
    | AKIA[0-9A-Z]{{16}} | ASIA[0-9A-Z]{{16}} | AIza[A-Za-z0-9_\-]{{35}} | ya29\.[A-Za-z0-9_\-]{{20,}} | [sr]k_(?:live|test)_[A-Za-z0-9]{{16,}}
    | sk-(?:[a-z]+-)?[A-Za-z0-9_\-]{{20,}} | npm_[A-Za-z0-9]{{30,}} | pypi-[A-Za-z0-9_\-]{{40,}} | hf_[A-Za-z0-9]{{30,}} | SG\.[A-Za-z0-9_\-]{{16,}}\.[A-Za-z0-9_\-]{{16,}}
    | shp(?:at|ca|pa|ss)_[0-9a-fA-F]{{32}} | hvs\.[A-Za-z0-9_\-]{{20,}} | eyJ[A-Za-z0-9_\-]{{8,}}\.eyJ[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}}
    )"""
)
KEY_OPEN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|PuTTY-User-Key-File-\d")
KEY_CLOSE = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|Private-MAC:[ \t]*[0-9a-f]*")
URL_LOGIN = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://[^\s/:@'\"<>]*:([^\s/@'\"<>]+)@[\w\[]")
URL_ARG = re.compile(rf"(?i)[?&;](?:[\w.\-]*[._\-])?(?:{SECRET_NAME})=([^&;\s'\"<>]+)")
PAIR_IN_TEXT = re.compile(
    rf"(?i)(?:(?<![A-Za-z0-9])|{WRITTEN})(AccountKey|SharedAccessKey|SharedSecret|Password|Pwd|SharedAccessSignature|secret|token|aws_secret_access_key|secret_key|secret_access_key|access_key)=([^;&\s'\",)]+)"
)
HEADER = re.compile(
    r"(?i)\b(?:(?:proxy-)?authorization['\"]?\s*[:=,]\s*['\"]?\s*(?:bearer|token|basic)\s+|(?<=['\"])(?:bearer|basic)\s+|x-[a-z\-]*(?:key|token|auth|secret)['\"]?\s*[:=]\s*['\"]?)([A-Za-z0-9+/=_.\-~]{6,})"
)
FLAG = re.compile(
    r"""(?x)(?:
      (?:^|[\s"'`;|&(]) -u [ ]? ["']? [\w.@\-]+ : (?P<a>[^\s"'@/]+) ["']? (?=\s)
    | (?:\b|(?<=\\[nrt]))(?:mysql|mysqldump|mysqladmin|beeline|impala-shell|sshpass|mongo|sqoop|psql|hive|redis-cli)\b [^\n|;]*? \s (?:-p [ ]? | -w [ ]+ | -a [ ]+)
        (?: \\?"(?P<b>[^"\\\n]+)\\?" | \\?'(?P<c>[^'\\\n]+)\\?' | (?P<d>[^\s"'\\\-][^\s"'\\]*) )
    | --(?:password|passwd|pass|token|secret|api-key|apikey|access-key|secret-key|auth-token)(?:=|\s+) ["']? (?P<e>[^\s"']+)
    )"""
)
#: name, separator, literal: quoted, or bare to the end of the line
NAME = r"[A-Za-z_一-鿿$][\w.$\-一-鿿]*"
ASSIGN = re.compile(
    rf"""(?x)(?P<name>{NAME})(?P<nq>\\?["'`]?\]?) [ \t]* (?P<sep>:=|=>|==?|:|：) [ \t]*
    (?: [bBrRuU]{{0,2}}\\?"(?P<dq>[^"\\\n]*(?:\\.[^"\\\n]*)*?)\\?" | [bBrRuU]{{0,2}}'(?P<sq>[^'\\\n]*(?:\\.[^'\\\n]*)*)' | (?P<bare>[^\s"'].*)$ )""",
    re.M,
)
#: "name", "value" as arguments or items; SQL: name 'value', SET PASSWORD = 'value', IDENTIFIED BY 'value'
ARGS = re.compile(
    rf"""(?x)(?P<q1>\\?["'])(?P<name>[\w.$\-一-鿿]+)(?P=q1) [ \t]* , [ \t]* (?P<q2>\\?["'])(?P<value>[^"'\n]*?)(?P=q2)"""
)
SQL_VALUE = re.compile(
    r"(?i)\b(?:identified[ \t\r\n]+by(?:[ \t\r\n]+password)?|(?:with[ \t\r\n]+)?(?:encrypted[ \t\r\n]+)?password|secret|token|api_key|access_key|secret_key|secret_access_key)[ \t\r\n]*(?:=[ \t\r\n]*)?'((?:[^'\n]|'')*)'"
)
CREDENTIALS = re.compile(r"(?i)\bcredentials[ \t\r\n]*=?[ \t\r\n]*\(?[ \t\r\n]*'([^'\n]*)'")
INSERT = re.compile(r"(?is)\binsert\s+(?:into|overwrite)\s+(?:table\s+)?[\w.`\"]+\s*\(([^()]*)\)\s*values\s*")
SETTING = re.compile(r"(?im)^[ \t]*set[ \t]+([\w.\-:]+)[ \t]*=[ \t]*([^;\n]+)")
COMMENT_LINE = re.compile(r"(?:--|#|//)[^\n]*|/\*[\s\S]*?\*/|<!--[\s\S]*?-->")
COMMENT_CUE = re.compile(
    r"(?i)\b(?:log[- ]?in|account|acct|password|passwd|pwd|credential|creds|token|secret|api[ _-]?key|access key|rotat\w*|passphrase)\b|口令|密码|密钥|令牌|账号"
)
JOINED = re.compile(
    r"""(?x)^[ \t]*(?P<name>[A-Za-z_]\w*)[ \t]*=[ \t]*\(?[ \t\r\n]*(?P<lits>(?:[bru]?(?:"[^"\n]*"|'[^'\n]*')[ \t]*\+?[ \t]*\\?[ \t]*(?:\r?\n[ \t]*)?)+)\)?""",
    re.M,
)
ALIAS = re.compile(r"(?m)^[ \t]*(?P<name>[\w.]+)[ \t]*=[ \t]*(?P<src>[A-Za-z_]\w*)[ \t]*(?:#.*)?\r?$")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/=_\-])(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9_\-]{16,}={0,2})(?![A-Za-z0-9+/=])")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){10,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){10,}(?![0-9A-Za-z])")
#: Hexadecimal digits of a literal, in any case, also after 0x.
HEX_RUN = re.compile(r"(?:0[xX])?((?:[0-9A-Fa-f]{2}){10,})")
#: First bytes of compressed data (gzip, zlib).
DEFLATED = (b"\x1f\x8b\x08", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
#: What parts the lines or pieces of one encoded literal: line ends (also written as \\n), indentation, quotes, plus signs, backslashes.
GAP = r"""(?x:
      (?:(?:\\r)?\\n)? \\?["'] [ \t]* \+? [ \t]* (?: \\? [ \t]* \r?\n \s* (?:\+[ \t]*)? )? [bBrRuU]{0,2} \\?["']
    | [ \t]* \\? [ \t]* \r?\n \s*
    | (?:\\r)?\\n [ \t]* (?: \\? \r?\n \s* )?
    )"""
WRAPPED = re.compile(rf"[A-Za-z0-9+/_\-]{{16,}}(?:{GAP}[A-Za-z0-9+/_\-]+)+={{0,2}}")
GAPS = re.compile(GAP)
PERCENT = re.compile(r"(?:[A-Za-z0-9_.~+\-]*%[0-9A-Fa-f]{2}){3,}[A-Za-z0-9_.~+\-]*")
ESCAPED = re.compile(r"(?:[^\s\"'\\]*\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-7]{3})){3,}[^\s\"'\\]*")

# --- fixed values: cues, in lower case, of which a line with a find (or the line above it) has one ---
CUES = [
    *"pass pwd secret tok auth cred bearer basic hmac salt seed login log-in account acct rotat identified putty 密码 口令 密钥 令牌 账号".split(),
    "log in", "private key", "sig=", "_sig", '"sig', "'sig", "pw=", 'pw"', "pw'", "_pw", "pw ",
    *(f"{a}{b}key" for a in "api access account shared sign signing signature private encryption master storage client".split() for b in ("", "_", "-", ".", " ")),
    "keytext", "key_text", "key-text", "key.text", "sharedaccess",
    *"ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- gldt- glrt- glsoat- glcbt- glptt- xox xapp- dapi dop_v1_ dkea akia asia aiza ya29. sk_live rk_live sk_test rk_test sk- npm_ pypi- hf_ sg. shpat_ shpca_ shppa_ shpss_ hvs. eyj".split(),
    *"mysql beeline impala-shell sshpass mongo sqoop psql redis-cli".split(), "-u ", "-u'", '-u"', "://",
]
_RUN = bytes(ord("a") if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/" else 32 for c in range(256))


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in CUES:
        a.add_word(c, c)
    a.make_automaton()
    return a


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def looks_random(s: str) -> bool:
    """A value that is no mere word: mixed classes of characters, or words joined with a number."""
    if len(s) < 6 or any(c.isspace() for c in s):
        return False
    has = [any(f(c) for c in s) for f in (str.islower, str.isupper, str.isdigit)] + [bool(re.search(r"[^\w\s]", s))]
    return sum(has) >= 3 or (has[2] and has[3]) or (has[0] and has[1] and not re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*", s)) or (has[2] and (has[0] or has[1]) and entropy(s) > 2.8 and len(s) >= 8)


def is_placeholder(v: str) -> bool:
    v = v.strip()
    if not v or len(v) < 3 or PLACEHOLDER.match(v):
        return True
    return "${" in v or "{{" in v or v.startswith(("$", "%(", "<%")) or len(set(v)) == 1


def names_secret(name: str) -> bool:
    """Whether a variable, option or column name names a credential (token_cnt or password_hash do not)."""
    name = name.strip("\"'`[]").rstrip(".")
    if not name:
        return False
    if re.fullmatch(r"(?i)login[_-][a-z]+", name):
        return True
    last = name.rsplit(".", 1)[-1]
    if NAME_END.search(name) or KEY_STEM.search(name):
        return True
    return bool(CAMEL_END.search(last)) and (not last.endswith("Key") or bool(KEY_STEM.search(last)))


# ---------------------------------------------------------------- layers


def _text(b: bytes) -> str | None:
    """The bytes as readable text, or None."""
    try:
        s = b.decode("utf-8")
    except UnicodeDecodeError:
        return None
    bad = sum(not (c.isprintable() or c in "\r\n\t") for c in s)
    return s if s and bad == 0 else None


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s.replace("-", "+").replace("_", "/") + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _unwrapped(text: str, s: int, e: int) -> Iterator[tuple[int, int, bytes]]:
    """Like layers, of the literal in pieces at ``s`` to ``e``.

    A word may follow that is no part of it (the end of a here-document): the
    last piece is left out too, and what comes after the first that is not as
    long as the others.
    """
    pieces, at = [], s
    for g in [*GAPS.finditer(text, s, e), None]:
        end = g.start() if g else e
        pieces.append((text[at:end], end))
        at = g.end() if g else e
    width = len(pieces[0][0])
    even = next((i for i, (p, _) in enumerate(pieces) if len(p) != width), len(pieces))
    for k in sorted({len(pieces), len(pieces) - 1, min(even + 1, len(pieces)), even}, reverse=True):
        lit = "".join(p for p, _ in pieces[:k])
        b = bytes.fromhex(lit) if k > 1 and HEX.fullmatch(lit) else _unbase64(lit) if k > 1 else None
        if b is not None and (_text(b) is not None or key_container(b) or b.startswith(DEFLATED)):
            yield s, pieces[k - 1][1], b
            return


def layers(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, decoded bytes) of every literal that is an encoding of something else."""
    raw = text.encode("utf-8", "replace")
    runs, at, wrapped = raw.translate(_RUN), 0, 0
    if b"a" * 16 in runs:
        flat = len(raw) == len(text)
        while (i := runs.find(b"a" * 16, at)) >= 0:
            j = runs.find(b" ", i)
            j = len(runs) if j < 0 else j
            s, e = (i, j) if flat else (len(raw[:i].decode("utf-8", "ignore")), len(raw[:j].decode("utf-8", "ignore")))
            while s and (text[s - 1] in "_-" or text[s - 1].isascii() and text[s - 1].isalnum()):
                s -= 1
            while e < len(text) and (text[e] in "_-+/=" or text[e].isascii() and text[e].isalnum()):
                e += 1
            lit = text[s:e]
            if s >= wrapped and (m := WRAPPED.match(text, s)):
                wrapped = m.end()
                yield from _unwrapped(text, s, wrapped)
            if h := HEX_RUN.fullmatch(lit):
                yield s + h.start(1), e, bytes.fromhex(h[1])
            if not HEX.fullmatch(lit):
                for m in BASE64.finditer(text, s, e):
                    if not re.fullmatch(r"[a-z/]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+", m[0]) and (b := _unbase64(m[0])) is not None:
                        yield m.start(), m.end(), b
            at = max(j, i + 16) if flat else j
    if text.count("%") >= 3:
        for lo, hi in _lines_with(text, re.compile("%[0-9A-Fa-f]{2}")):
            for m in PERCENT.finditer(text, lo, hi):
                yield m.start(), m.end(), re.sub(rb"%(?:25){2,}", b"%25", unquote_to_bytes(m[0]))
    if "\\" in text:
        for lo, hi in _lines_with(text, re.compile(r"\\(?:x[0-9A-Fa-f]|u[0-9A-Fa-f]|[0-7]{3})")):
            for m in ESCAPED.finditer(text, lo, hi):
                try:
                    yield m.start(), m.end(), m[0].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("utf-8", "replace")
                except (UnicodeDecodeError, UnicodeEncodeError):
                    continue


def _lines_with(text: str, what: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    while m := what.search(text, at):
        lo = text.rfind("\n", 0, m.start()) + 1
        hi = text.find("\n", m.end())
        at = hi = len(text) if hi < 0 else hi
        yield lo, hi


#: What opens or closes a round or square bracket, past quoted values; a line that leads into the next; a line of no more than a literal.
BRACKETS = re.compile(r"""\"[^"\\\n]*(?:\\.[^"\\\n]*)*\"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|[(\[]|[)\]]""")
LEADS = re.compile(r"(?i)(?:\b(?:identified|by|encrypted|password|secret|token|credentials|api_key|\w*access_key|secret_key|authorization|bearer|basic)|--[\w\-]+|[=+\\:(])['\"]?[ \t\r]*$")
PIECE = re.compile(r"""[ \t]*(?:[+=][ \t]*)?[bru]?(?:"[^"\n]*"|'[^'\n]*')[ \t]*\+?[ \t]*\\?[ \t]*[);]*[ \t\r]*$""", re.M)


def _grown(text: str, lo: int, hi: int) -> int:
    """End of the expression or SQL value that begins on the line at ``lo``; ``hi`` at least. Both are ends of lines."""
    depth, at = 0, lo
    while True:
        for m in BRACKETS.finditer(text, at, hi):
            if m[0] in "([":
                depth += 1
            elif m[0] in ")]":
                depth = max(0, depth - 1)
        last = text[text.rfind("\n", 0, hi) + 1 : hi]
        if hi >= len(text) or depth == 0 and last.strip() and not LEADS.search(last) and not PIECE.match(text, hi + 1):
            return hi
        at, hi = hi, text.find("\n", hi + 1)
        hi = len(text) if hi < 0 else hi


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches of whole lines in which rules can find something: lines with a cue, and the line after them.

    They go on over open brackets, literals in pieces, and values that stand lines below their names.
    """
    low = text.lower()
    if len(low) != len(text):  # some capital letters have longer small ones
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out: list[list[int]] = []
    for end, cue in _automaton().iter(low):
        if out and (end < out[-1][2] or out[-1][0] == 0 and out[-1][1] >= len(text)):
            continue
        lo = text.rfind("\n", 0, end) + 1
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        if cue == "://" and text.find("@", end, stop) < 0 or cue == "pass" and text[lo:stop].strip() == "pass":
            continue
        if cue in ("mysql", "beeline", "impala-shell", "sshpass", "mongo", "sqoop", "psql", "redis-cli") and not re.search(r"\s-[pwa]", text[end:stop]):
            continue
        nxt = text.find("\n", stop + 1)
        nxt = len(text) if nxt < 0 else nxt
        opened = text.rfind("/*", 0, stop)
        if opened >= 0 and text.rfind("*/", opened, end) < 0:  # in a block comment: all of it
            close = text.find("*/", end)
            lo, nxt = min(lo, text.rfind("\n", 0, opened) + 1), max(nxt, len(text) if close < 0 else close + 2)
        elif not out or out[-1][1] < len(text):
            nxt = _grown(text, lo, nxt)
        if out and lo <= out[-1][1]:
            out[-1][0], out[-1][1], out[-1][2] = min(lo, out[-1][0]), max(nxt, out[-1][1]), stop
        else:
            out.append([lo, nxt, stop])
    return [(a, b) for a, b, _ in out]


# ---------------------------------------------------------------- rules


SECTION = re.compile(r"(?m)^[^\S\n]*\[[\w .:\-]+\][^\S\n]*$")


@functools.lru_cache(maxsize=1)
def _settings(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the blocks of bare settings; the first line that is no setting begins at the end."""
    starts, ends = [], []
    for m in SECTION.finditer(text):
        if ends and m.start() < ends[-1]:
            continue
        at = m.end()
        while at < len(text):
            stop = text.find("\n", at + 1)
            stop = len(text) if stop < 0 else stop
            line = text[at + 1 : stop].strip()
            if line and not re.match(r"[\w.\-]+\s*[=:]", line) and not line.startswith(("#", ";")) and not SECTION.fullmatch(line):
                break
            at = stop
        starts.append(m.end() + 1)
        ends.append(at + 1)
    return starts, ends


def _ini(text: str, at: int) -> bool:
    """Whether the line at ``at`` lies in a block of bare settings: a [section] and only key lines above it."""
    start = text.rfind("\n", 0, at) + 1
    starts, ends = _settings(text)
    k = bisect.bisect_right(starts, start) - 1
    return k >= 0 and start <= ends[k]


def _bare_literal(v: str, ini: bool) -> str | None:
    """The literal in an unquoted right side; None if it is code, a look-up or a remark."""
    v = re.split(r"\s+[#;]|\s*;\s*$|,\s*$", v.strip())[0].strip()
    if not v or v[0] in "([{<$@\"'`|&" or is_placeholder(v):
        return None
    if any(c.isspace() for c in v):
        return None
    if ini:
        return v
    if re.fullmatch(r"-?\d+(\.\d+)?", v) or re.fullmatch(r"[A-Za-z_][\w.]*", v) and not looks_random(v):
        return None
    if re.search(r"[()\[\]{}\"']", v):
        return None
    return v if looks_random(v) else None


def _rules(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of credentials that stand in the text as it is; may overlap."""
    at = 0
    while "-----" in text or "PuTTY" in text:
        m = KEY_OPEN.search(text, at)
        if not m:
            break
        close = KEY_CLOSE.search(text, m.end())
        after = KEY_OPEN.search(text, m.end())
        if close and not (after and after.start() < close.start()):
            at = close.end()
        else:  # cut off: to the end of what can be its body, or to the next key
            body = re.compile(r"(?:\\n|[\s\"'+\\]|[A-Za-z0-9+/=:, \-])*").match(text, m.end())
            at = min(body.end(), after.start() if after else len(text))
        if at - m.end() > 40:
            yield m.start(), at, "private key"
    for lo, hi in _windows(text):
        yield from _in_window(text, lo, hi)


def _in_window(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    part = text[lo:hi]
    quoted, pairs, small = "'" in part or '"' in part, "=" in part or ":" in part or "：" in part, part.lower()
    for m in TOKEN.finditer(text, lo, hi):
        if not (m[0].startswith(("AKIA", "ASIA")) and len(set(m[0])) < 8):
            yield m.start(), m.end(), "token"
    for m in URL_LOGIN.finditer(text, lo, hi) if "://" in part else ():
        if not is_placeholder(m[1]):
            yield m.start(1), m.end(1), "login in URL"
    for m in URL_ARG.finditer(text, lo, hi) if "=" in part else ():
        if not is_placeholder(m[1]) and not m[1].startswith(("[", "(", "\\")):
            yield m.start(1), m.end(1), "parameter"
    for m in PAIR_IN_TEXT.finditer(text, lo, hi) if "=" in part else ():
        if not is_placeholder(m[2]) and looks_random(m[2]):
            yield m.start(2), m.end(2), "parameter"
    for m in HEADER.finditer(text, lo, hi) if "bearer" in small or "basic" in small or "authorization" in small or "x-" in small else ():
        v = m[1]
        if is_placeholder(v):
            continue
        if re.search(r"(?i)basic\s+$", text[max(0, m.start(1) - 8) : m.start(1)]):
            b = _unbase64(v)
            if b is None or b":" not in b or _text(b) is None or is_placeholder(_text(b).split(":", 1)[1]):
                continue
            yield m.start(1), m.end(1), "login in header"
        elif looks_random(v):
            yield m.start(1), m.end(1), "header"
    for m in FLAG.finditer(text, lo, hi) if " -" in part or "\"-" in part else ():
        for g in "abcde":
            if m[g] and not is_placeholder(m[g]) and not (g == "d" and m[g].isdigit()):
                yield m.start(g), m.end(g), "command line"
    for m in SQL_VALUE.finditer(text, lo, hi) if "'" in part else ():
        if not is_placeholder(m[1]) and not re.search(r"\s", m[1].strip()):
            yield m.start(1), m.end(1), "SQL"
    for m in SETTING.finditer(text, lo, hi) if "set" in small and "=" in part else ():
        v = m[2].strip()
        if names_secret(m[1]) and not is_placeholder(v) and not re.search(r"\s", v):
            yield m.start(2), m.start(2) + len(m[2].rstrip()), "setting"
    at = lo
    while pairs and (m := ASSIGN.search(text, at, hi)):
        at = m.end("sep") if m["bare"] else m.end()
        name = m["name"][1:] if m["name"][0] in "nrt" and text[m.start("name") - 1 : m.start("name")] == "\\" else m["name"]
        if not names_secret(name):
            if "\\" in (m["dq"] or ""):  # a text with lines of its own may assign too
                at = m.end("sep")
            continue
        g = next((g for g in ("dq", "sq", "bare") if m[g] is not None), None)
        if g is None:
            continue
        v, s, e = m[g], m.start(g), m.end(g)
        if m["sep"] == "==" and g == "bare":
            continue
        if g == "bare":
            comment = _in_comment(text, m.start())
            lit = _bare_literal(v, _ini(text, m.start()) or m["sep"] == "：")
            if m["name"] == m["name"].upper() and m["sep"] == "=" and not text[m.end("name")].isspace() and not lit:  # NAME=value command
                word = v.split()[0] if v.split() else ""
                lit = word if word and not is_placeholder(word) and looks_random(word) and not re.search(r"[()\[\]{}$`]", word) else None
            if comment and not lit:
                continue
            if not lit:
                continue
            s = text.index(lit, s)
            e = s + len(lit)
            if m["sep"] in ":：" and not (comment or looks_random(lit) or m["sep"] == "："):
                continue
        else:
            if is_placeholder(v) or re.search(r"\s", v) and not looks_random(v.replace(" ", "")) or v.startswith(("[", "(", "\\[")):
                continue
            if re.search(r"\s", v):
                if not re.match(r"(?i)(basic|bearer)\s+\S+$", v):
                    continue
            if SOFT_NAME.search(m["name"]) and not looks_random(v.split()[-1]):
                continue
            if m["sep"] == "==" and not looks_random(v):
                continue
        yield s, e, "assignment"
    for m in ARGS.finditer(text, lo, hi) if quoted and "," in part else ():
        if names_secret(m["name"]) and not is_placeholder(m["value"]) and not re.search(r"\s", m["value"]) and (looks_random(m["value"]) or not SOFT_NAME.search(m["name"])):
            if not names_secret(m["value"]):
                yield m.start("value"), m.end("value"), "argument"
    if quoted and "=" in part and "(" in part:
        yield from _calls(text, lo, hi)
    if quoted and "values" in text[_statement(text, lo) :].lower():
        yield from _inserts(text, lo, hi)
    yield from _comments(text, lo, hi)
    if "=" in part:
        yield from _joined(text, lo, hi)


CALL = re.compile(r"(?<![\w.])(?P<name>[A-Za-z_][\w.]*)[ \t]*=\s*(?:bytes\.fromhex|bytearray\.fromhex|binascii\.unhexlify|unhexlify|base64\.\w+|b64decode|SecretStr|Secret)\(\s*[brBR]?[\"']([^\"'\n]+)[\"']")


def _calls(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    for m in CALL.finditer(text, lo, hi):
        if names_secret(m["name"]) and not is_placeholder(m[2]):
            yield m.start(2), m.end(2), "encoded literal"


def _inserts(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    """Values of INSERT ... VALUES in the places of columns that name a credential."""
    for m in INSERT.finditer(text, _statement(text, lo)):
        cols = [i for i, c in enumerate(m[1].split(",")) if names_secret(c.strip())]
        at = m.end()
        while cols and at < len(text) and text[at] == "(":
            at, i, start, depth = at + 1, 0, at + 1, 0
            while at < len(text):
                c = text[at]
                if c in "'\"":
                    end = at + 1
                    while end < len(text) and text[end] != c:
                        end += 2 if text[end] == "\\" else 1
                    at = end
                elif c == "(":
                    depth += 1
                elif c in ",)" and not depth:
                    if i in cols:
                        v = text[start:at].strip()
                        if len(v) > 2 and v[0] in "'\"" and v[-1] == v[0] and not is_placeholder(v[1:-1]) and looks_random(v[1:-1]):
                            s = text.index(v, start) + 1
                            yield s, s + len(v) - 2, "SQL"
                    i, start = i + 1, at + 1
                    if c == ")":
                        break
                elif c == ")":
                    depth -= 1
                at += 1
            at += 1
            while at < len(text) and (text[at].isspace() or text[at] == ","):
                at += 1


def _in_comment(text: str, at: int) -> bool:
    line = text[text.rfind("\n", 0, at) + 1 : at]
    return bool(re.search(r"(?:^|\s)(?:--|#|//|/\*)", line))


def _comments(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    """Credentials told in comments: a cue, then a value that is no word."""
    for c in COMMENT_LINE.finditer(text, lo, hi):
        if c[0].startswith("#") and c.start() and text[c.start() - 1] not in " \t\r\n;":
            continue
        if c[0].startswith("//") and c.start() and text[c.start() - 1] == ":":
            continue
        cue = COMMENT_CUE.search(c[0])
        if not cue or KEY_OPEN.search(c[0]):
            continue
        for v in re.finditer(r"[^\s/,;，；：*\"'`()<>]+(?:[/*][^\s/,;，；：*\"'`()<>]+)*[=*]*", c[0]):
            s = v[0]
            if v.start() < cue.end() or s.endswith((":", "：")) or is_placeholder(s):
                continue
            s2 = s.rstrip(".") if not re.search(r"\W", s.rstrip(".")) else s
            if _comment_value(s2):
                yield c.start() + v.start(), c.start() + v.start() + len(s2), "comment"


def _comment_value(s: str) -> bool:
    if len(s) < 8 or re.fullmatch(r"[\w.\-]+\.[a-z]{2,4}|v?\d[\d.:\-]*|[A-Za-z]+|[A-Za-z]+[_\-][A-Za-z]+|[a-z_0-9]+\.[a-z_0-9]+(?:\.[a-z_0-9]+)?|[a-z]+(?:_[a-z0-9]+)+|https?:.*|--+|=+|\d+[a-z]+|\d{4}-\d\d-\d\d.*|[A-Z]+-\d+", s):
        return bool(len(s) >= 10 and re.fullmatch(r"[A-Za-z]+", s) and re.search(r"[a-z][A-Z]|[A-Z]{2,}[a-z]", s) and entropy(s) > 3 and looks_random(s))
    return looks_random(s) or bool(re.fullmatch(r"(?:[a-z]+-){2,}\d+", s))


def _joined(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    """A literal, maybe in pieces, of a name of a credential or of a variable given to one in the window."""
    for m in JOINED.finditer(text, lo, hi):
        if names_secret(m["name"]):
            yield from _pieces(m, True)
    for a in ALIAS.finditer(text, lo, hi):
        if names_secret(a["name"]):
            for at in re.finditer(rf"(?m)^[ \t]*{a['src']}[ \t]*=", text):
                if m := JOINED.match(text, at.start()):
                    yield from _pieces(m, False)


def _pieces(m: re.Match, several: bool) -> Iterator[tuple[int, int, str]]:
    pieces = re.findall(r"\"([^\"\n]*)\"|'([^'\n]*)'", m["lits"])
    value = "".join(a or b for a, b in pieces)
    if len(pieces) > several and not is_placeholder(value) and looks_random(value):
        end = m.start("lits") + len(m["lits"].rstrip(" \t\r\n+\\"))
        yield m.start("lits") + re.search(r"[\"']", m["lits"]).end(), end - 1, "joined literal"


def _statement(text: str, at: int) -> int:
    """Start of the INSERT that a window may lie in."""
    start = max(text.rfind("insert", 0, at + 6), text.rfind("INSERT", 0, at + 6), text.rfind("Insert", 0, at + 6))
    return start if start >= 0 and text.find(";", start, at) < 0 else at


def _inflated(b: bytes) -> Iterator[bytes]:
    """Compressed bytes inflated, in overlapping pieces; nothing if they are not compressed. What can be read of cut-off data is."""
    if not b.startswith(DEFLATED):
        return
    z, rest, kept = zlib.decompressobj(47), b, b""
    try:
        while rest and not z.eof:
            piece = z.decompress(rest, PIECE_BYTES)
            rest = z.unconsumed_tail
            if not piece:
                break
            kept += piece
            yield kept
            kept = kept[-OVERLAP:] if rest else b""
    except zlib.error:
        return


def _hidden(b: bytes) -> tuple[str, int] | None:
    """(kind, layers) of a credential in decoded bytes, or in what they encode in turn, to any depth."""
    todo, seen = [(b, 1)], set()
    while todo:
        b, depth = todo.pop()
        if (key := hashlib.blake2b(b, digest_size=16).digest()) in seen:
            continue
        seen.add(key)
        if kind := key_container(b):
            return f"{kind} container", depth
        todo += ((x, depth + 1) for x in _inflated(b))
        if (t := _text(b)) is None or len(t) < 6:
            continue
        if first := min(_rules(t), default=None):
            return first[2], depth
        todo += ((x, depth + 1) for _, _, x in layers(t))
    return None


def scan(text: str | None) -> list[Find]:
    """Credentials in a text, in order and without overlaps. Null and empty: none."""
    if not text:
        return []
    found = [Find(s, e, k, 0) for s, e, k in _rules(text) if e > s]
    for s, e, b in layers(text):
        if not any(f.start <= s and e <= f.end for f in found) and (hit := _hidden(b)):
            found.append(Find(s, e, *hit))
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Find] = []
    for f in found:
        if out and f.start < out[-1].end:
            if f.end > out[-1].end:
                out[-1] = out[-1]._replace(end=f.end)
        else:
            out.append(f)
    return out


def mask(text: str | None) -> str | None:
    """The text with every credential masked. Quotes, line ends and all else stay as they were.

    Within a masked span line ends (also written as ``\\n``) and quotes that join pieces stay.
    Masking again changes nothing: masks are placeholders.
    """
    if not text:
        return text
    out, at = [], 0
    for f in scan(text):
        span = text[f.start : f.end]
        if f.kind == "private key":
            span = re.sub(r"(-----[^\n-]+-----)|(\\n|\\r|[\r\n\"'+])|[^\r\n\"'\\+]|\\", lambda m: m[1] or m[2] or "*", span)
            span = span.replace("PRIVATE KEY", "MASKED KEY")
        elif f.kind == "joined literal":
            span = re.sub(r"(\"\s*\+?\s*\\?\s*\"|'\s*\+?\s*\\?\s*')|(.)", lambda m: m[1] or "*", span, flags=re.S)
        elif f.layers and GAPS.search(span):
            span = re.sub(rf"({GAP})|.", lambda m: m[1] or "*", span, flags=re.S)
        else:
            span = "*" * min(len(span), 8) if len(span) < 8 else "********"
        out += [text[at : f.start], span]
        at = f.end
    return "".join(out) + text[at:]


def credentials(df: DataFrame, row_id: str, text: str, src_table: str) -> DataFrame:
    """One row per credential: src_table, row_id, line_no, kind, layers.

    A map over Arrow batches without a shuffle; texts are scanned whole.
    ``df`` may have any further columns.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["row_id"], b["text"], strict=True):
                for f in scan(t):
                    rows.append((src_table, i, t.count("\n", 0, f.start) + 1, f.kind, f.layers))
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "line_no", "kind", "layers"])

    src = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")).filter("text <> ''")
    return src.mapInPandas(find, "src_table string, row_id long, line_no int, kind string, layers int")


def masked(df: DataFrame, text: str, into: str = "masked") -> DataFrame:
    """``df`` with the text's masked form in a further column (replaced if it exists). Null stays null."""

    @F.pandas_udf("string")
    def hide(s: pd.Series) -> pd.Series:
        return s.map(mask)

    return df.withColumn(into, hide(F.col(text)))
