"""Containers of private keys, recognised by their whole binary grammar: every field and length, to the last byte.

Known are DER of PKCS#1, PKCS#8 (plain and encrypted), SEC1, DSA and PKCS#12,
OpenSSH, Java key stores, OpenPGP packets and Microsoft key blobs. Public keys,
certificates, signatures and bytes that only begin like a container are none.
"""

from __future__ import annotations

from typing import NamedTuple

# --- fixed values: object identifiers (DER), by what the inner key of PKCS#8 is ---
RSA = {bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"), bytes.fromhex("2a864886f70d010107")}
EC = {bytes.fromhex("2a8648ce3d0201")}
NUMBER = {bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"), bytes.fromhex("2a8648ce3e0201")}
EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6571"): 57}
#: Beginnings of the identifiers of password-based encryption, and identifiers of PKCS#12 contents.
PASSWORD_BASED = tuple(map(bytes.fromhex, ("2a864886f70d0105", "2a864886f70d010c01", "2b060104012a02110101", "2b060104012a021301")))
CONTENT = {bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010702")}
#: Fields of a private key in an OpenSSH file after its type.
OPENSSH_FIELDS = {b"ssh-rsa": 6, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
#: Public numbers of an OpenPGP key by algorithm; those on curves have an identifier first.
PGP_NUMBERS = {1: 2, 2: 2, 3: 2, 16: 3, 17: 4, 20: 3}
PGP_CURVES = {18, 19, 22}
PGP_FIXED = {25: 32, 26: 56, 27: 32, 28: 57}

INTEGER, BITS, OCTETS, NULL, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x05, 0x06, 0x30


class Element(NamedTuple):
    tag: int
    start: int
    end: int
    next: int


class NoContainer(Exception):
    """The bytes break the grammar."""


def _element(b: bytes, at: int, end: int) -> Element:
    if at + 2 > end:
        raise NoContainer
    tag, n, at = b[at], b[at + 1], at + 2
    if tag & 0x1F == 0x1F:
        raise NoContainer
    if n == 0x80 and tag & 0x20:  # of indefinite length: items up to two zeros
        stack, start = 1, at
        while stack:
            if b[at : at + 2] == b"\0\0":
                stack, at = stack - 1, at + 2
            elif at + 2 <= end and b[at + 1] == 0x80 and b[at] & 0x20:
                stack, at = stack + 1, at + 2
            else:
                at = _element(b, at, end).next
        return Element(tag, start, at - 2, at)
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            raise NoContainer
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
    if at + n > end:
        raise NoContainer
    return Element(tag, at, at + n, at + n)


def _items(b: bytes, at: int, end: int) -> list[Element]:
    out = []
    while at < end:
        out.append(_element(b, at, end))
        at = out[-1].next
    return out


def _sequence(b: bytes) -> list[Element]:
    """Items of the one sequence that the bytes are."""
    top = _element(b, 0, len(b))
    if top.tag != SEQUENCE or top.next != len(b):
        raise NoContainer
    return _items(b, top.start, top.end)


def _tags(items: list[Element]) -> list[int]:
    return [i.tag for i in items]


def _need(ok: bool) -> None:
    if not ok:
        raise NoContainer


def _bytes(b: bytes, e: Element) -> bytes:
    return b[e.start : e.end]


def _algorithm(b: bytes, e: Element) -> bytes:
    parts = _items(b, e.start, e.end)
    _need(e.tag == SEQUENCE and bool(parts) and parts[0].tag == OID and parts[0].end > parts[0].start and len(parts) <= 2)
    return _bytes(b, parts[0])


def _version(b: bytes, items: list[Element]) -> int:
    _need(bool(items) and items[0].tag == INTEGER and items[0].end - items[0].start == 1)
    return b[items[0].start]


def _pkcs1(b: bytes) -> str:
    items = _sequence(b)
    more = items[9:]
    _need(_tags(items[:9]) == [INTEGER] * 9 and all(i.end > i.start for i in items[:9]))
    _need(_version(b, items) == len(more) and _tags(more) == [SEQUENCE] * len(more) and len(more) <= 1)
    return "pkcs1"


def _dsa(b: bytes) -> str:
    items = _sequence(b)
    _need(_tags(items) == [INTEGER] * 6 and _version(b, items) == 0 and all(i.end > i.start for i in items))
    return "dsa"


def _sec1(b: bytes) -> str:
    items = _sequence(b)
    _need(_version(b, items) == 1 and _tags(items[1:2]) == [OCTETS] and items[1].end - items[1].start >= 20)
    _need(_tags(items[2:]) in ([], [0xA0], [0xA1], [0xA0, 0xA1]))
    for e in items[2:]:
        inner = _items(b, e.start, e.end)
        _need(_tags(inner) in ([[OID], [SEQUENCE]] if e.tag == 0xA0 else [[BITS]]))
    return "sec1"


def _pkcs8(b: bytes) -> str:
    items = _sequence(b)
    _need(_version(b, items) in (0, 1) and _tags(items[1:3]) == [SEQUENCE, OCTETS] and set(_tags(items[3:])) <= {0xA0, 0x81, 0xA1} and len(items) <= 5)
    kind, inner = _algorithm(b, items[1]), _bytes(b, items[2])
    if kind in RSA:
        _pkcs1(inner)
    elif kind in EC:
        _sec1(inner)
    else:
        one = _element(inner, 0, len(inner))
        _need(one.next == len(inner) and one.end > one.start)
        if kind in NUMBER:
            _need(one.tag == INTEGER)
        if kind in EDWARDS:
            _need(one.tag == OCTETS and one.end - one.start == EDWARDS[kind])
    return "pkcs8"


def _encrypted(b: bytes) -> str:
    items = _sequence(b)
    _need(_tags(items) == [SEQUENCE, OCTETS] and items[1].end > items[1].start and _algorithm(b, items[0]).startswith(PASSWORD_BASED))
    return "encrypted pkcs8"


def _pkcs12(b: bytes) -> str:
    items = _sequence(b)
    _need(_version(b, items) == 3 and _tags(items[1:]) in ([SEQUENCE], [SEQUENCE, SEQUENCE]))
    content = _items(b, items[1].start, items[1].end)
    _need(_tags(content) == [OID, 0xA0] and _bytes(b, content[0]) in CONTENT and bool(_items(b, content[1].start, content[1].end)))
    if len(items) == 3:
        mac = _items(b, items[2].start, items[2].end)
        _need(_tags(mac[:2]) == [SEQUENCE, OCTETS] and _tags(mac[2:]) in ([], [INTEGER]))
    return "pkcs12"


class _Reader:
    def __init__(self, b: bytes, at: int = 0):
        self.b, self.at = b, at

    def take(self, n: int) -> bytes:
        _need(0 <= n <= len(self.b) - self.at)
        self.at += n
        return self.b[self.at - n : self.at]

    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")

    def field(self, size: int = 4) -> bytes:
        return self.take(self.number(size))

    @property
    def left(self) -> int:
        return len(self.b) - self.at


def _openssh(b: bytes) -> str:
    _need(b.startswith(b"openssh-key-v1\0"))
    r = _Reader(b, 15)
    cipher, derivation, options, keys = r.field(), r.field(), r.field(), r.number(4)
    _need(bool(cipher) and bool(derivation) and 1 <= keys <= r.left)
    kinds = [_Reader(r.field()).field() for _ in range(keys)]
    secret = r.field()
    _need(not r.left and bool(secret) and len(secret) % 8 == 0)
    if cipher == b"none":
        _need(derivation == b"none" and not options)
        s = _Reader(secret)
        _need(s.take(4) == s.take(4))
        for kind in kinds:
            _need(s.field() == kind)
            if kind not in OPENSSH_FIELDS:  # of a kind with fields of its own
                return "openssh"
            for _ in range(OPENSSH_FIELDS[kind] + 1):  # and the remark
                s.field()
        at = s.at
        _need(s.take(s.left) == bytes(range(1, 256))[: len(secret) - at])
    return "openssh"


def _key_store(b: bytes) -> str:
    _need(b[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"))
    r, keys = _Reader(b, 4), 0
    version, entries = r.number(4), r.number(4)
    _need(version in (1, 2) and 1 <= entries <= r.left)

    def certificate() -> None:
        if version == 2:
            _need(bool(r.field(2)))
        _element(cert := r.field(), 0, len(cert))

    for _ in range(entries):
        kind = r.number(4)
        r.field(2)  # alias
        r.take(8)  # date
        if kind == 1:
            _encrypted(r.field())
            keys += 1
            for _ in range(r.number(4)):
                certificate()
        elif kind == 2:
            certificate()
        else:
            _need(kind == 3 and b[:4] == b"\xce\xce\xce\xce" and r.take(4) == b"\xac\xed\x00\x05")
            return "jks"  # a sealed secret key; only Java tells where it ends
    _need(keys > 0 and r.left == 20)  # and a digest
    return "jks"


def _pgp_packet(r: _Reader) -> tuple[int, bytes]:
    head = r.number(1)
    _need(bool(head & 0x80))
    if not head & 0x40:  # old format
        size = head & 3
        return head >> 2 & 0xF, r.take(r.left if size == 3 else r.number(1 << size))
    body = b""
    while True:
        n = r.number(1)
        if n < 192:
            return head & 0x3F, body + r.take(n)
        if n < 224:
            return head & 0x3F, body + r.take((n - 192 << 8) + r.number(1) + 192)
        if n == 255:
            return head & 0x3F, body + r.take(r.number(4))
        body += r.take(1 << (n & 0x1F))


def _pgp(b: bytes) -> str:
    r, first = _Reader(b), True
    while r.left:
        tag, body = _pgp_packet(r)
        _need(tag in (5, 7) if first else tag in (2, 5, 6, 7, 10, 12, 13, 14, 17, 21))
        if first:
            k = _Reader(body)
            version = k.number(1)
            _need(version in (3, 4, 5, 6))
            k.take(6 if version == 3 else 4)
            kind = k.number(1)
            if version > 4:
                k.take(4)
            if kind in PGP_CURVES:
                _need(bool(k.field(1)))
                k.take((k.number(2) + 7) // 8)
                if kind == 18:
                    k.field(1)
            elif kind in PGP_FIXED:
                k.take(PGP_FIXED[kind])
            else:
                _need(kind in PGP_NUMBERS)
                for _ in range(PGP_NUMBERS[kind]):
                    k.take((k.number(2) + 7) // 8)
            _need(k.left >= 4)  # how the secret part is protected, and that part
        first = False
    _need(not first)
    return "pgp"


def _microsoft(b: bytes) -> str:
    if b[:4] == bytes.fromhex("1ef1b5b0"):  # a file with a header: kind, encryption, sizes of salt and key
        salt, key = (int.from_bytes(b[i : i + 4], "little") for i in (16, 20))
        _need(len(b) == 24 + salt + key and key > 20)
        return "pvk"
    bits = int.from_bytes(b[12:16], "little")
    _need(b[:2] == b"\x07\x02" and b[8:12] == b"RSA2" and bits >= 512 and bits % 16 == 0 and len(b) == 20 + bits // 16 * 9)
    return "key blob"


def key_container(b: bytes) -> str | None:
    """The kind of private-key container that the bytes are, by its grammar; None for public keys and the rest."""
    if len(b) < 24:
        return None
    if b[0] == SEQUENCE:
        rules = (_pkcs1, _pkcs8, _sec1, _encrypted, _pkcs12, _dsa)
    else:
        rules = (_openssh, _key_store, _microsoft) + ((_pgp,) if b[0] & 0x80 else ())
    for rule in rules:
        try:
            return rule(b)
        except NoContainer:
            continue
    return None
