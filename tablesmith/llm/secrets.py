"""Secret scan with structural confirmation.

Patterns only nominate. A nominated base64 or hex string is decoded, and a span of one of the kinds below is reported
when the decoded bytes have the inner structure of that kind: nested DER lengths that fill each other exactly, the
length-prefixed fields of an OpenSSH key, the JSON header of a signed token. The three base kinds need no
confirmation; they are reported by their patterns alone.

A key may be wrapped over lines (real or escaped line breaks, quoted or behind marks of quotes and comments), stand
behind a prefix without a gap or before a tail: decoding starts wherever a known beginning stands in the joined
lines, and the key's own outer length says where it ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import pick, small_batches, table, text_slices, texts

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "token")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16}")  # one is in every hex span
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]+)-----")
_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*): *(.*)")
_CIPHER = re.compile(r"[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
# A long run of letters of base64 (or hex), with the lines that go on right behind its line breaks.
_BLOCK = re.compile(r"""[A-Za-z0-9+/_-]{44,}(?:[ \t"',]*(?:\\[rn]|[\r\n])(?:\\[rn]|[ \t\r\n"'>#*|])*[A-Za-z0-9+/_-]+)*={0,2}""")
# Where a key may begin: a DER sequence, an OpenSSH container or a public key's name in base64; a DER sequence in hex.
_START = re.compile(r"(?=(M[A-I]|b3BlbnNzaC1rZXktdjEA|AAAA[A-Z][A-Za-z0-9](?:Nz|Vj|Nr)|30[0-8]))")
_PADDING = re.compile("={0,2}")
_KEY_ITEMS = 10  # of the longest form, an RSA key with further primes
_MAGIC = b"openssh-key-v1\x00"
_SSH_NAME = re.compile(rb"ssh-|ecdsa-sha2-|sk-ssh-|sk-ecdsa-")
#: Fields of the public keys, by the name in their first field; others must fill the rest of their run.
_SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}


_PLAIN = str.maketrans("-_", "+/")


def decoded(candidate: str) -> bytes | None:
    """Bytes of a hex or base64 string (either alphabet, with or without padding); None if it is neither."""
    body = re.sub(r"\s+", "", candidate).rstrip("=")
    if len(body) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", body):
        return bytes.fromhex(body)
    try:
        return base64.b64decode(body.translate(_PLAIN) + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER items that fill ``data`` exactly, else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            wide = length & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            length = int.from_bytes(data[at : at + wide], "big")
            at += wide
            if length < 0x80:  # not the shortest form
                return None
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def is_der_key(data: bytes) -> bool:
    """A private or public key: one sequence that holds the integers, algorithm and key strings of its form."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == 0x02 and inner[0][1] in (b"\x00", b"\x01"):
        if len(tags) >= 6 and set(tags) <= {0x02, 0x30}:  # RSA (9 integers) or DSA (6)
            return True
        if tags[1] == 0x04 and len(inner[1][1]) >= 16 and set(tags[2:]) <= {0xA0, 0xA1}:  # elliptic curve
            return True
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # wrapped private key
            algorithm = der_items(inner[1][1])
            return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner[2][1]) >= 16
    if tags == [0x30, 0x03]:  # public key
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner[1][1]) >= 17
    if tags == [0x30, 0x04]:  # encrypted private key
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner[1][1]) >= 16
    return False


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container, or a public key whose length-prefixed fields fill it exactly."""
    if data.startswith(_MAGIC):
        data = data[len(_MAGIC) :]
        for _ in range(3):  # cipher, derivation, its options
            if len(data) < 4 or (n := int.from_bytes(data[:4], "big")) > len(data) - 4:
                return False
            data = data[4 + n :]
        return len(data) >= 4 and int.from_bytes(data[:4], "big") >= 1
    fields = []
    while data:
        if len(data) < 4 or (n := int.from_bytes(data[:4], "big")) > len(data) - 4:
            return False
        fields.append(data[4 : 4 + n])
        data = data[4 + n :]
    return len(fields) >= 2 and bool(_SSH_NAME.match(fields[0]))


class Letters:
    """Bytes encoded in a run of hex or base64 letters from ``start`` on; only the letters asked for are decoded."""

    def __init__(self, stream: str, start: int, hexed: bool) -> None:
        self.stream, self.start, self.hexed = stream, start, hexed
        self.size = (len(stream) - start) // 2 if hexed else (len(stream) - start) * 3 // 4

    def read(self, at: int, n: int) -> bytes:
        """At most ``n`` bytes from ``at`` on; none where the letters are not of this encoding."""
        try:
            if self.hexed:
                letters = self.stream[self.start + 2 * at : self.start + 2 * (at + n)]
                return bytes.fromhex(letters[: len(letters) // 2 * 2])
            letters = self.stream[self.start + at // 3 * 4 : self.start + (at + n + 2) // 3 * 4].translate(_PLAIN)
            letters = letters[:-1] if len(letters) % 4 == 1 else letters
            return base64.b64decode(letters + "=" * (-len(letters) % 4))[at % 3 :][:n]
        except ValueError:
            return b""

    def letters(self, size: int) -> int:
        """How many letters hold ``size`` bytes."""
        return 2 * size if self.hexed else (4 * size + 2) // 3


def der_key_size(data: Letters) -> int | None:
    """Bytes of the key that ``data`` begins with: a sequence that its items, as many as a key has at most, fill exactly."""

    def item(at: int) -> tuple[int, int, int]:
        head = data.read(at, 6)
        wide = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
        if len(head) < 2 + wide or wide > 4 or head[1] == 0x80:
            return -1, at, data.size + 1
        begin = at + 2 + wide
        return head[0], begin, begin + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])

    tag, at, size = item(0)
    if tag != 0x30 or size > data.size:
        return None
    for _ in range(_KEY_ITEMS):
        at = item(at)[2]
        if at >= size:
            break
    return size if at == size and is_der_key(data.read(0, size)) else None


def ssh_key_size(data: Letters) -> int | None:
    """Bytes of the OpenSSH container or public key that ``data`` begins with; one of unknown form fills all of it."""
    container = data.read(0, len(_MAGIC)) == _MAGIC
    at, wanted, fields = (len(_MAGIC), 3, 0) if container else (0, None, 0)
    while fields != wanted and at < data.size:
        head = data.read(at, 4)
        begin, end = at + 4, at + 4 + int.from_bytes(head, "big")
        if len(head) < 4 or end > data.size:
            return None
        if not fields and not container:
            name = data.read(begin, min(end - begin, 64))
            if not _SSH_NAME.match(name):
                return None
            wanted = 3 if name.startswith(b"ecdsa-sha2-") else _SSH_FIELDS.get(name)
        at, fields = end, fields + 1
        if container and fields == 3:  # the number of keys, their public parts, the private part
            wanted, at = 4 + int.from_bytes(data.read(at, 4), "big"), at + 4
    return at if (wanted is None or fields == wanted) and is_ssh_key(data.read(0, at)) else None


def encoded_keys(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the DER and OpenSSH keys in the base64 and hex runs of a text, from the first on."""
    for block in _BLOCK.finditer(text):
        runs = [(m.start(), m[0]) for m in _RUN.finditer(text, *block.span())]
        # The letter of an escaped line break is none of the run behind it.
        runs = runs[:1] + [(at + 1, run[1:]) if text[at - 1] == "\\" else (at, run) for at, run in runs[1:]]
        stream, places = "".join(run for _, run in runs), [0, *accumulate(len(run) for _, run in runs)]

        def place(at: int) -> int:
            n = bisect_right(places, at) - 1
            return runs[n][0] + at - places[n]

        done = 0
        for found in _START.finditer(stream):
            start, hexed = found.start(), found[1].startswith("30")
            if start < done:
                continue
            data, kind = Letters(stream, start, hexed), "der" if hexed or found[1][0] == "M" else "ssh"
            size = der_key_size(data) if kind == "der" else ssh_key_size(data)
            if size is None:
                continue
            done = start + data.letters(size)
            end = place(done - 1) + 1
            yield kind, place(start), end + (0 if hexed else len(_PADDING.match(text, end)[0]))


def is_armoured_key(body: str) -> bool:
    """Whether the text between a key's BEGIN and END marks is one: encoded, after header lines if it has any.

    An encrypted body of the old form can't be parsed; its headers must name cipher and start value, and the body must
    be whole blocks of that cipher.
    """
    lines = [x.strip(" \t\"',>#*|\\") for x in re.split(r"\\r|\\n|[\r\n]", body)]
    headers = {}
    while lines and (not lines[0] or _HEADER.fullmatch(lines[0])):
        if named := _HEADER.fullmatch(lines.pop(0)):
            headers[named[1].lower()] = named[2]
    if not all(re.fullmatch(r"[A-Za-z0-9+/=\s]*", x) for x in lines):
        return False
    raw = decoded("".join(lines))
    if raw and headers.get("proc-type", "").replace(" ", "") == "4,ENCRYPTED":
        cipher = _CIPHER.fullmatch(headers.get("dek-info", ""))
        return bool(cipher) and len(raw) >= 32 and len(raw) % (len(cipher[1]) // 2) == 0
    return bool(raw) and (is_der_key(raw) or is_ssh_key(raw))


def is_token_header(part: str) -> bool:
    """The first part of a signed token: a JSON object that names its algorithm."""
    raw = decoded(part)
    try:
        header = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in code points, by start and kind. Kinds may overlap one another."""
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if _LONG_HEX.search(text):
        spans += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    armoured = []
    if "-----BEGIN " in text:
        marks = list(_ARMOUR.finditer(text))
        armoured = [("pem", a.start(), b.end()) for a, b in pairwise(marks) if a[1] == "BEGIN" and b[1] == "END" and a[2] == b[2] and is_armoured_key(text[a.end() : b.start()])]
    if "eyJ" in text:
        spans += [("token", *m.span()) for m in _TOKEN.finditer(text) if is_token_header(m[1]) and decoded(m[2]) is not None and len(decoded(m[3]) or b"") >= 16]
    inside = [s for _, s, _ in armoured]
    for kind, start, end in encoded_keys(text):
        n = bisect_right(inside, start) - 1
        if n < 0 or end > armoured[n][2]:  # the armour names it already
            spans.append((kind, start, end))
    spans += armoured
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _scan(redacted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = [find_secrets(t) for t in texts(part, "text")]
                columns = [part.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r] for r in rows], pa.list_(kind))]
                if redacted:
                    columns.append(pa.array([redact(t, r) if r else None for t, r in zip(texts(part, "text"), rows)], pa.string()))
                yield pa.record_batch(columns, ["doc_id", "spans", "redacted"][: len(columns)])

    return run


def scan_secrets(docs: DataFrame, redacted: bool = True) -> DataFrame:
    """(doc_id, spans, redacted) for every row: the spans found, and the text without them (null: nothing found).

    A null text is scanned as the empty text. Repeated rows give repeated results; further columns are ignored. The
    cleaned text is left out where ``redacted`` is false.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind string, start long, end long>>" + ", redacted string" * redacted
    return pick(docs, "doc_id", "text").mapInArrow(_scan(redacted), schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with its secrets replaced by their kinds and ``n_chars`` counted anew where that changed the text."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                column = [None if t is None else redact(t, find_secrets(t)) for t in (v.as_py() for v in part.column("text"))]
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(column, pa.string()))

    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else cleaned


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), redacted=False)
    text = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind in ('assign', 'access', 'hex'))"
    count = [f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}" for k in KINDS[:3]]
    confirmed = "cast(size(filter(spans, s -> s.kind not in ('assign', 'access', 'hex'))) as long) as n_confirmed"
    return found.selectExpr("doc_id", *count, f"sha2({text.format(base)}, 256) as base_sha256", f"{text.format('spans')} as spans", confirmed)


QUERIES = {"op4_secret_scans": (op4_secret_scans, None)}
