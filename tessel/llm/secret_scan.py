"""Secret scans with structural confirmation.

Patterns find assignments, access keys and hex runs. Beyond them, candidates that look encoded are
decoded (base64, base64url or hex; on one line or several, however these are joined: by line ends, escapes, blanks,
indents, marks of quotes) and reported only if what they hold parses: a private key whose nested DER lengths all agree, an OpenSSH key file whose length-prefixed fields do, a signed token
whose header and payload are JSON objects and whose signature has the length its algorithm makes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import small_batches

#: Kinds in the order in which spans of equal start are listed; the first three are pattern matches.
KINDS = ("assign", "access", "hex", "der_key", "ssh_key", "token")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# Candidates begin with what the encoding makes of the structure's first bytes (for DER the sequence with its length
# and the version, 0 or 1), so few are decoded. They may begin anywhere, after a hyphen run or an escape as well.
_DER64 = re.compile(r"M(?:[A-H][\w+/-]CAQ[AE]|I[GH][\w+/-]AgE[AB]|I[I-L][\w+/-]{2}[AQgw]IBA|I[M-P][\w+/-]{3}[AEIMQUYcgkosw048]CAQ[AE]|I[Q-T][\w+/-]{5}AgE[AB])", re.A)
_DER16 = re.compile(r"30(?:[0-7][0-9a-f]|81[89a-f][0-9a-f]|82[0-9a-f]{4}|83[0-9a-f]{6}|84[0-9a-f]{8})02010[01]", re.I | re.A)
_SSH64 = re.compile(r"b3BlbnNzaC1rZXktdjEA")
_SSH16 = re.compile(b"openssh-key-v1\0".hex(), re.I | re.A)
_RUN64 = re.compile(r"(?:[A-Za-z0-9+/_]++|-(?!----))++")
_RUN16 = re.compile(r"[0-9A-Fa-f]++")
# What may stand between the lines of a key: line ends, real or escaped, blanks, marks of quotes and comments before a
# line, the quotes (and signs) between strings of one line each; a backslash before a line end or a slash.
_JOINT = re.compile(r"""(?:\\+(?:[nrt]|u00(?:0[aAdD9]))|\\+(?=[\s/])|[\s>#*|]|["'][\s+.,\\]*["'])++""")
_TOKEN = re.compile(r"eyJ(?:(?<![A-Za-z0-9_-]eyJ)|(?<=\\[nrt]eyJ))[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Bytes of the signatures of signed tokens, by algorithm (fixed by RFC 7518); None: any of 64 or more.
SIGNATURES = {"none": 0, "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}


def _element(data, at: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end) of the DER element at ``at``, or None if its length is malformed.

    ``data`` gives slices of bytes (shorter ones at its end), as do all structures here: only the headers are asked for.
    """
    head = data[at : at + 6]
    if len(head) < 2:
        return None
    tag, n, at = head[0], head[1], at + 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or len(head) < 2 + more:
            return None
        n = int.from_bytes(head[2 : 2 + more], "big")
        if n < 0x80 or head[2] == 0:
            return None
        at += more
    return tag, at, at + n


def _children(data, start: int, end: int, most: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``start`` to ``end``, or None if they don't, or are more than a key has."""
    out = []
    while start < end:
        e = _element(data, start)
        if e is None or e[2] > end or len(out) == most:
            return None
        out.append(e)
        start = e[2]
    return out


def der_private_key(data) -> int:
    """Bytes of the private key that ``data`` begins with (PKCS#1, PKCS#8, SEC 1 or DSA), or 0."""
    top = _element(data, 0)
    if top is None or top[0] != 0x30 or not data.reaches(top[2]):
        return 0
    parts = _children(data, top[1], top[2], 10)
    if not parts or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return 0
    version, tags = data[parts[0][1] : parts[0][2]][0], [p[0] for p in parts]
    if version == 0 and len(parts) in (6, 9) and set(tags) == {0x02}:
        sizes = [p[2] - p[1] for p in parts[1:]]
        return top[2] if min(sizes) > 0 and sizes[0] >= 32 else 0
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        algorithm = _children(data, parts[1][1], parts[1][2], 2)
        return top[2] if algorithm and algorithm[0][0] == 0x06 and parts[2][2] - parts[2][1] >= 16 else 0
    if version == 1 and tags[1:2] == [0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return top[2] if parts[1][2] - parts[1][1] >= 16 else 0
    return 0


def ssh_private_key(data) -> int:
    """Bytes of the OpenSSH key file that ``data`` begins with, or 0."""
    magic = b"openssh-key-v1\0"
    if data[: len(magic)] != magic:
        return 0
    at = len(magic)

    def number() -> int:
        nonlocal at
        head, at = data[at : at + 4], at + 4
        return int.from_bytes(head, "big") if len(head) == 4 else -1

    def field() -> int:
        """The size of the next field, which is skipped; -1 if it isn't whole."""
        nonlocal at
        n = number()
        at += max(n, 0)
        return n if n >= 0 and data.reaches(at) else -1

    names = [field(), field(), field()]
    if min(names) < 0 or not names[0]:
        return 0
    keys = number()
    if not 1 <= keys <= 16 or any(field() <= 0 for _ in range(keys + 1)):
        return 0
    return at


class Digits:
    """The runs of digits of a text that lines of one key may be, found as far as candidates ask for them.

    A run is followed by a joint and the next run. Candidates that begin in runs which are known already share them, so
    each character is looked at once, however many candidates there are.
    """

    def __init__(self, text: str, run: re.Pattern, bits: int):
        self.text, self.run, self.bits = text, run, bits
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.before: list[int] = []  # digits of the runs before
        self.blank: list[int] = []  # runs after which only blanks stand
        self.kind: list[int] = []  # of those: counts up where the length of the run changes
        self.closed = True

    def candidate(self, start: int) -> Candidate:
        i = bisect_right(self.starts, start) - 1
        if i < 0 or start >= self.ends[i]:
            self.__init__(self.text, self.run, self.bits)
            self._append(start)
            self.closed, i = False, 0
        return Candidate(self, start, i)

    def _append(self, start: int) -> bool:
        m = self.run.match(self.text, start)
        if m:
            self.before.append(self.before[-1] + self.ends[-1] - self.starts[-1] if self.starts else 0)
            self.starts.append(start)
            self.ends.append(m.end())
        return bool(m)

    def extend(self) -> bool:
        """Find the next run, if the last one has a joint and a run after it."""
        if not self.closed:
            last = len(self.starts) - 1
            joint = _JOINT.match(self.text, self.ends[last])
            self.closed = not joint or not self._append(joint.end())
            if not self.closed and not any(c in joint[0] for c in "\n\r\\\"'"):
                n = self.ends[last] - self.starts[last]
                same = self.blank and self.ends[self.blank[-1]] - self.starts[self.blank[-1]] == n
                self.kind.append((self.kind[-1] if self.kind else 0) + (not same))
                self.blank.append(last)
        return not self.closed


class Candidate:
    """The bytes that the digits from ``start`` on stand for, decoded where they are asked for.

    Blanks alone join runs only if the one before them is as long as the first: lines of a key written on one line are
    equally long but for the last, and the words of a sentence aren't.
    """

    def __init__(self, digits: Digits, start: int, first: int):
        self.of, self.start, self.first = digits, start, first
        self.base = digits.before[first] + start - digits.starts[first]
        self.width = digits.ends[first] - start

    def _joined(self, last: int) -> bool:
        """Whether the runs up to ``last`` may be lines of one key."""
        d = self.of
        s, e = bisect_right(d.blank, self.first), bisect_left(d.blank, last)
        return s >= e or d.ends[d.blank[s]] - d.starts[d.blank[s]] == self.width and d.kind[s] == d.kind[e - 1]

    def _run(self, digit: int) -> int | None:
        """The run that holds a digit (from 0), or None if there is none that belongs to the candidate."""
        d, at = self.of, self.base + digit
        while at >= d.before[-1] + d.ends[-1] - d.starts[-1]:
            if not self._joined(len(d.starts) - 1) or not d.extend():
                return None
        i = bisect_right(d.before, at) - 1
        return i if self._joined(i) else None

    def reaches(self, n: int) -> bool:
        return n == 0 or self._run(-(-n * 8 // self.of.bits) - 1) is not None

    def __getitem__(self, which: slice) -> bytes:
        start, stop = which.start or 0, which.stop
        d, bits = self.of, self.of.bits
        unit, group = (3, 4) if bits == 6 else (1, 2)
        at, end = start // unit * group, -(-stop * 8 // bits)
        out = []
        while at < end and (i := self._run(at)) is not None:
            s = d.starts[i] + self.base + at - d.before[i]
            out.append(d.text[s : min(d.ends[i], s + end - at)])
            at += len(out[-1])
        return _bytes("".join(out), bits)[start - start // unit * unit :][: stop - start]

    def end(self, n: int) -> int:
        """The place in the text after the digits of the first ``n`` bytes."""
        last = -(-n * 8 // self.of.bits) - 1
        i = self._run(last)
        return self.of.starts[i] + self.base + last - self.of.before[i] + 1


def _bytes(digits: str, bits: int) -> bytes:
    """The bytes that the longest decodable beginning of ``digits`` (of 6 or 4 bits) stands for."""
    if bits == 4:
        return bytes.fromhex(digits[: len(digits) // 2 * 2])
    digits = digits[: len(digits) - (len(digits) % 4 == 1)].translate(_URL)
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


_URL = str.maketrans("-_", "+/")


def token_confirmed(token: str) -> bool:
    parts = token.split(".")
    try:
        header, payload = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
        signature = base64.urlsafe_b64decode(parts[2] + "=" * (-len(parts[2]) % 4))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or header.get("alg") not in SIGNATURES:
        return False
    n = SIGNATURES[header["alg"]]
    return len(signature) == n if n is not None else len(signature) >= 64


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, code points, in listing order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _decoded(head: re.Pattern, run: re.Pattern, bits: int, text: str, parse, kind: int) -> list[tuple[int, int, int]]:
    """Spans of encoded candidates that parse; after one that doesn't, the search goes on at the next character."""
    out, at, digits = [], 0, Digits(text, run, bits)
    while m := head.search(text, at):
        start, at = m.start(), m.start() + 1
        candidate = digits.candidate(start)
        if n := parse(candidate):
            at = candidate.end(n)
            if bits == 6:
                at += text.startswith("=", at) + text.startswith("==", at)
            out.append((start, kind, at))
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of decoded candidates that parse."""
    out = []
    out += _decoded(_DER64, _RUN64, 6, text, der_private_key, 3)
    out += _decoded(_DER16, _RUN16, 4, text, der_private_key, 3)
    if "b3BlbnNzaC1rZXktdjEA" in text:
        out += _decoded(_SSH64, _RUN64, 6, text, ssh_private_key, 4)
    out += _decoded(_SSH16, _RUN16, 4, text, ssh_private_key, 4)
    if "eyJ" in text:
        out += [(m.start(), 5, m.end()) for m in _TOKEN.finditer(text) if token_confirmed(m[0])]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. Each text is
    scanned whole by itself, so there is no shuffle and no key that could be hot.

    * A null text is empty and has no spans; null ids and repeated rows are rows like any other.
    * A key may have any length: of a candidate only the headers of its parts are decoded, and how far its digits go is
      found once for all candidates, so time is in proportion to the text, also where all of it looks like keys.
    * The first 12 digits of a key (20 of an OpenSSH file) must stand on one line.
    * Other columns are not read; an empty table gives no rows.
    """

    def scanned(batches):
        for b in batches:
            rows = []
            for text in b["text"]:
                text = text.as_py()
                base = base_spans(text)
                more = confirmed_spans(text)
                kinds = [k for _, k, _ in base]
                spans = listed(base)
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(spans.encode()).hexdigest(), listed(sorted(base + more)) if more else spans, len(more)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
    types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
