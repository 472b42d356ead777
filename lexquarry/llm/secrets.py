"""Secret scanning: fixed patterns plus zstandard novelty of candidate strings.

A candidate is a long unbroken run of key-like characters, or what follows a '=' in one, with a sensitive word shortly
before it on its line. Its
novelty is the number of bytes it adds to a zstandard frame that already holds the surrounding text, compressed against
a dictionary of identifiers common in code. Words, paths and identifiers are mostly paid for by the dictionary or by the
text around them; random key material is not, so a high number of added bytes marks a secret: high for its characters, or
for what a random run of its alphabet and length would add in its place, as long runs of few letters are coded in less.

Defined results: null and empty texts hold no span; a text of any length is read whole; equal rows give equal results;
columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re

import zstandard
from pyspark.sql import DataFrame

from .common import map_columns, pruned

# The pattern kinds, in the order in which ties at one start are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
VALUE = re.compile(r"(?<==)[A-Za-z0-9+/_-]+=*")
SENSITIVE = re.compile(r"auth|bearer|credential|passphrase|passwd|password|private|secret|signing|signature|token|api.?key|access.?key|session.?key|client.?key|\bpwd\b", re.IGNORECASE | re.ASCII)
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (_DIGITS + "ABCDEF", _DIGITS + "abcdef", _UPPER + "234567=", _DIGITS + _UPPER, _DIGITS + _LOWER, _DIGITS + _LOWER + _UPPER + "+/_-=")
IDENTIFIERS = (
    b"abstract access account address algorithm api append application argument array async attribute auth authorization "
    b"await base64 bearer boolean buffer bytes cache callback catch certificate char class client code column config "
    b"connection const constructor container content context controller cookie count credential current data database date "
    b"default delete description dictionary directory document double element else email encoding endpoint entity enum "
    b"environment error event exception export extends false file final float footer for format from function handler hash "
    b"header host html http https id identifier if implements import include index info input insert instance int integer "
    b"interface internal item iterator json key language length level library license line list local localhost location "
    b"logger long main manager map message metadata method model module name namespace new node null number object offset "
    b"option order output package parameter parent parse password path pattern permission pointer port position primary "
    b"private process property protected protocol provider public query range read record reference region register "
    b"repository request require resource response result return role root route rule schema script secret security select "
    b"self server service session setting short signature size source static status stream string struct style super switch "
    b"system table target template test text this thread throw time timestamp title token transaction true try type uint8 "
    b"union unknown update upload url user username utf-8 validate value variable vector version view virtual void while "
    b"window write xml yaml src/main/java/com/ org/ src/test/ usr/local/lib/ bin/ etc/ var/log/ node_modules/ https://www. 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ example placeholder changeme "
)

_compressor: zstandard.ZstdCompressor | None = None


def _primed() -> zstandard.ZstdCompressor:
    global _compressor
    if _compressor is None:
        words = zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=9)
        _compressor = zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_dict_id=False)
    return _compressor


def marginal_bytes(before: str, candidate: str, after: str) -> int:
    """Bytes the candidate adds to the compressed surroundings."""
    frame = _primed().compress
    around = (before + after).encode("utf-8", "replace")
    return len(frame(around + b"\n" + candidate.encode())) - len(frame(around + b"\n"))


def random_like(candidate: str) -> str:
    """A fixed random run of the candidate's length over the least alphabet that has all its characters."""
    held = set(candidate)
    alphabet = next(a for a in ALPHABETS if held <= set(a))
    return hashlib.shake_256(b"random").digest(len(candidate)).translate(bytes(ord(alphabet[i * len(alphabet) >> 8]) for i in range(256))).decode()


def find_secrets(text: str | None, context: int = 64, surround: int = 512, novelty: float = 0.8) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, by start and then kind; code points, end exclusive."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e in spans)

    def sensitive(s: int) -> bool:
        line = max(text.rfind("\n", max(0, s - context), s) + 1, s - context, 0)
        return SENSITIVE.search(text, line, s) is not None

    def novel(s: int, e: int) -> bool:
        if any(a < e and s < b for a, b in base):
            return False
        body = text[s:e]
        if not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
            return False
        before, after = text[max(0, s - surround) : s], text[e : e + surround]
        added = marginal_bytes(before, body, after)
        # zstandard codes long runs at the entropy of their alphabet, so a random one adds fewer bytes than it has characters
        return added >= novelty * len(body) or added >= novelty * marginal_bytes(before, random_like(body), after)

    for m in CANDIDATE.finditer(text):
        if sensitive(m.start()) and novel(*m.span()):
            spans.append((m.start(), 3, m.end()))
            continue
        # a key's name may be written against its value: what follows the first '=' after a sensitive word, else each value
        values = [v.span() for v in VALUE.finditer(text, *m.span()) if sensitive(v.start())]
        if values and m.end() - values[0][0] >= LEAST and novel(values[0][0], m.end()):
            spans.append((values[0][0], 3, m.end()))
        else:
            spans += [(s, 3, e) for s, e in values if e - s >= LEAST and novel(s, e)]
    spans.sort()
    return [(s, KINDS[k], e) for s, k, e in spans]


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and `spans`, an array of (start, kind, stop)."""

    def run(ids, texts):
        return ids, [[{"start": s, "kind": k, "stop": e} for s, k, e in find_secrets(t)] for t in texts]

    kind = dict(docs.dtypes)[id_col]
    return map_columns(pruned(docs, id=id_col, text=text_col), run, f"id {kind}, spans array<struct<start:bigint,kind:string,stop:bigint>>")


def redact_text(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced; null stays null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(*columns):
        columns = list(columns)
        columns[at] = [t if not t or not (found := find_secrets(t)) else redact_text(t, found) for t in columns[at]]
        return columns

    return map_columns(docs, run, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)).select(*[f"`{n}`" for n in names])


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, the three base counts, the base digest and all spans."""

    def run(ids, texts):
        out = [[], [], [], [], [], []]
        for i, t in zip(ids, texts):
            found = find_secrets(t)
            base = [x for x in found if x[1] != "novel"]
            row = (i, *[sum(x[1] == k for x in base) for k in KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found))
            for column, value in zip(out, row):
                column.append(value)
        return out

    ddl = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_columns(pruned(docs, id="doc_id", text="text"), run, ddl)
