"""Reading plain text and building sections: decode, lines to blocks, blocks to numbered parts of bounded size."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the reader.
SECTION_CHARS = 6000
HEADING_CHARS = 120
NUMBER_GAP = 20
_NUMBERED = re.compile(r"^\s*(?:(?:section|clause|article)\s+)?(\d{1,3}(?:\.\d{1,3})*)[.)]?\s+(\S.*)$", re.IGNORECASE)
_TITLE = re.compile(r"^\s*(?:schedule|annex|appendix|exhibit|part)\s+[\dA-Z]{1,4}\b.*$", re.IGNORECASE)


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding): by byte-order mark, by more than a quarter of NUL bytes among the first 4096, strict UTF-8, then cp1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    head = data[:4096]
    if head.count(0) > len(head) // 4:
        name = "utf-16-le" if head[1:2] == b"\x00" else "utf-16-be"
        return data.decode(name, "replace"), name
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace"), "cp1252"


def visible(text: str) -> str:
    return "".join(c for c in text if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf") or c in "\u200c\u200d")


def is_heading(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > HEADING_CHARS or s[-1] in ".;,:!?":
        return bool(_NUMBERED.match(s)) and len(s) <= HEADING_CHARS and s[-1:] not in ".;,"
    words = re.findall(r"[^\W\d_]+", s)
    return bool(_TITLE.match(s)) or bool(_NUMBERED.match(s)) or (bool(words) and len(words) <= 12 and (s.isupper() or all(w[0].isupper() for w in words if len(w) > 3) and 2 * sum(w[0].isupper() for w in words) >= len(words)))


def continues(before: str | None, number: str) -> bool:
    """Whether a number follows: deeper, or the next within the gap on one of the levels."""
    if before is None:
        return True
    a, b = [int(x) for x in before.split(".")], [int(x) for x in number.split(".")]
    if len(b) == len(a) + 1 and b[: len(a)] == a:
        return b[-1] <= NUMBER_GAP
    level = min(len(a), len(b)) - 1
    return b[:level] == a[:level] and 0 < b[level] - a[level] <= NUMBER_GAP


def blocks_of(text: str) -> list[tuple[str, str]]:
    """(kind, text): headings and paragraphs; a blank line ends a paragraph, wrapped lines are joined."""
    out: list[tuple[str, str]] = []
    held: list[str] = []

    def flush():
        if held:
            out.append(("text", " ".join(held)))
            held.clear()

    last = None
    for line in text.splitlines():
        s = " ".join(line.split())
        if not s:
            flush()
            continue
        m = _NUMBERED.match(s)
        if is_heading(s) and (m is None or continues(last, m[1])):
            flush()
            out.append(("heading", s))
            last = m[1] if m else last
        else:
            held.append(s)
    flush()
    return out


def cut_paragraph(text: str, size: int) -> list[str]:
    """Pieces of at most size characters, cut at the end of a sentence, else of a word."""
    out = []
    while len(text) > size:
        at = max(text.rfind(e, size // 2, size) + 1 for e in (". ", "; ", "! ", "? "))
        if at <= 0:
            at = text.rfind(" ", 1, size)
        if at <= 0:
            at = size
        out.append(text[:at].rstrip())
        text = text[at:].lstrip()
    return [*out, text] if text else out


def sections_of(blocks: list[tuple[str, str]], size: int = SECTION_CHARS) -> list[tuple[str, str, int, str]]:
    """(number, heading, part, text): a heading opens a section; long ones are cut to parts from 1, others are part 0."""
    drafts: list[tuple[str, str, list[str]]] = []
    for kind, text in blocks:
        if kind == "heading":
            m = _NUMBERED.match(text)
            drafts.append((m[1] if m else "", m[2] if m else text, []))
        else:
            if not drafts:
                drafts.append(("", "", []))
            drafts[-1][2].extend(cut_paragraph(text, size))
    out = []
    for number, heading, paragraphs in drafts:
        parts, held, room = [], [], size
        for p in paragraphs:
            if held and len(p) + 2 > room:
                parts.append("\n\n".join(held))
                held, room = [], size
            held.append(p)
            room -= len(p) + 2
        parts.append("\n\n".join(held))
        out += [(number, heading, 0 if len(parts) == 1 else k, text) for k, text in enumerate(parts, 1)]
    return out


def read_documents(files: DataFrame) -> DataFrame:
    """files (doc_id, content) -> doc_id, text, encoding, refused (a text that still holds NUL)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [decode(c or b"") for c in part.column(1).to_pylist()]
                refused = ["\x00" in t for t, _ in made]
                texts = [None if r else visible(t) for (t, _), r in zip(made, refused)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([e for _, e in made]), pa.array(refused)], names=["doc_id", "text", "encoding", "refused"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id bigint, text string, encoding string, refused boolean")


def build_sections(texts: DataFrame, size: int = SECTION_CHARS) -> DataFrame:
    """texts (doc_id, text) -> doc_id, ordinal, number, heading, part, text; one document at a time, no shuffle."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(d, k, *s) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for k, s in enumerate(sections_of(blocks_of(t or ""), size))]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "ordinal", "number", "heading", "part", "text"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ordinal int, number string, heading string, part int, text string")
