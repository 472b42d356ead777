from __future__ import annotations

from lexquarry.operators.alignment import align
from lexquarry.operators.sectioning import blocks_of, build_sections, cut_paragraph, decode, read_documents, sections_of

CONTRACT = "SERVICES AGREEMENT\n\n1. Term\nThe term is one year.\n\n2. Fees\nFees are due\nin 30 days.\n\n2.1 Late fees\nInterest accrues.\n"


def test_contract_has_four_sections():
    got = [(n, h, t) for n, h, _, t in sections_of(blocks_of(CONTRACT))]
    assert got == [("", "SERVICES AGREEMENT", ""), ("1", "Term", "The term is one year."), ("2", "Fees", "Fees are due in 30 days."), ("2.1", "Late fees", "Interest accrues.")]


def test_long_sections_are_cut_and_lose_nothing():
    text = "1. Long\n" + " ".join(f"Sentence number {k} ends here." for k in range(900))
    parts = sections_of(blocks_of(text), 600)
    assert [p for _, _, p, _ in parts] == list(range(1, len(parts) + 1)) and all(len(t) <= 600 for *_, t in parts)
    assert " ".join(" ".join(t for *_, t in parts).split()) == text.split("\n", 1)[1]
    assert cut_paragraph("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and cut_paragraph("", 10) == []


def test_decoding_ladder():
    assert decode("é".encode()) == ("é", "utf-8") and decode(b"\xe9") == ("é", "cp1252") and decode(b"\xef\xbb\xbfa") == ("a", "utf-8")
    assert decode("hello there".encode("utf-16-le")) == ("hello there", "utf-16-le") and decode(b"") == ("", "utf-8")


def test_spark_reader(spark):
    files = spark.createDataFrame([(1, bytearray(CONTRACT.encode())), (2, None), (3, bytearray(b"some text\x00b"))], "doc_id bigint, content binary")
    read = read_documents(files)
    assert {r.doc_id: r.refused for r in read.collect()} == {1: False, 2: False, 3: True}
    assert build_sections(read).groupBy("doc_id").count().collect()[0]["count"] == 4


def _s(k, text, heading="", number=""):
    return {"ordinal": k, "number": number, "heading": heading, "text": text, "k": f"{number}|{heading}|{text}"}


def test_alignment_passes():
    words = "one two three four five six seven eight nine ten eleven twelve"
    old = [_s(0, "same"), _s(1, "moved", "A"), _s(2, "old text", "Fees", "2"), _s(3, "was here", "Notices", "3"), _s(4, words, "X"), _s(5, "gone", "G")]
    new = [_s(0, "same"), _s(1, "moved", "B"), _s(2, "new text", "Fees", "2"), _s(3, "is here", "Notices", "4"), _s(4, words + " more", "Y"), _s(5, "fresh", "H")]
    assert {k: v[1] for k, v in align(old, new).items()} == {0: "identical", 1: "content", 2: "number and heading", 3: "heading", 4: "wording"}
