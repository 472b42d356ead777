from __future__ import annotations

import json

from lexquarry.sources import files, sinks


def test_corpus_folder(spark, tmp_path):
    for name, data in {"a.txt": b"Title\n\nText.", "b.txt": b"Title\n\nText.", "c.pdf": b"\x12\x55\x04\x44\x62%PDF-1.7 x", "d.pdf": b"no", "e.docx": b"PK\x03\x04x", "f.txt": b"", "g.md": b"#"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.corpus_files(spark, str(tmp_path))
    got = {r.path[-5:]: (r.kind, r.refused) for r in found.collect()}
    assert got == {"a.txt": (".txt", None), "b.txt": (".txt", None), "c.pdf": (".pdf", None), "d.pdf": (None, "type"), ".docx": (".docx", None)}  # Spark lists no empty files
    rows = files.ingest_corpus(found).collect()
    assert {(r.path[-5:], r.copies, r.text) for r in rows} == {("a.txt", 2, "Title\n\nText."), ("c.pdf", 1, None), (".docx", 1, None)}


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps({"A": {"Law": ["x", "y"], "Cap": []}}))
    assert {tuple(r) for r in files.label_table(spark, str(tmp_path / "labels.json")).collect()} == {("A", "Law", "x"), ("A", "Law", "y"), ("A", "Cap", None)}
    (tmp_path / "task.json").write_text(json.dumps({"name": "t", "description": "", "fields": [{"key": "k", "label": "K", "question": "?"}]}))
    assert files.task_fields(spark, str(tmp_path / "task.json")).first().key == "k"
    (tmp_path / "p.csv").write_text("a,b\n1,2\n")
    assert files.provenance(spark, str(tmp_path / "p.csv")).first().b == "2"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "=1+1"), (1, " @x"), (3, "plain")], "id bigint, text string")
    sinks.write_values_csv(df, str(tmp_path / "csv"))
    assert {r.text for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=1+1", "' @x", "plain"}
    sinks.write_recording(df, str(tmp_path / "rec"), ["id"])
    assert spark.read.json(str(tmp_path / "rec")).count() == 3
    assert sinks.manifest(spark, {"t": df}).first().rows == 3
    assert sinks.manifest(spark, {"t": df}).first() == sinks.manifest(spark, {"t": df.orderBy("id")}).first()
    changed = df.withColumn("text", df.text.substr(1, 2))
    assert {r.id for r in sinks.changed_terminal_rows(df, changed, "id", "id < 3").collect()} == {1, 2} - {k for k in (1, 2) if len(" @x" if k == 1 else "=1+1") <= 2}
    assert [r.id for r in sinks.append_new(df, spark.createDataFrame([(3, "a"), (4, "b"), (4, "b")], "id bigint, text string"), "id").collect()] == [4]
