"""JSON records that carry the digest of their own body, and golden sets, each file a row of one partition or another."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# What a golden may say.
KINDS, STATUSES = ("present", "absent"), ("pass", "needs_review")


def canonical(body: dict) -> str:
    return json.dumps(body, sort_keys=True, ensure_ascii=False)


def sealed(body: dict) -> str:
    """A record as it is written: the body and the digest of its canonical form."""
    body = {k: v for k, v in body.items() if k != "sha256"}
    return json.dumps(body | {"sha256": hashlib.sha256(canonical(body).encode()).hexdigest()}, ensure_ascii=False)


def check_record(content: bytes | None, schema: str | None) -> tuple[str | None, str | None, bool, str | None]:
    """(schema, canonical body, whether its digest holds, why it is refused)."""
    try:
        data = json.loads((content or b"").decode("utf-8"))
    except (UnicodeDecodeError, ValueError):
        return None, None, False, "unreadable"
    if not isinstance(data, dict) or schema is not None and data.get("schema") != schema:
        return None, None, False, "another schema"
    body = {k: v for k, v in data.items() if k != "sha256"}
    text = canonical(body)
    if hashlib.sha256(text.encode()).hexdigest() != data.get("sha256"):
        return str(data.get("schema")), None, False, "changed" if "sha256" in data else "no digest"
    return str(data.get("schema")), text, True, None


def _files(spark: SparkSession, path: str, ddl: str, fn) -> DataFrame:
    """path and what fn gives for each file's bytes; Spark's own reader brings the files, whatever store they are in."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = T.StructType([T.StructField("path", T.StringType()), *T.StructType.fromDDL(ddl).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                where, content = (batch.column(c)[k].as_py() for c in (0, 1))
                columns = zip(*[(where, *row) for row in fn(content)])
                if columns := list(columns):
                    yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow)], schema=arrow)

    return files.mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """path, schema, body (canonical JSON), verified, refused: one row a file; a body that was changed is not given."""
    return _files(spark, path, "schema string, body string, verified boolean, refused string", lambda content: [check_record(content, schema)])


def write_records(rows: DataFrame, path: str) -> None:
    """Seal a column `body` of JSON objects and write them, one a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sealed(json.loads(b)) for b in batch.column(0).to_pylist()], type=pa.string())], names=["value"])

    rows.select("body").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def check_lines(lines: DataFrame, schema: str | None = None) -> DataFrame:
    """schema, body, verified, refused of records written one a line (a column `value`)."""
    ddl = T.StructType.fromDDL("schema string, body string, verified boolean, refused string")
    arrow = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [check_record((v or "").encode(), schema) for v in batch.column(0).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*found), arrow)], schema=arrow)

    return lines.select("value").mapInArrow(run, ddl)


def _golden_rows(content: bytes | None):
    try:
        data = json.loads((content or b"").decode("utf-8"))
        given = data["goldens"]
    except (UnicodeDecodeError, ValueError, KeyError, TypeError):
        return [(None, None, None, [], None, None, "unreadable")]
    categories = set(data.get("categories") or {})
    seen: set[str] = set()
    out = []
    for g in given:
        ident, kind, sections, status = str(g.get("id")), g.get("kind"), [str(s) for s in g.get("sections") or []], g.get("status")
        guidance = (g.get("guidance") or "").strip() or None
        why = (
            "id not unique" if ident in seen
            else "kind" if kind not in KINDS
            else "present without sections" if kind == "present" and not sections
            else "status" if status is not None and status not in STATUSES
            else "status without guidance" if status is not None and guidance is None
            else "category" if categories and g.get("category") not in categories
            else None
        )
        seen.add(ident)
        out.append((ident, str(g.get("question") or "").strip(), kind, sections, guidance, status, why))
    return out


def read_goldens(spark: SparkSession, path: str) -> DataFrame:
    """path, id, question, kind, sections, guidance, status, refused: the goldens of every set, and why one is refused."""
    return _files(spark, path, "id string, question string, kind string, sections array<string>, guidance string, status string, refused string", _golden_rows)


def accepted_sets(goldens: DataFrame) -> DataFrame:
    """The goldens of sets without a refused one: a set is taken whole or not at all."""
    return goldens.join(goldens.where(F.col("refused").isNotNull()).select("path").distinct(), "path", "left_anti")
