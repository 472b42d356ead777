"""Models behind a function: made once a worker, called in batches, with bounded memory.

A provider is a factory without arguments. What it makes is kept by name for as long as its Python worker lives, so a
task does not load it again; rows stream through in slices of one batch. Null texts are given as empty ones.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[str, str], str]
BATCH = 64
ATTEMPTS = 2

_made: dict[str, Callable] = {}


def made_once(name: str, make: Callable[[], Callable]) -> Callable:
    if name not in _made:
        _made[name] = make()
    return _made[name]


def _batched(df: DataFrame, key: list[str], columns: list[str], out: str, name: str, make: Callable[[], Callable], call: Callable) -> DataFrame:
    rows = df.select(*key, *columns)
    schema = T.StructType(rows.schema.fields[: len(key)] + T.StructType.fromDDL(out).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                fn = fn or made_once(name, make)
                part = batch.slice(at, BATCH)
                found = call(fn, *[["" if v is None else v for v in c.to_pylist()] for c in part.columns[len(key) :]])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(key)], *[pa.array(v, type=f.type) for v, f in zip(found, list(arrow)[len(key) :])]], schema=arrow)

    return rows.mapInArrow(run, schema)


def embed(df: DataFrame, key: list[str], text: str, name: str, make: Callable[[], Embedder], prefix: str = "", most_characters: int | None = None) -> DataFrame:
    """key, `vector`: the model's vector of each text, with the prefix that queries carry; cut only for a model that reads no more."""

    def call(fn: Embedder, texts: list[str]):
        given = [prefix + (t if most_characters is None else t[:most_characters]) for t in texts]
        vectors = fn(given)
        if len(vectors) != len(given):
            raise ValueError(f"{name}: {len(vectors)} vectors for {len(given)} texts")
        return [vectors]

    return _batched(df, key, [text], "vector array<float>", name, make, call)


def generate(df: DataFrame, key: list[str], system: str, user: str, required: dict[str, type], name: str, make: Callable[[], Generator]) -> DataFrame:
    """key, `answer` (JSON with sorted keys), `attempts`, `error`: a model's answers that have the required fields, asked twice at most."""

    def one(fn: Generator, s: str, u: str):
        error = None
        for attempt in range(1, ATTEMPTS + 1):
            try:
                said = json.loads(fn(s, u))
                bad = [k for k, kind in required.items() if not isinstance(said.get(k), kind)]
                if not bad:
                    return json.dumps(said, sort_keys=True, ensure_ascii=False), attempt, None
                error = "missing or of another kind: " + ", ".join(bad)
            except (ValueError, AttributeError) as e:
                error = f"no JSON object: {type(e).__name__}"
        return None, ATTEMPTS, error

    def call(fn: Generator, systems: list[str], users: list[str]):
        return list(zip(*[one(fn, s, u) for s, u in zip(systems, users)]))

    return _batched(df, key, [system, user], "answer string, attempts int, error string", name, make, call)


class HashedWords:
    """A model without parameters: words counted by hash, with a sign. Not normalised, so vectors of parts add up."""

    def __init__(self, dims: int = 64, normalised: bool = False):
        self.dims, self.normalised, self.known = dims, normalised, {}

    def _place(self, word: str) -> tuple[int, int]:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            digest = hashlib.md5(word.encode()).hexdigest()
            self.known[word] = int(digest[:4], 16) % self.dims, 1 if digest[4] < "8" else -1
        return self.known[word]

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dims
            for word in re.findall("[a-z0-9]+", text.lower()):
                at, sign = self._place(word)
                v[at] += sign
            norm = math.sqrt(sum(x * x for x in v)) if self.normalised else 0.0
            out.append([x / norm for x in v] if norm else v)
        return out
