"""The manifest against its SQL statement and against plain trees."""

from __future__ import annotations

import random
import zlib

import pytest

from lexquarry.llm import merkle
from tests.helpers import duck_rows, spark_rows


def plain_manifest(rows):
    """The contract, one document at a time."""

    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r):
        return merkle.h("".join(part(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")).encode())

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([merkle.h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for row in tree[:-1]:
            p = i - i % 3
            yield b"".join(row[p:i]), b"".join(row[i + 1 : p + 3])
            i //= 3

    first = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: first(s) if s is not None else (False, b""))
    trees = {s: levels([leaf(r) for r in sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))]) for s in names}
    upper, out = levels([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(by_source[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))):
            cut = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            folded = leaf(r | {"text": r["text"].replace("\n", "")}) if cut else leaf(r)
            siblings = [*path(trees[s], i), *path(upper, k)]
            for left, right in siblings:
                folded = merkle.h(left, folded, right)
            proof = merkle.h(*[x for pair in siblings for x in pair])
            out.append(tuple(x.decode() if isinstance(x, bytes) else x for x in (r["doc_id"], folded, leaf(r), proof, upper[-1][0], trees[s][-1][0], folded == upper[-1][0])))
    return sorted(out, key=str)


def test_same_rows_as_sql(spark, sf_dir, documents):
    assert spark_rows(merkle.build_manifest(documents)) == duck_rows(merkle.ORACLE_SQL, sf_dir)


def test_odd_rows(spark, odd, none):
    assert spark_rows(merkle.build_manifest(odd))[1] == plain_manifest([r.asDict() for r in odd.collect()])
    assert merkle.build_manifest(none).collect() == []


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3, 4], [9, 10, 1], [27, 28, 2, 1], [1] * 30])
def test_small_tiles_cover_every_shape(spark, sizes):
    """Tiles of 3 and leaf partitions of 9, so that small trees span many of both."""
    rows = [(100 * s + k, f"line {k}\nof {s}", "en", f"source {s:02}", k) for s, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert spark_rows(merkle.build_manifest(docs, 1, 2))[1] == plain_manifest([r.asDict() for r in docs.collect()])


def test_a_hot_source_over_several_levels_of_tiles(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('a', id, '\n') AS text", "'en' AS lang", "if(id % 3 = 0, cast(id AS string), 'hot') AS source", "id AS n_chars")
    got = spark_rows(merkle.build_manifest(docs))[1]
    assert got == plain_manifest([r.asDict() for r in docs.collect()])
    assert 0 < sum(r[-1] for r in got) < 3000


def test_missing_nodes_are_the_least_set():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 90)
        held = set(rng.sample(range(n), rng.randrange(1, n + 1)))
        missing = merkle.octopus(held, n, 0)
        assert len(set(missing)) == len(missing)
        have = {(0, i) for i in held} | set(missing)

        def derivable(have, n=n):
            have = set(have)
            for level in range(merkle.depth_of(n)):
                wide = merkle.width_of(n, level)
                have |= {(level + 1, p) for p in range(merkle.width_of(n, level + 1)) if all((level, c) in have for c in range(3 * p, min(3 * p + 3, wide)))}
            return have

        def proofs(have, n=n):
            full = derivable(have)
            return all((level, c) in full for i in held for level in range(merkle.depth_of(n)) for c in range(i // 3**level // 3 * 3, min(i // 3**level // 3 * 3 + 3, merkle.width_of(n, level))))

        assert proofs(have)
        assert all(not proofs(have - {m}) for m in missing)
