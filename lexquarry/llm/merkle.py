"""Merkle manifest of a dataset: ternary trees of document leaves by source, a tree of their roots above, octopus proofs.

Documents are hashed where they are read, so only digests are shuffled. Leaves get their place in the order of source and
id by a range sort and the sizes of its partitions. A tile is 3^6 consecutive leaves of a source; a leaf partition is a
run of whole tiles, about 3^8 leaves of whichever sources, so a source that holds a third of all rows is spread over many
partitions and a thousand small ones share one.

1. Each leaf partition reduces its tiles to one node each. The nodes above are built tile by tile in the same way, one
   round for six levels, until each source has its subroot; the subroots are the leaves of the upper tree.
2. Octopus multiproof: from the coordinates of what it holds, a leaf partition works out the least set of nodes that all
   its proofs together still need: at each level the siblings that it neither holds nor can derive from nodes below. They
   are fetched once, in one join for all partitions. From them and its leaves it derives the interior nodes that its
   proofs share, up to the root, and expands every document's own proof locally.

Verification folds the root again from the tampered leaf and the siblings of the untampered proof. A leaf that tampering
leaves as it is folds to the root that its partition derived.

Defined results: every row is a leaf; rows that share an id are ordered by leaf, rows without one come before the others
and are not tampered with; null parts are `-`; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import persisted, pruned, struct

ARITY = 3
#: Levels of a tile, and those that a leaf partition would fill.
TILE_LEVELS, PARTITION_LEVELS = 6, 8
#: The number of the upper tree; sources are numbered from 0 in their order.
UPPER = -1


def h(*parts: bytes) -> bytes:
    """H over digests given as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf(*values: Column) -> Column:
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def depth_of(n: int) -> int:
    """Levels above n leaves: each run of at most three becomes a node while several nodes remain."""
    depth = 0
    while n > 1:
        n, depth = -(-n // ARITY), depth + 1
    return depth


def width_of(n: int, level: int) -> int:
    return -(-n // ARITY**level)


def reduce_tile(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The digests and the `levels` levels above them."""
    rows = [digests]
    for _ in range(levels):
        below = rows[-1]
        rows.append([h(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return rows


def octopus(held: set[int], n: int, level: int) -> list[tuple[int, int]]:
    """(level, idx) of the nodes missing to derive the root of a tree of n leaves from the held nodes of one level."""
    missing = []
    for at in range(level, depth_of(n)):
        above, wide = {i // ARITY for i in held}, width_of(n, at)
        missing += [(at, c) for p in sorted(above) for c in range(ARITY * p, min(ARITY * p + ARITY, wide)) if c not in held]
        held = above
    return missing


def _table(rows, schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def _in_order(group: pa.Table, *by: str) -> list[dict]:
    return group.sort_by([(b, "ascending") for b in by]).to_pylist()


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with its `rank` from 0 in a total order: a range sort, and the sizes of its partitions, one row each, added up."""
    parts = persisted(df.sparkSession, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = parts.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("rank", place).drop("__part", "__before", "__id")


def place_leaves(docs: DataFrame, tile_levels: int = TILE_LEVELS, partition_levels: int = PARTITION_LEVELS) -> DataFrame:
    """doc_id, leaf, tampered (null if tampering leaves it as it is), tree, n, idx and the leaf partition `block`."""
    d = pruned(docs, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    other = F.when(cut != F.col("text"), leaf(d.doc_id, d.source, d.lang, d.n_chars, cut))
    leaves = persisted(docs.sparkSession, d.select("doc_id", "source", leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text).alias("leaf"), other.alias("tampered")))
    leaves = ranked(leaves, "source", "doc_id", "leaf")
    trees = ranked(leaves.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "source").select(F.col("source").alias("named"), F.col("rank").alias("tree"), "first", "n")
    placed = leaves.join(trees, leaves["source"].eqNullSafe(trees["named"])).withColumn("idx", F.col("rank") - F.col("first"))
    tile = F.floor(F.col("idx") / ARITY**tile_levels)
    return placed.withColumn("block", F.floor((F.col("first") + tile * ARITY**tile_levels) / ARITY**partition_levels)).select("doc_id", "leaf", "tampered", "tree", "n", "idx", "block")


def _tiles(leaves: list[dict], tile_levels: int):
    """(tree, n, tile, leaves, rows of its levels) of each tile among a partition's leaves in order."""
    at, size = 0, ARITY**tile_levels
    while at < len(leaves):
        first, to = leaves[at], at
        tile = first["idx"] // size
        while to < len(leaves) and leaves[to]["tree"] == first["tree"] and leaves[to]["idx"] // size == tile:
            to += 1
        yield first["tree"], first["n"], tile, leaves[at:to], reduce_tile([x["leaf"].encode() for x in leaves[at:to]], min(tile_levels, depth_of(first["n"])))
        at = to


def tile_roots(leaves: DataFrame, tile_levels: int = TILE_LEVELS) -> DataFrame:
    """One node for each tile: block, tree, n, level (tile_levels, or the depth of a smaller tree), idx, digest."""
    ddl = struct("block bigint, tree bigint, n bigint, level int, idx bigint, digest string")
    schema = to_arrow_schema(ddl)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        return _table([(key[0].as_py(), tree, n, len(rows) - 1, tile, rows[-1][0].decode()) for tree, n, tile, _, rows in _tiles(_in_order(group, "tree", "idx"), tile_levels)], schema)

    return leaves.select("block", "tree", "n", "idx", "leaf").groupBy("block").applyInArrow(run, ddl)


def grow(nodes: DataFrame, level: int, tile_levels: int = TILE_LEVELS) -> list[DataFrame]:
    """Every node (tree, n, level, idx, digest) above the given ones of one level, in rounds of tile_levels levels."""
    ddl = struct("tree bigint, n bigint, level int, idx bigint, digest string")
    schema = to_arrow_schema(ddl)
    most, rounds = depth_of(nodes.agg(F.max("n")).first()[0] or 0), []

    def rise(level: int):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            below = _in_order(group, "idx")
            tree, tile, n = key[0].as_py(), key[1].as_py(), below[0]["n"]
            rows = reduce_tile([x["digest"].encode() for x in below], min(tile_levels, depth_of(n) - level))
            return _table([(tree, n, level + k, tile * ARITY ** (tile_levels - k) + i, d.decode()) for k, row in enumerate(rows) if k for i, d in enumerate(row)], schema)

        return run

    while level < most:
        open_nodes = nodes.where((F.col("level") == level) & (F.col("n") > ARITY**level)).select("tree", "n", "idx", "digest")
        nodes = persisted(nodes.sparkSession, open_nodes.groupBy("tree", F.floor(F.col("idx") / ARITY**tile_levels).alias("tile")).applyInArrow(rise(level), ddl))
        rounds.append(nodes)
        level += tile_levels
    return rounds


def fetch_missing(tiles: DataFrame, nodes: DataFrame, sources: int) -> DataFrame:
    """What each leaf partition lacks for all its proofs together: block, tree, level, idx, digest."""
    ddl = struct("block bigint, tree bigint, level int, idx bigint")
    schema = to_arrow_schema(ddl)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        held: dict[tuple[int, int, int], set[int]] = {}
        for x in group.to_pylist():
            held.setdefault((x["tree"], x["n"], x["level"]), set()).add(x["idx"])
        out = [(key[0].as_py(), tree, *at) for (tree, n, level), ids in held.items() for at in octopus(ids, n, level)]
        return _table(out + [(key[0].as_py(), UPPER, *at) for at in octopus({tree for tree, _, _ in held}, sources, 0)], schema)

    return tiles.select("block", "tree", "n", "level", "idx").groupBy("block").applyInArrow(run, ddl).join(nodes, ["tree", "level", "idx"])


def _derive(known: dict, tree: int, ids: set[int], level: int, depth: int) -> bytes:
    """Adds the nodes above the held ones to known, up to the root, which it returns."""
    for at in range(level, depth):
        ids = {i // ARITY for i in ids}
        for p in ids:
            known[tree, at + 1, p] = h(*[d for c in range(ARITY * p, ARITY * p + ARITY) if (d := known.get((tree, at, c)))])
    return known[tree, depth, 0]


def _siblings(known: dict, tree: int, idx: int, level: int, depth: int) -> list[tuple[bytes, bytes]]:
    """(left siblings, right siblings) of each level from a node up to its root."""
    out = []
    for at in range(level, depth):
        p = idx // ARITY
        run = [(c, known.get((tree, at, c), b"")) for c in range(ARITY * p, ARITY * p + ARITY)]
        out.append((b"".join(d for c, d in run if c < idx), b"".join(d for c, d in run if c > idx)))
        idx = p
    return out


def build_manifest(docs: DataFrame, tile_levels: int = TILE_LEVELS, partition_levels: int = PARTITION_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row a document."""
    spark = docs.sparkSession
    leaves = place_leaves(docs, tile_levels, partition_levels)
    tiles = persisted(spark, tile_roots(leaves, tile_levels))
    nodes = [tiles.drop("block"), *grow(tiles.drop("block"), tile_levels, tile_levels)]
    every = reduce(DataFrame.unionByName, nodes)
    depth = sum((F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(39)), F.lit(0))
    subroots = persisted(spark, every.where(F.col("level") == depth).select(F.lit(UPPER).cast("bigint").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "digest"))
    sources = subroots.count()
    upper = subroots.withColumn("n", F.lit(sources).cast("bigint"))
    every = reduce(DataFrame.unionByName, [every, upper, *grow(upper, 0, tile_levels)]).select("tree", "level", "idx", "digest")
    fetched = fetch_missing(tiles, every, sources)
    kind = dict(docs.dtypes)["doc_id"]
    ddl = struct(f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    schema = to_arrow_schema(ddl)
    top = depth_of(sources)

    def expand(mine: pa.Table, missing: pa.Table) -> pa.Table:
        known = {(x["tree"], x["level"], x["idx"]): x["digest"].encode() for x in missing.to_pylist()}
        tiles, held = [], {}
        for tree, n, tile, own, rows in _tiles(_in_order(mine, "tree", "idx"), tile_levels):
            known[tree, len(rows) - 1, tile] = rows[-1][0]
            held.setdefault((tree, n, len(rows) - 1), set()).add(tile)
            tiles.append((tree, n, tile, own, rows))
        for (tree, n, level), ids in held.items():
            known[UPPER, 0, tree] = _derive(known, tree, ids, level, depth_of(n))
        root = _derive(known, UPPER, {tree for tree, _, _ in held}, 0, top)
        out = []
        for tree, n, tile, own, rows in tiles:
            shared = _siblings(known, tree, tile, len(rows) - 1, depth_of(n)) + _siblings(known, UPPER, tree, 0, top)
            ending, subroot = b"".join(s for pair in shared for s in pair), known[UPPER, 0, tree].decode()
            for i, x in enumerate(own):
                path, at = [], i
                for row in rows[:-1]:
                    p = at - at % ARITY
                    path.append((b"".join(row[p:at]), b"".join(row[at + 1 : p + ARITY])))
                    at //= ARITY
                folded = root
                if x["tampered"] is not None:
                    folded = x["tampered"].encode()
                    for left, right in (*path, *shared):
                        folded = h(left, folded, right)
                proof = h(*[s for pair in path for s in pair], ending)
                out.append((x["doc_id"], x["leaf"], subroot, root.decode(), proof.decode(), folded.decode(), folded == root))
        return _table(out, schema)

    return leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(expand, ddl)


_SQL_PART = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _SQL_PART + ")"
ORACLE_SQL = f"""
WITH RECURSIVE coded AS (
  SELECT *, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), 4294967295::BIGINT) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source, {_SQL_LEAF.format("text")} AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN {_SQL_LEAF.format("replace(text, chr(10), '')")} ELSE {_SQL_LEAF.format("text")} END AS tampered
  FROM coded
), placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM leaves
), low AS (
  SELECT tree, 0 AS lvl, pos AS idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, lvl, idx // 3
), subroots AS (
  SELECT tree, lvl AS depth, digest, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, tree AS idx, digest, n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, idx // 3
), steps AS (
  SELECT p.rid, l.lvl AS step, coalesce(string_agg(l.digest, '' ORDER BY l.idx) FILTER (WHERE l.idx < p.pos // (3 ** l.lvl)::BIGINT), '') AS before,
    coalesce(string_agg(l.digest, '' ORDER BY l.idx) FILTER (WHERE l.idx > p.pos // (3 ** l.lvl)::BIGINT), '') AS after
  FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.idx // 3 = p.pos // (3 ** l.lvl)::BIGINT // 3 GROUP BY p.rid, l.lvl
  UNION ALL
  SELECT p.rid, s.depth + u.lvl, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (WHERE u.idx < p.tree // (3 ** u.lvl)::BIGINT), ''),
    coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (WHERE u.idx > p.tree // (3 ** u.lvl)::BIGINT), '')
  FROM placed p JOIN subroots s ON s.tree = p.tree JOIN high u ON u.n > 1 AND u.idx // 3 = p.tree // (3 ** u.lvl)::BIGINT // 3 GROUP BY p.rid, s.depth, u.lvl
), folds AS (
  SELECT rid, 0 AS step, tampered AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.before || f.digest || s.after) FROM folds f JOIN steps s ON s.rid = f.rid AND s.step = f.step
), proofs AS (
  SELECT rid, sha256(string_agg(before || after, '' ORDER BY step)) AS proof, max(step) + 1 AS last FROM steps GROUP BY rid
)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree CROSS JOIN (SELECT digest FROM high WHERE n = 1) r LEFT JOIN proofs q ON q.rid = p.rid
JOIN folds f ON f.rid = p.rid AND f.step = coalesce(q.last, 0)
"""
