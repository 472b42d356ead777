"""Phrase collocations from a weighted de Bruijn graph of words.

1. Bounds first: pairs of neighbouring words are counted by a hash of the two, then, where both pairs are left, triples. A
   hash seen less often than the least count is in no candidate; a collision only leaves more. The hashes left are sent as
   bit fields of fixed size, in which a collision again only leaves more.
2. Edges: every word starts one gram, the longest of up to five words of its piece in which all pairs and triples are left.
   Five words are an edge from the node of the first four to that of the last four; fewer are an ending, the correction for
   a start near the end of its piece or of what is left of it. Equal grams are counted before the shuffle.
3. Compaction: an edge is sent to the buckets of its two nodes, a node's bucket being that of its longest word. A node thus
   meets all its edges, and paths through nodes with one edge in and one out become one row: words and weights.
4. Flow: f of a node is the sum of its outgoing edges plus the endings that are that node. f of a shorter phrase is the
   sum over the phrases that prolong it by one word plus the endings that are that phrase, down to single words, whose sum
   over a language is n. All pairs and triples of a candidate and of its parts are left, so their counts are exact.
5. Candidates are cut in all places, the parts' counts joined by phrase; a candidate as frequent as one that holds it goes.
   It is enough to look at phrases one word longer: counts never grow with length.

Counts stay below 2^63; products are decimals of 38 digits.

Defined results: null and empty texts and pieces without words count for nothing; rows without a language are `und`;
equal rows count once each; ties in a language's order are told apart by the phrase; no documents give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import persisted, pruned, struct

LONGEST = 5
#: Lengths of the runs that are bounded before grams are counted.
RUNS = (2, 3)
LEAST = 100
TOP = 2000
#: Bits of a counted hash, and of the index into a field of frequent ones (8 MB).
HASH_BITS, FIELD_BITS = 40, 26
#: Edges of a bucket, on average; characters of a batch; distinct words and counted grams a task holds.
BUCKET_EDGES, BATCH, HELD_WORDS, HELD_GRAMS = 20_000, 4_000_000, 400_000, 2_000_000
# Where pieces end; the mark stands for it among words and is in no UTF-8 text.
_ENDS, _MARK = b".,;:!?\n\x0b\x0c\r", 0xFF
_FOLD = bytes(_MARK if c in _ENDS else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))
_SPLIT = bytes([32, _MARK, 32])
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def marked_words(text: str) -> list[bytes]:
    """Folded words with a mark wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(bytes([_MARK]), _SPLIT).split()


class Vocabulary:
    """Numbers of a language's words in one task; 0 is the mark."""

    def __init__(self):
        self.ids: dict[bytes, int] = {bytes([_MARK]): 0}
        self.hashes = np.zeros(1, dtype=np.uint64)

    def read(self, texts: list[str]) -> np.ndarray:
        """The numbers of all words of the texts, each text closed by a mark."""
        ids = self.ids
        out = []
        for text in texts:
            words = marked_words(text)
            for w in set(words):
                ids.setdefault(w, len(ids))
            out += map(ids.__getitem__, words)
            out.append(0)
        if len(ids) > len(self.hashes):
            fresh = list(ids)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, fresh), dtype=np.uint64, count=len(fresh))])
        return np.array(out, dtype=np.int64)

    def runs(self, words: np.ndarray, lang: str) -> Iterator[np.ndarray]:
        """Hashes of the pair and of the triple that each word starts."""
        h = self.hashes[words]
        pair = _mixed((h[:-1] * _FACTORS[0] + np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))) ^ h[1:])
        yield pair
        yield _mixed(pair[:-1] * _FACTORS[0] ^ h[2:])

    def left(self, words: np.ndarray, lang: str, fields: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, which are left) of pairs, then triples: by their field, or of the last ones, which have none yet, those
        of which all shorter runs are left."""
        out, possible = [], (words[:-1] > 0) & (words[1:] > 0)
        for run, field in zip(self.runs(words, lang), [*fields, None]):
            if field is not None:
                bit = run >> np.uint64(64 - FIELD_BITS)
                possible = possible & ((field[bit >> np.uint64(6)].view(np.uint64) >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            out.append((run, possible))
            possible = possible[:-1] & possible[1:]
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _FACTORS[1]
    return x ^ (x >> np.uint64(32))


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time, about BATCH characters of them."""
    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    held_size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for lang, text in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns]):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                held_size += len(text)
                if size[lang] >= BATCH or held_size >= 4 * BATCH:
                    most = max(size, key=size.get)
                    held_size -= size.pop(most)
                    yield most, held.pop(most)
    yield from held.items()


def frequent_runs(texts: DataFrame, least: int, fields: list[np.ndarray]) -> np.ndarray:
    """The bit field of hashes seen at least `least` times, of runs one word longer than those of the last field (of pairs
    without one)."""
    schema = struct("run bigint, n bigint")
    arrow = to_arrow_schema(schema)
    sent = texts.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: dict[str, Vocabulary] = {}
        for lang, texts in _by_language(batches):
            vocabulary = vocabularies.setdefault(lang, Vocabulary())
            hashes, asked = vocabulary.left(vocabulary.read(texts), lang, sent.value)[-1]
            found, n = np.unique(hashes[asked] >> np.uint64(64 - HASH_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], schema=arrow)
            if sum(len(v.ids) for v in vocabularies.values()) > HELD_WORDS:
                vocabularies.clear()

    often = texts.mapInArrow(run, schema).groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bits = often.select(F.shiftright("run", HASH_BITS - FIELD_BITS).alias("bit"))
    lines = bits.groupBy(F.shiftright("bit", 6).cast("int").alias("line")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits"))
    field = np.zeros(1 << (FIELD_BITS - 6), dtype=np.int64)
    for r in lines.toLocalIterator():
        field[r.line] = r.bits
    return field


def count_runs(texts: DataFrame, fields: list[np.ndarray]) -> DataFrame:
    """lang, gram (words joined by a space), size, n: the gram that each word starts, given the fields of pairs and triples."""
    schema = struct("lang string, gram string, size int, n bigint")
    arrow = to_arrow_schema(schema)
    sent = texts.sparkSession.sparkContext.broadcast(fields)

    def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows of five numbers below 2^31 with their counts; the last column is a count."""
        packed = [(keys[:, 0] << 31) | keys[:, 1], (keys[:, 2] << 31) | keys[:, 3], keys[:, 4]]
        order = np.lexsort(packed)
        first = np.ones(len(order), dtype=bool)
        if len(order):
            first[1:] = np.any([p[order][1:] != p[order][:-1] for p in packed], axis=0)
        at = np.flatnonzero(first)
        return keys[order[at], :5], np.add.reduceat(keys[order, 5], at) if len(at) else np.zeros(0, dtype=np.int64)

    class Grams:
        """What a task has counted for one language."""

        def __init__(self):
            self.vocabulary, self.parts, self.rows = Vocabulary(), [], 0
            self.single = np.zeros(0, dtype=np.int64)

        def add(self, texts: list[str], lang: str) -> None:
            words, n = self.vocabulary.read(texts), len(self.vocabulary.ids)
            pair, triple = (np.zeros(len(words) + LONGEST, dtype=bool) for _ in range(2))
            for kept, (_, left) in zip((pair, triple), self.vocabulary.left(words, lang, sent.value)):
                kept[: len(left)] = left
            at = np.arange(len(words))
            four = triple[at] & triple[at + 1]
            size = (words > 0).astype(np.int64) + pair[at] + triple[at] + four + (four & triple[at + 2])
            if n > len(self.single):
                self.single = np.concatenate([self.single, np.zeros(n - len(self.single), dtype=np.int64)])
            self.single[:n] += np.bincount(words[size == 1], minlength=n)
            starts = np.flatnonzero(size > 1)
            grams = np.zeros((len(starts), LONGEST + 1), dtype=np.int64)
            grams[:, LONGEST] = 1
            for k in range(LONGEST):
                here = size[starts] > k
                grams[here, k] = words[starts[here] + k]
            self.parts.append(counted_rows(grams))
            self.rows += len(self.parts[-1])
            if self.rows > HELD_GRAMS:
                self.parts = [counted_rows(np.concatenate(self.parts))]
                self.rows = len(self.parts[0])

        def flush(self, lang: str) -> Iterator[pa.RecordBatch]:
            names = list(self.vocabulary.ids)
            one = np.flatnonzero(self.single)
            yield rows(lang, [names[i] for i in one.tolist()], np.ones(len(one), dtype=np.int32), self.single[one])
            every = counted_rows(np.concatenate(self.parts)) if self.parts else np.zeros((0, 6), dtype=np.int64)
            for at in range(0, len(every), 100_000):
                part = every[at : at + 100_000]
                sizes = (part[:, :5] > 0).sum(axis=1)
                yield rows(lang, [b" ".join([names[i] for i in g[:k]]) for g, k in zip(part[:, :5].tolist(), sizes.tolist())], sizes.astype(np.int32), part[:, 5])

    def counted_rows(keys: np.ndarray) -> np.ndarray:
        distinct, n = counted(keys)
        return np.concatenate([distinct, n[:, None]], axis=1)

    def rows(lang: str, grams: list[bytes], sizes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), type=pa.string()), pa.array(grams, type=pa.binary()).cast(pa.string()), pa.array(sizes), pa.array(n)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Grams] = {}
        for lang, texts in _by_language(batches):
            held.setdefault(lang, Grams()).add(texts, lang)
            if sum(len(g.vocabulary.ids) for g in held.values()) > HELD_WORDS or sum(g.rows for g in held.values()) > HELD_GRAMS:
                for k, g in held.items():
                    yield from g.flush(k)
                held.clear()
        for k, g in held.items():
            yield from g.flush(k)

    return texts.mapInArrow(run, schema).groupBy("lang", "gram", "size").agg(F.sum("n").alias("n"))


def _bucket(node, buckets: int):
    """That of the node's longest word, ties by the greater word: long words are rare, so buckets stay even."""
    word = F.array_max(F.transform(node, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    return F.pmod(F.xxhash64("lang", word), F.lit(buckets)).cast("int")


def compact_paths(edges: DataFrame, buckets: int) -> DataFrame:
    """lang, words, weights: the edges (lang, gram, n) as paths through nodes with one edge in and one out.

    weights[k] belongs to the edge from words[k..k+4). Each edge is in exactly one path, that of its first node's bucket.
    """
    words = F.split("gram", " ", -1)
    both = edges.select("lang", words.alias("w"), "n")
    from_, to = _bucket(F.slice("w", 1, LONGEST - 1), buckets), _bucket(F.slice("w", 2, LONGEST - 1), buckets)
    sent = both.withColumn("at", from_).withColumn("to", to).withColumn("bucket", F.explode(F.array_distinct(F.array("at", "to"))))
    sent = sent.select("bucket", "lang", "w", "n", (F.col("at") == F.col("bucket")).alias("starts"), (F.col("to") == F.col("bucket")).alias("ends"))
    ddl = struct("lang string, words array<string>, weights array<bigint>")
    schema = to_arrow_schema(ddl)

    def run(group: pa.Table) -> pa.Table:
        langs, grams, weights, starts, ends = (group[c].to_pylist() for c in ("lang", "w", "n", "starts", "ends"))
        before: dict[tuple, list[int]] = {}
        after: dict[tuple, list[int]] = {}
        for k, (lang, g) in enumerate(zip(langs, grams)):
            if starts[k]:
                after.setdefault((lang, *g[:-1]), []).append(k)
            if ends[k]:
                before.setdefault((lang, *g[1:]), []).append(k)
        nodes = {v: (before[v][0], out[0]) for v, out in after.items() if len(out) == 1 and len(before.get(v, ())) == 1}
        follows = {a: b for a, b in nodes.values()}
        entered = set(follows.values())
        done, paths = set(), []

        def walk(k: int) -> None:
            path = []
            while k is not None and k not in done:
                done.add(k)
                path.append(k)
                k = follows.get(k)
            mine = path if starts[path[0]] else path[1:]  # an edge of another bucket's node only leads in
            if mine:
                paths.append((langs[mine[0]], [*grams[mine[0]], *(grams[j][-1] for j in mine[1:])], [weights[j] for j in mine]))

        for k in range(len(grams)):
            if k not in entered:
                walk(k)
        for k in range(len(grams)):  # what is left are circles
            if k not in done:
                walk(k)
        columns = list(zip(*paths)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return sent.groupBy("bucket").applyInArrow(run, ddl)


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of one to five words seen at least `least` times, and (lang, n)."""
    spark = docs.sparkSession
    texts = pruned(docs, lang=lang_col, text=text_col).where("length(text) > 0").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    fields: list[np.ndarray] = []
    for _ in RUNS:
        fields.append(frequent_runs(texts, least, fields))
    runs = persisted(spark, count_runs(texts, fields))
    edges, endings = runs.where(F.col("size") == LONGEST), runs.where(F.col("size") < LONGEST)
    paths = persisted(spark, compact_paths(edges, max(32, edges.count() // BUCKET_EDGES)))
    every = F.sequence(F.lit(0), F.size("weights") - 1)
    along = paths.select("lang", F.explode(F.transform(every, lambda k: F.struct(F.slice("words", k + 1, LONGEST).alias("w"), F.element_at("weights", k + 1).alias("f")))).alias("e"))
    flow = along.select("lang", "e.w", "e.f")
    found = [flow.where(F.col("f") >= least).select("lang", F.concat_ws(" ", "w").alias("phrase"), F.lit(LONGEST).alias("size"), "f")]
    ending = endings.select("lang", F.split("gram", " ", -1).alias("w"), F.col("n").alias("f"))
    for size in range(LONGEST - 1, 0, -1):
        prolonged = flow.select("lang", F.slice("w", 1, size).alias("w"), "f")
        ended = ending.where(F.size("w") == size).select("lang", "w", "f")
        flow = persisted(spark, prolonged.unionByName(ended).groupBy("lang", "w").agg(F.sum("f").alias("f")))
        found.append(flow.where(F.col("f") >= least).select("lang", F.concat_ws(" ", "w").alias("phrase"), F.lit(size).alias("size"), "f"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return persisted(spark, out), flow.groupBy("lang").agg(F.sum("f").alias("n"))


def score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits: exact for counts up to 10^17."""
    wide = [c.cast("decimal(19,0)") for c in (a, n, l, r)]
    above = F.lit(1000).cast("decimal(4,0)") * (wide[0] * wide[1]).cast("decimal(34,0)")
    return F.call_function("div", above, (wide[2] * wide[3]).cast("decimal(38,0)"))


def mine_collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    counts, totals = phrase_counts(docs, least)
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    w = F.split("phrase", " ", -1)
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(w, k + 1, F.col("size") - k), " ").alias("rest")))
    cut = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    shorter = F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("size") - 1), " ")))
    held = candidates.where("size > 2").select("lang", shorter.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, range(1, 6) AS s(size) WHERE len(w) >= size)
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 100
), cuts AS (
  SELECT lang, phrase, size, a, k, array_to_string(w[:k], ' ') AS first_part, array_to_string(w[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first_part JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.phrase <> b.phrase AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept) WHERE rank <= 2000
"""
