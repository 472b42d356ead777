"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents (bounded in rows and words). Its words become numbers in the vocabulary of the
benchmark phrases; a word that no phrase holds can be in no occurrence, so only runs of known words, at least as long
as the shortest phrase, enter the index, each closed by a separator. The index is the Burrows-Wheeler transform of that
sequence in a wavelet tree: backward search narrows all phrases at once, a word a step, by two ranks a level, and the
rows found are located by walking to the nearest sampled suffix position. Occurrences are merged to spans of words.

The benchmark travels to the executors in blocks of bounded size, one pass a block; spans of several blocks are merged
by document. Memory is bounded by one shard and one block.

Defined results: null and empty texts and items without words take part in nothing; an item with fewer words than the
window is one phrase; items with equal phrases all count; a document of any length is searched whole (one that is
longer than a shard is a shard of its own); without items every document is clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import persisted, pruned, struct

WINDOW = 13
SHARD_WORDS, SHARD_ROWS = 1_500_000, 50_000
BLOCK_BYTES = 16_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of the class `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class Phrases:
    """The benchmark's windows as number sequences, grouped by length, with the items that hold each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], list] = {}
        for item, text in items:
            w = words_of(text)
            if w:
                for i in range(max(1, len(w) - window + 1)):
                    found.setdefault(tuple(w[i : i + window]), []).append(item)
        vocabulary = sorted({x for p in found for x in p})
        self.ids = {w: i + 2 for i, w in enumerate(vocabulary)}  # 0: the end, 1: a separator
        self.size = len(vocabulary) + 2
        by_length: dict[int, list] = {}
        for p, holders in found.items():
            by_length.setdefault(len(p), []).append(([self.ids[x] for x in p], sorted(set(holders), key=str)))
        self.groups = [(n, np.array([p for p, _ in ps], dtype=np.int64), [h for _, h in ps]) for n, ps in sorted(by_length.items())]
        self.least = min(by_length, default=0)


class WaveletTree:
    """Ranks over a number sequence: one bit vector a level, in wavelet-matrix order."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[np.ndarray, int]] = []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(np.int8)
            ones = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:], dtype=np.int32)
            zeros = len(values) - int(ones[-1])
            self.levels.append((ones, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        self.bits = bits

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often value stands before position at."""
        low, high = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(self.levels):
            one = ((value >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at a position, and how often it stands before."""
        value, low, high = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in self.levels:
            one = ones[high + 1] > ones[high]
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
            value = value * 2 + one
        return value, high - low


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffix positions of s in order, by doubling the compared length until all ranks differ."""
    n = len(s)
    rank, width = s.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (int(max(rank.max(), n)) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, s: np.ndarray, size: int, every: int = 8):
        """s ends with its only 0; size: numbers in the alphabet."""
        order = suffix_order(s)
        self.n = len(s)
        last = s[order - 1]  # the number before each suffix; before the first stands the end
        self.starts = np.searchsorted(s[order], np.arange(size + 1))
        self.tree = WaveletTree(last, max(1, int(size - 1).bit_length()))
        self.sampled = np.where(order % every == 0, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low[live], high[live] = self.starts[c] + self.tree.rank(c, low[live]), self.starts[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step backwards until a sampled one."""
        out, at, steps = np.empty(len(rows), dtype=np.int64), rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled[at[live]]
            done = known >= 0
            out[live[done]] = known[done] + steps[live[done]]
            live = live[~done]
            value, before = self.tree.access(at[live])
            at[live] = self.starts[value] + before
            steps[live] += 1
        return out


def occurrences(shard: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(global word position, phrase length, flat phrase number) of each occurrence in the shard's documents."""
    none = np.zeros(0, dtype=np.int64)
    if not phrases.least:
        return none, none, none
    get = phrases.ids.get
    known = np.fromiter((get(w, 1) for ws in shard for w in (*ws, b"")), dtype=np.int64, count=sum(len(ws) + 1 for ws in shard))
    # runs of known words, long enough for the shortest phrase
    inside = np.diff(np.concatenate([[0], (known > 1).view(np.int8), [0]]))
    begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    keep = end - begin >= phrases.least
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return none, none, none
    lengths = end - begin + 1  # with the separator, which stands at `end`
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    index = FMIndex(np.append(known[place], 0), phrases.size)
    found, base = [], 0
    for n, ps, _ in phrases.groups:
        low, high = index.search(ps)
        count = np.maximum(0, high - low)
        if total := int(count.sum()):
            which = np.repeat(np.arange(len(ps)), count)
            rows = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + low[which]
            found.append((place[index.locate(rows)], np.full(total, n), which + base))
        base += len(ps)
    if not found:
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list]]:
    """(number of words, merged spans [start, stop) of hit words, items) of each text."""
    shard = [words_of(t) for t in texts]
    sizes = np.array([len(ws) + 1 for ws in shard], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    at, length, which = occurrences(shard, phrases)
    out = [(len(ws), [], []) for ws in shard]
    if len(at):
        holders = [h for _, _, hs in phrases.groups for h in hs]
        order = np.argsort(at, kind="stable")
        at, length, which = at[order], length[order], which[order]
        doc = np.searchsorted(first, at, side="right") - 1
        for d in np.unique(doc):
            mine = doc == d if len(at) < 64 else slice(*np.searchsorted(doc, [d, d + 1]))
            spans: list[list[int]] = []
            for s, n in zip((at[mine] - first[d]).tolist(), length[mine].tolist()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s + n)
                else:
                    spans.append([s, s + n])
            out[d] = (len(shard[d]), [tuple(x) for x in spans], sorted({h for w in set(which[mine].tolist()) for h in holders[w]}, key=str))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: the id, n_words, n_hit, spans of hit words and the ids (as text) of items that occur."""
    spark = docs.sparkSession
    items = pruned(benchmark, item=item_col, text=item_text).select(F.col("item").cast("string").alias("item"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = 1 + total // BLOCK_BYTES  # a block's expected size is below the bound; phrases of a text are at most 13 x its words
    kind = dict(docs.dtypes)[id_col]
    keyed = blocks > 1  # passes are merged by row, as ids may be null or repeat
    schema = struct(f"{'row bigint, ' if keyed else ''}id {kind}, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, items array<string>")
    arrow = to_arrow_schema(schema)
    source = pruned(docs, id=id_col, text=text_col)
    if keyed:
        source = persisted(spark, source.select(F.monotonically_increasing_id().alias("row"), "id", "text"))

    def one_pass(block: int) -> DataFrame:
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])
        made: list[Phrases] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Phrases(sent.value, window))

            def answer(rows, texts):
                n, spans, names = zip(*search_shard(texts, made[0]))
                spans = [[{"start": a, "stop": b} for a, b in s] for s in spans]
                return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((*zip(*rows), n, spans, names), arrow)], schema=arrow)

            # a shard stays open across batches until it is full: phrases are searched once a shard
            ids, texts, size = [], [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    for *i, t in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns]):
                        n = len(t or "") // 4
                        if ids and (size + n > SHARD_WORDS or len(ids) >= SHARD_ROWS):
                            yield answer(ids, texts)
                            ids, texts, size = [], [], 0
                        ids.append(i)
                        texts.append(t)
                        size += n
            if ids:
                yield answer(ids, texts)

        return source.mapInArrow(run, schema)

    if blocks == 1:
        found = one_pass(0)
    else:
        parts = one_pass(0)
        for b in range(1, blocks):
            parts = parts.unionByName(one_pass(b).where(F.size("spans") > 0))
        merged = (
            persisted(spark, parts)
            .groupBy("row")
            .agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        )
        step = (
            "aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, x) -> CASE WHEN size(acc) > 0 AND x.start <= element_at(acc, -1).stop"
            " THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, x.stop))))"
            " ELSE concat(acc, array(x)) END)"
        )
        found = merged.withColumn("spans", F.expr(step))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["stop"] - x["start"])
    return found.select("id", "n_words", hit.alias("n_hit"), "spans", "items")


def is_contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs, benchmark)
    listed = F.array_sort("items")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract, plainly: for tests."""
    out = []
    phrases = []
    for item, text in items:
        w = words_of(text)
        if w:
            phrases += [(tuple(w[i : i + window]), str(item)) for i in range(max(1, len(w) - window + 1))]
    for doc, text in docs:
        w = words_of(text)
        hit, names = set(), set()
        for p, item in phrases:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    names.add(item)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
