"""Best-fit packing of token pieces into sequences of bounded length, large items first by matching.

Documents are tokenized where they lie and cut into pieces; only piece lengths move. Pieces are dealt into groups of a
few thousand by a hash, so that the number of groups follows the input and no group grows; each group is packed alone:

* pieces above a third of the capacity can share a bin with one other such piece at most, so they are matched greedily:
  the longest open one takes the longest other that still fits beside it;
* shorter pieces go, longest first, where the least room stays, and open a bin if they fit nowhere.

A group wastes about one bin. Bins are rows of equal length lists, so a lost executor only repeats its groups.

Defined results: a null or empty text is the end token alone; a text that holds the end token's string is encoded as the
tokenizer does it; texts of any length are cut into full pieces, the first taking the remainder; equal rows are packed
one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import persisted, pruned, struct
from .tokens import byte_bpe

CAPACITY = 2048
GROUP_PIECES = 4096
END = 0


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one, or full ones after a first that takes what is left."""
    n = len(ids)
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each piece."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: a bin with room r is open
    bins = 0

    def opened(room: int, b: int) -> None:
        nonlocal rooms
        open_bins[room].append(b)
        rooms |= 1 << room

    large = [i for i in order if 3 * lengths[i] > capacity]
    # greedy matching: by length, the longest partner that fits
    by_length: list[list[int]] = [[] for _ in range(capacity + 1)]
    held = 0
    for i in reversed(large):
        by_length[lengths[i]].append(i)
        held |= 1 << lengths[i]

    def take(n: int) -> int:
        nonlocal held
        i = by_length[n].pop()
        if not by_length[n]:
            held &= ~(1 << n)
        return i

    while held:
        i = take(held.bit_length() - 1)
        place[i], room = (bins, 0), capacity - lengths[i]
        if fits := held & ((1 << (room + 1)) - 1):
            j = take(fits.bit_length() - 1)
            place[j], room = (bins, lengths[i]), room - lengths[j]
        opened(room, bins)
        bins += 1
    for i in order[len(large) :]:
        n = lengths[i]
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        place[i] = (b, capacity - room)
        opened(room - n, b)
    return place


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length and the CRC of its token ids."""
    kind = dict(docs.dtypes)[id_col]
    schema = struct(f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END], dtype="<u4")
                    for k, (s, n) in enumerate(cut(ids, capacity)):
                        for column, value in zip(out, (i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    return pruned(docs, id=id_col, text=text_col).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with `id`, `piece` and `length`."""
    spark = pieces.sparkSession
    pieces = persisted(spark, pieces)
    groups = 1 + pieces.count() // group_pieces
    # the row's number, which stays as the rows are kept, parts rows that are equal in all else
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    schema = struct(pieces.schema.simpleString()[7:-1] + ", sequence_id bigint, offset bigint")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grp = table.column("grp")[0].as_py()
        table = table.drop_columns(["grp"]).sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        placed = pack(table.column("length").to_pylist(), capacity)
        table = table.append_column("sequence_id", pa.array([(grp << 32) + b for b, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.groupBy("grp").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    packed = pack_pieces(tokenize_pieces(docs, tokenizer_path, capacity), capacity)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
