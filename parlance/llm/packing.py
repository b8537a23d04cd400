"""Best-fit packing with certified bin counts.

Documents' pieces are dealt to groups by hash and each group is packed by best-fit decreasing. Lower
bounds from dual feasible functions certify a group whose bin count cannot be less. Groups with a gap
give up the pieces of their bins that are not full, certified groups those of their least full bin;
these are dealt anew to groups of twice the size and packed again, and the new bins are taken where they are
fewer. Rounds end when the bound of all pieces is met, or when groups of the largest size bring nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents
from parlance.llm.tokens import encoder, tokenizer_path

CAPACITY = 2048
#: Pieces that a group aims at, and that groups grow to in exchange (what one task sorts at once).
GROUP, LARGEST = 2000, 64_000
#: Steps of the second family of bounds.
STEPS = 64


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Bins that any packing needs, by two families of dual feasible functions. The first counts a piece above capacity - k
    as a whole bin, drops pieces under k and leaves the rest, for k from 0 to capacity / 2. The second rounds a piece to
    steps: it counts floor((k + 1) * length / capacity) / k of a bin, or its own share where that division has no rest."""
    n = np.bincount(lengths, counts, capacity + 1)[: capacity + 1].astype(np.int64)
    length = np.arange(capacity + 1)
    count, total = np.cumsum(n), np.cumsum(n * length)
    k = np.arange(capacity // 2 + 1)
    big = count[-1] - count[capacity - k]
    middle = total[capacity - k] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    best = int(np.max(big + -(-middle // capacity)))
    for k in range(1, STEPS + 1):
        steps, rest = np.divmod((k + 1) * length, capacity)
        shares = np.where(rest == 0, k * length, capacity * steps)  # of capacity * k
        best = max(best, -(-int((n * shares).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each piece. Equal gaps: the bin that got it last."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: there is an open bin with gap g
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            stack = open_by_gap[gap]
            b = stack.pop()
            if not stack:
                gaps &= ~(1 << gap)
        else:
            gap, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > n:
            open_by_gap[gap - n].append(b)
            gaps |= 1 << (gap - n)
    return bins, offsets


def _pack_groups(rows: DataFrame, capacity: int, groups: int, seed: int, base: int) -> DataFrame:
    """Adds or replaces sequence_id, offset, fill (of the bin), least (of its group: the id of the least full bin), certified."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "piece_key"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        first = base + (int(group["pack_group"].iloc[0]) << 20)
        return group.assign(
            sequence_id=first + bins, offset=offsets, fill=fill[bins], least=first + int(np.argmin(fill)), certified=len(fill) <= lower_bound(lengths, capacity)
        )

    dealt = rows.withColumn("pack_group", F.pmod(F.xxhash64("piece_key", F.lit(seed)), F.lit(groups)))
    extra = ", sequence_id long, offset long, fill long, least long, certified boolean"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + extra
    return dealt.groupBy("pack_group").applyInPandas(pack, schema).drop("pack_group")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int | None = None) -> DataFrame:
    """pieces (piece_key: distinct long, length: 1 to capacity, other columns) with sequence_id and offset.

    Pieces of equal length are packed in the order of their keys. No pieces give an empty table. rounds: of exchange at
    most (None: until they bring nothing).
    """
    names = pieces.columns
    lengths = pieces.groupBy("length").count().toPandas()  # a row for each length up to capacity
    bound = lower_bound(lengths["length"].to_numpy(np.int64), capacity, lengths["count"].to_numpy(np.int64))
    size = group
    placed = cut(_pack_groups(pieces, capacity, max(1, -(-int(lengths["count"].sum()) // size)), 0, 0), "packed")
    done, full, k = [], 0, 0  # full: bins that are not exchanged any more
    while rounds is None or k < rounds:
        k += 1
        loose = (F.col("fill") < capacity) & (~F.col("certified") | (F.col("sequence_id") == F.col("least")))
        bins = placed.select("sequence_id", loose.alias("loose")).distinct().groupBy("loose").count().collect()
        found = {r["loose"]: r["count"] for r in bins}
        before = found.get(True, 0)
        if before < 2 or full + sum(found.values()) <= bound:
            break
        moving = placed.where(loose)
        size = min(2 * size, max(LARGEST, group))
        again = cut(_pack_groups(moving.select(*names), capacity, max(1, -(-moving.count() // size)), k, k << 48), "packed")
        if again.select("sequence_id").distinct().count() < before:
            done.append(placed.where(~loose))
            full += found.get(False, 0)
            placed = again
        elif size >= LARGEST or size >= moving.count():
            break
    for d in done:
        placed = placed.unionByName(d)
    return placed.select(*names, "sequence_id", "offset")


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b["text"].to_pylist()):
                ids = encode.ids(t or "") + tail
                n = len(ids) // 4
                at, k = 0, 0
                size = n % capacity or capacity  # the first piece is the short one
                while at < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k, size = at + size, k + 1, capacity
            table = pa.table({"doc_id": b["doc_id"].take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
            yield from table.to_batches()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its text's ids and the end id (a null or empty text: the end id alone). Only documents over
    capacity are cut, so that all pieces but the first are of that length. Repeated rows are packed each. Pieces
    are written to the shared folder, so texts are encoded once.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = d.mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    keyed = cut(pieces.withColumn("piece_key", F.monotonically_increasing_id()), "pieces")  # fixed by being written
    return pack(keyed, capacity).drop("piece_key")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
