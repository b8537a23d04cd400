"""Token ids as Arrow stream files of equal-length sequences.

Documents' ids are laid end to end in the order of doc_id, and cut into sequences of a fixed width. Each
block of documents is one Arrow IPC file (the stream format with a footer): record batches of two
fixed-size lists, ids and mask (1 for ids, 0 for padding after a block's last). Because every list has the
same width, sequence k of a mapped file is a slice at a computed place and nothing is copied. A second
small file per block says where each document begins.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, shared_dir
from parlance.llm.tokens import encoder, tokenizer_path

WIDTH = 2048
#: Sequences in a record batch, and documents that a block (a task's file) aims at.
BATCH, BLOCK_DOCS = 256, 4000


def _encode(path: str, spaced: bool, end: int, dtype: str, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced)
        starts = np.array(bounds, np.int64)
        for b in batches:
            block = np.searchsorted(starts, b["doc_id"].fill_null(-(1 << 63)).to_numpy(), "right")
            ids = [np.append(np.frombuffer(encode.ids(t or ""), "<u4"), np.uint32(end)).astype(dtype).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.binary()), pa.array(block, pa.int64())], names=["doc_id", "ids", "block"])

    return run


def _open(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    return store, path


def _publish(store, path: str, write) -> None:
    """Write to a name of this attempt's own, then rename: a retried or speculative task does no harm."""
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(mine) as out:
        write(out)
    store.move(mine, path)


def _sequences(pieces: Iterator[np.ndarray], dtype: str, width: int, batch: int) -> Iterator[pa.RecordBatch]:
    """Batches of (ids, mask); the last is padded with zeros to whole sequences."""
    held, n, most = [], 0, width * batch

    def emit(flat: np.ndarray) -> pa.RecordBatch:
        rows = -(-len(flat) // width)
        ids, mask = np.zeros(rows * width, dtype), np.zeros(rows * width, np.uint8)
        ids[: len(flat)], mask[: len(flat)] = flat, 1
        return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), width) for x in (ids, mask)], names=["ids", "mask"])

    for p in pieces:
        held.append(p)
        n += len(p)
        if n >= most:
            flat = np.concatenate(held)
            for i in range(0, n - n % most, most):
                yield emit(flat[i : i + most])
            held, n = [flat[n - n % most :].copy()], n % most
    if n:
        yield emit(np.concatenate(held))


def _write_blocks(folder: str, dtype: str, width: int, batch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        rows = ((b["block"][i].as_py(), b["doc_id"][i].as_py(), b["ids"][i].as_py()) for b in batches for i in range(b.num_rows))
        row = next(rows, None)
        kind = pa.from_numpy_dtype(np.dtype(dtype))
        schema = pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.uint8(), width))])
        while row:
            block, doc_ids, lengths = row[0], [], []

            def pieces(block=block, doc_ids=doc_ids, lengths=lengths):
                nonlocal row
                while row and row[0] == block:
                    ids = np.frombuffer(row[2], dtype)
                    doc_ids.append(row[1])
                    lengths.append(len(ids))
                    row = next(rows, None)
                    yield ids

            def write(out):
                with pa.ipc.new_file(out, schema) as f:
                    for b in _sequences(pieces(), dtype, width, batch):
                        f.write_batch(b)

            _publish(store, f"{top}/ids-{block:08d}.arrow", write)
            index = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(lengths, pa.int64())})

            def write_index(out, index=index):
                with pa.ipc.new_file(out, index.schema) as f:
                    f.write_table(index)

            _publish(store, f"{top}/docs-{block:08d}.arrow", write_index)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sum(lengths)], pa.int64())], names=["block", "n_tokens"])

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, spaced: bool, end: int, dtype: str = "<u4", width: int = WIDTH, batch: int = BATCH, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """Write docs to folder (a URI that all executors reach) and return the manifest: block, n_tokens, start
    (ids of all blocks before it).

    Documents lie in ascending order of key; a null key comes first, equal keys follow the order of their ids. A
    null or empty text is the end id alone. dtype: what ids are stored as; it must hold the vocabulary. Blocks are
    ranges of keys with about block_docs documents each. An empty table writes no file.
    """
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = d.count()
    # Beyond so many files they grow instead; a task streams through its block, whatever its size.
    parts = max(1, min(20_000, -(-n // block_docs)))
    # Bounds of ranges only: the order within and between them is exact.
    cuts = d.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = sorted(set(cuts or []))
    encoded = d.mapInArrow(_encode(tokenizer, spaced, end, dtype, bounds), "doc_id long, ids binary, block long")
    dealt = encoded.repartition(len(bounds) + 1, "block").sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "ids")
    _make(docs.sparkSession, folder)
    manifest = cut(dealt.mapInArrow(_write_blocks(folder, dtype, width, batch), "block long, n_tokens long"), "manifest")
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _make(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def read_sequences(store, path: str) -> pa.RecordBatchFileReader:
    """The file's batches; on a local or mounted store its pages are mapped, not copied."""
    return pa.ipc.open_file(pa.memory_map(path) if store.type_name == "local" else store.open_input_file(path))


def sequence(reader: pa.RecordBatchFileReader, k: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the file's sequence k, as views of the mapped file."""
    part = reader.get_batch(k // batch)
    return tuple(part[c].slice(k % batch, 1).flatten().to_numpy() for c in ("ids", "mask"))


def _read_blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(folder)
        for b in batches:
            for block, start in zip(b["block"].to_pylist(), b["start"].to_pylist(), strict=True):
                index = read_sequences(store, f"{top}/docs-{block:08d}.arrow").read_all()
                n_tokens = index["n_tokens"].to_numpy()
                starts = np.concatenate(([0], np.cumsum(n_tokens)))
                crcs, held, doc = [], 0, 0
                sequences = read_sequences(store, f"{top}/ids-{block:08d}.arrow")
                for k in range(sequences.num_record_batches):
                    part = sequences.get_batch(k)
                    real = part["mask"].flatten().to_numpy().view(bool)
                    ids = part["ids"].flatten().to_numpy()[real]
                    at = 0
                    while at < len(ids):
                        # The next stretch of this document in this batch.
                        left = int(starts[doc + 1] - starts[doc]) - held
                        some = ids[at : at + left]
                        if held == 0:
                            crcs.append(0)
                        crcs[-1] = zlib.crc32(some.astype("<u4").tobytes(), crcs[-1])
                        at, held = at + len(some), held + len(some)
                        if len(some) == left:
                            doc, held = doc + 1, 0
                yield pa.RecordBatch.from_arrays(
                    [index["doc_id"].combine_chunks(), pa.array(start + starts[:-1], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    files = max(1, manifest.count())
    return manifest.select("block", "start").repartition(files, "block").mapInArrow(_read_blocks(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    # The vocabulary of 49,408 fits 16 bits.
    manifest = write_token_files(documents(spark, sf_dir), folder, tokenizer_path("word_bpe_49k.json"), spaced=False, end=2, dtype="<u2")
    return read_token_files(manifest, folder)
