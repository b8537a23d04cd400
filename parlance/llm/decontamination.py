"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The windows of the benchmark's items are gathered on the driver in blocks of a bounded size, each block
is broadcast and all documents are scanned against it: words become ids of the block's vocabulary,
only stretches that are wholly in the vocabulary can hold a window, and those are looked up by their
exact ids (so a hit needs no further proof). A benchmark of more than one block is scanned in one pass
per block, the rows being written to the shared folder in between; nothing is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import cut, documents, free_name

WINDOW = 13
#: Bytes of item text whose windows are broadcast at once: some 100 MB in each Python worker.
BLOCK_BYTES = 4_000_000

#: Bytes that separate words become a space, A-Z becomes a-z; bytes of characters past ASCII stay.
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD or b > 127 else 32 for b in range(256))
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Windows:
    """Windows of some items: vocabulary, and by length the items of each window's ids."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[bytes, tuple[str, ...]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if n := min(width, len(ids)):
                found = self.by_length.setdefault(n, {})
                for i in range(len(ids) - n + 1):
                    key = ids[i : i + n].tobytes()
                    known = found.setdefault(key, ())
                    if item is not None and item not in known:
                        found[key] = (*known, item)

    def scan(self, text: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """Number of words, which of them are hit (None: none), items found."""
        known = self.vocabulary.get
        ids = np.array([known(w, 0) for w in words(text)], np.int32)
        hit, items = None, set()
        run = np.concatenate(([0], np.cumsum(ids > 0)))
        for n, windows in self.by_length.items():
            if len(ids) < n:
                continue
            for i in np.flatnonzero(run[n:] - run[:-n] == n):
                if (at := windows.get(ids[i : i + n].tobytes())) is not None:
                    if hit is None:
                        hit = np.zeros(len(ids), bool)
                    hit[i : i + n] = True
                    items.update(at)
        return len(ids), hit, items


def _spans(hit: np.ndarray | None) -> list[dict]:
    """Runs of hit words: first, and the one after the last."""
    if hit is None:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [{"first": int(a), "past": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


SPANS = "array<struct<first:bigint,past:bigint>>"


def _blocks(bench: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """Items in blocks of about limit bytes, and whether a block is the last; one at a time on the driver."""
    items = bench.where(F.col(text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // limit
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text")
        yield [(r.item, r.text) for r in rows.collect()], k == n - 1


def _scanner(shared, first: bool, last: bool):
    """Adds what a block's windows hit to what earlier blocks have hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for b in batches:
            n_words, found, spans = [], [], []
            for i, t in enumerate(b["text"].cast(pa.binary()).to_pylist()):
                n, hit, items = windows.scan(t or b"")
                if not first and (old := b["spans"][i].as_py()):
                    items |= set(b["items"][i].as_py())
                    hit = np.zeros(n, bool) if hit is None else hit
                    for s in old:
                        hit[s["first"] : s["past"]] = True
                n_words.append(n)
                found.append(sorted(items))
                spans.append(_spans(hit))
            new = {"n_words": pa.array(n_words, pa.int64()), "items": pa.array(found, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())])))}
            # The text goes back to the JVM only if another block has to see it.
            columns = {"row": b["row"]} | ({} if last else {"text": b["text"]}) | new
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scan


def find_contamination(
    docs: DataFrame,
    bench: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    keep: list[str] | None = None,
    out: str = "hits",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns in keep (all of docs by default) and a struct column out: n_words, n_hit (long), items
    (array of item ids as sorted strings), spans (array of first and past, counted in words).

    A null or wordless text has no words and no hits. Items with a null text or no words have no windows; windows of
    items without an id hit, but such items aren't listed; rows of equal id count as one item with the windows of all. An item of fewer words than width is
    one window. An empty benchmark hits nothing. A column named like out is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    d = docs.select(
        F.struct(*keep).alias("row"),
        F.col(text).alias("text"),
        F.lit(None).cast("bigint").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast(SPANS).alias("spans"),
    )
    first = True
    for block, last in _blocks(bench, item, item_text, block_bytes):
        if not first:
            d = cut(d, "scanned")
        shared = docs.sparkSession.sparkContext.broadcast(Windows(block, width))
        schema = T.StructType([f for f in d.schema.fields if not last or f.name != "text"])
        d = d.mapInArrow(_scanner(shared, first, last), schema)
        first = False
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["past"] - s["first"])
    return d.select("row.*", F.struct("n_words", n_hit.alias("n_hit"), "items", "spans").alias(out))


def contaminated(hits: str = "hits"):
    """The rule: some word is hit, and a twentieth of all words at least."""
    return (F.col(f"{hits}.n_hit") > 0) & (20 * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def _without_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut_out(t, runs):
        raw = t.encode()
        places = [m.span() for m in WORDS.finditer(raw)]
        out, at = [], 0
        for r in runs:
            out.append(raw[at : places[r["first"]][0]])
            at = places[r["past"] - 1][1]
        return b"".join([*out, raw[at:]]).decode()

    return pd.Series([cut_out(t, r) if t is not None and r is not None and len(r) else t for t, r in zip(text, spans, strict=True)], dtype=object)


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words cut from all texts."""
    hits = free_name(docs, "hits")
    found = find_contamination(docs, bench, text, out=hits, **options)
    if remove == "documents":
        return found.where(~contaminated(hits)).drop(hits)
    clean = F.when(F.size(f"{hits}.spans") > 0, F.pandas_udf(_without_spans, "string")(text, f"{hits}.spans")).otherwise(F.col(text))
    return found.withColumn(text, clean).drop(hits)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontamination_sql(table: str = "documents") -> str:
    """DuckDB SQL for op1's rows over a table or subquery."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    norm = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH c_d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({norm.format("coalesce(text, '')")}, '{word}') AS ws FROM {table}),
c_b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({norm.format("text")}, '{word}') AS ws FROM benchmark WHERE text IS NOT NULL),
c_win AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS w
          FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM c_b WHERE len(ws) > 0)),
c_n AS (SELECT DISTINCT n FROM c_win),
c_at AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM c_d JOIN c_n ON len(ws) >= n),
c_hit AS (SELECT rid, i, c_at.n, item FROM c_at JOIN c_win ON c_at.n = c_win.n AND array_to_string(ws[i:i + c_at.n - 1], ' ') = w),
c_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM c_hit) GROUP BY rid),
c_items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM c_hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM c_d LEFT JOIN c_words USING (rid) LEFT JOIN c_items USING (rid)
"""
