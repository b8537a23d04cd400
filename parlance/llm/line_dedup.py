"""Fuzzy line dedup by MinHash, in DataFrame functions throughout.

A line (trimmed of white space, lower case) is the set of its character shingles. Its signature takes the hashes of all
its shingles of bytes: of each of evenly spaced ranges of the hash space the least few, which two lines share with the
chance that as many independent MinHash rows agree. These are the bands, and bands give buckets. Pairs that meet are
decided by the exact Jaccard similarity of their sets of character shingles. Which lines of a bucket meet:
1. Each line meets the least of its bucket. 2. Lines that this leaves in several components of one bucket meet again by one to
four bands on end: all pairs of up to FEW lines, of more lines each with the least and the greatest. 3. In buckets that still have
several components all pairs of different ones meet, whatever the bucket's size. So no link between lines that share a bucket
is lost. Before any pair is verified, sketches of the lines' shingles, made once for each line, rule out what can't reach the
threshold, and no other pair. Verified pairs are resolved by distributed union-find, and the first line of each component stays.

Equal lines are one node before they are dealt to buckets, so a line with a third of all rows costs one row per task. Buckets
are found by an aggregate that combines before the shuffle, never collected. Lines and rows are told apart by two 64-bit
hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import cut, documents, maybe_among
from parlance.llm.components import connected_components, merged_components

SHINGLE, PERCENT = 8, 80
#: A pair at 0.8 is found with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.985, one at 0.9 with 0.9998.
BANDS, ROWS = 8, 4
#: Numbers of bands on end in which lines meet again that their buckets leave in several components.
DEPTHS = (1, 2, 3, 4)
#: Lines up to which all pairs are compared of those that meet so.
FEW = 12
#: Longs of a line's sketch (a power of 2), and lines of a block in which those of a large bucket are compared.
WORDS, BLOCK = 16, 1000
#: Where the ranges of the hash space begin, but the first.
STARTS = [(k << 64) // BANDS - (1 << 63) for k in range(1, BANDS)]
#: What is no text: white space other than line breaks.
WHITE = " \t\x0b\x0c\r"


def _shingles(line: str):
    """The set of shingles of characters of a string column, each as 64 bits; a shorter line is one shingle."""
    # In UTF-32 every character has four bytes, so a shingle is found without counting. The encoded line is bound to a
    # variable (w), else it would be encoded again for each shingle; as nothing here can be null, arrays are of plain numbers.
    return F.array_distinct(
        F.expr(
            f"transform(array(coalesce(encode({line}, 'UTF-32'), X'')), w -> CASE WHEN octet_length(w) <= {4 * SHINGLE} THEN array(xxhash64(w)) "
            f"ELSE transform(sequence(1, octet_length(w) - {4 * SHINGLE - 1}, 4), i -> xxhash64(substring(w, i, {4 * SHINGLE}))) END)[0]"
        )
    )


def _byte_hashes(line: str):
    """Hashes of all shingles of bytes. Characters beyond ASCII have several bytes, so their shingles are shorter and lines meet
    rather more often; what they are worth is decided on characters."""
    return F.expr(
        f"transform(array(coalesce(CAST({line} AS BINARY), X'')), w -> CASE WHEN octet_length(w) <= {SHINGLE} THEN array(xxhash64(w)) "
        f"ELSE transform(sequence(1, octet_length(w) - {SHINGLE - 1}), i -> xxhash64(substring(w, i, {SHINGLE}))) END)[0]"
    )


def _row_key(key: str, text: str) -> list:
    """row, row2: two hashes of key and text."""
    return [F.xxhash64(F.col(key), F.col(text)).alias("row"), F.xxhash64(F.col(text), F.lit(7), F.col(key)).alias("row2")]


def _compared(line):
    return F.lower(F.trim(line, F.lit(WHITE)))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, row and row2 (hashes of key and text), pos, line (as compared) of all lines that are not blank."""
    d = docs.select(F.col(key).alias("doc"), *_row_key(key, text), F.split(text, "\n").alias("lines"))
    # For posexplode a filter would be inferred that splits texts once more, and once more; the null that outer gives for a null text goes.
    d = d.select("doc", "row", "row2", F.posexplode_outer("lines").alias("pos", "line"))
    return d.where(F.trim("line", F.lit(WHITE)) != "").withColumn("line", _compared(F.col("line")))


def signatures(lines: DataFrame) -> DataFrame:
    """Adds h and h2 (the line's hashes) and bands, drops line."""
    d = lines.withColumns({"h": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})
    d = d.withColumn("_hashes", F.sort_array(_byte_hashes("line"))).drop("line")
    d = d.withColumn("_marked", F.sort_array(F.concat("_hashes", F.array(*[F.lit(x) for x in STARTS]))))
    # Hashes below a start: its place among hashes and starts, less the starts up to it. A band is the range's least
    # hashes, and those of the next where it has too few.
    below = ["0", *[f"array_position(_marked, {x}L) - {k + 1}" for k, x in enumerate(STARTS)]]
    bands = [F.xxhash64(F.lit(b), F.expr(f"slice(_hashes, CAST({n} AS INT) + 1, {ROWS})")) for b, n in enumerate(below)]
    return d.withColumn("bands", F.array(*bands)).drop("_hashes", "_marked")


def _told_apart(signed: DataFrame) -> DataFrame:
    """signed with h as the line's only name: where two lines have one h, both get another."""
    shared = signed.groupBy("h").agg(F.min("h2").alias("a"), F.max("h2").alias("z")).where("a <> z").select("h")
    if not shared.isEmpty():
        signed = cut(signed.join(shared.withColumn("_shared", F.lit(True)), "h", "left").withColumn("h", F.when(F.col("_shared"), F.xxhash64("h", "h2")).otherwise(F.col("h"))).drop("_shared"), "signed")
    return signed.drop("h2")


def _texts(wanted: DataFrame, docs: DataFrame, signed: DataFrame, key: str, text: str) -> DataFrame:
    """h, line (as compared) of all hashes h in wanted."""
    # Aggregated before the join, so a line of very many rows is one row a task.
    some = maybe_among(signed.select("h", "row", "row2", "pos"), "h", wanted, "h").groupBy("h").agg(F.min(F.struct("row", "row2", "pos")).alias("x"))
    at = cut(some.join(wanted, "h").select(F.col("h").alias("w_h"), F.col("x.row").alias("w_row"), F.col("x.row2").alias("w_row2"), F.col("x.pos").alias("w_pos")), "places")
    near = maybe_among(docs.select(*_row_key(key, text), F.split(text, "\n").alias("lines")), "row", at, "w_row")
    lines = near.select("row", "row2", F.posexplode_outer("lines").alias("pos", "line"))
    same = (F.col("row") == F.col("w_row")) & (F.col("row2") == F.col("w_row2")) & (F.col("pos") == F.col("w_pos"))
    texts = lines.join(at, same).select(F.col("w_h").alias("h"), _compared(F.col("line")).alias("line"))
    return cut(texts.dropDuplicates(["h"]), "lines")  # equal rows of docs give a line twice


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b: line hashes; other columns stay) whose shingle sets reach the threshold."""
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    # The number of the row keeps Spark from writing the sets' computation into the filter, once for each use.
    sets = both.select(*pairs.columns, _shingles("line_a").alias("x"), _shingles("line_b").alias("y"), F.monotonically_increasing_id().alias("row"))
    return sets.where((100 + PERCENT) * F.size(F.array_intersect("x", "y")) >= PERCENT * (F.size("x") + F.size("y"))).select(*pairs.columns)


def _open_rows(placed: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, h, component of the buckets that have lines of several components. placed: bucket, h."""
    placed = placed.join(found.withColumnRenamed("node", "h"), "h", "left").select("bucket", "h", F.coalesce("component", "h").alias("component"))
    placed = cut(placed, "placed")
    several = placed.groupBy("bucket").agg(F.min("component").alias("m"), F.max("component").alias("z")).where("m <> z").select("bucket")
    return cut(maybe_among(placed, "bucket", several, "bucket").join(several, "bucket"), "open")


def _exploded(texts: DataFrame) -> DataFrame:
    """h, s: each shingle of a line once. texts: h, line."""
    # What explode computes itself is interpreted for each shingle, so sets are columns before; of outer no filter is inferred, which
    # would compute them once more. No set is empty. Dealt by h alone, so that later aggregates find a line's shingles in its task.
    return texts.repartition("h").select("h", _shingles("line").alias("s")).select("h", F.explode_outer("s").alias("s"))


def _sketches(texts: DataFrame) -> DataFrame:
    """h, n (size of its set of shingles), w0 and on: for each bit, whether the shingles that have it are odd in number. texts: h, line."""
    sets = _exploded(texts)
    bit = F.expr("shiftleft(1L, CAST(s & 63 AS INT))")
    words = sets.groupBy("h", F.expr(f"CAST(shiftright(s, 6) & {WORDS - 1} AS INT)").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(bit).alias("w"))
    return cut(words.groupBy("h").agg(F.sum("n").alias("n"), *[F.bit_xor(F.when(F.col("word") == k, F.col("w")).otherwise(F.lit(0))).alias(f"w{k}") for k in range(WORDS)]), "sketches")


def _sketch(side: str) -> list:
    return [F.col(c).alias(f"{c}_{side}") for c in ("n", *[f"w{k}" for k in range(WORDS)])]


def _reachable():
    """Whether two sets may reach the threshold. A bit in which sketches differ is odd in one set alone, so it has a shingle that is in one
    of them alone; sets that reach it have (100 - PERCENT) / (100 + PERCENT) of their sizes' sum of these at most, so none is left out."""
    odd = F.expr(" + ".join(f"bit_count(w{k}_a ^ w{k}_b)" for k in range(WORDS)))
    sizes = F.col("n_a") + F.col("n_b")
    return ((100 + PERCENT) * F.least("n_a", "n_b") >= PERCENT * sizes) & ((100 + PERCENT) * odd <= (100 - PERCENT) * sizes)


def _may_link(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of pairs (a, b: line hashes; other columns stay) that may reach the threshold."""
    both = pairs
    for side in "ab":
        both = both.join(sketches.select(F.col("h").alias(side), *_sketch(side)), side)
    return cut(both.where(_reachable()).select(*pairs.columns), "pairs")


def _closer(lines: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b, component_a, component_b) of open lines that share several bands on end, as far as they may link: all pairs where few
    lines do, else each line with the least and the greatest of them. Linear in the lines; it joins most components before _rest
    looks at every pair."""
    keys = F.array(*[F.xxhash64(F.lit(b), F.lit(depth), *[F.col("bands")[(b + i) % BANDS] for i in range(depth)]) for depth in DEPTHS for b in range(BANDS)])
    rows = cut(lines.select("h", "component", F.explode(keys).alias("key")), "closer")
    ends = rows.groupBy("key").agg(F.min("component").alias("m"), F.max("component").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"), (F.count(F.lit(1)) <= FEW).alias("few")).where("m <> n")
    ends = cut(ends.select("key", "low", "high", "few"), "ends")
    met = cut(maybe_among(rows, "key", ends, "key").join(ends, "key"), "met")
    left, right = (met.where("few").select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("h", "component")]) for side in "ab")
    every = left.join(right, "key").where("h_a < h_b AND component_a <> component_b").select(F.col("h_a").alias("a"), F.col("h_b").alias("b"), "component_a", "component_b")
    far = met.where("not few").select("h", "component", F.explode(F.array("low", "high")).alias("end"))
    of = lines.select(F.col("h").alias("end"), F.col("component").alias("end_component"))
    far = far.join(of, "end").where("component <> end_component").select(F.col("h").alias("a"), F.col("end").alias("b"), F.col("component").alias("component_a"), F.col("end_component").alias("component_b"))
    return _may_link(_once(every.union(far)), sketches)


def _once(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, component_a, component_b), a < b."""
    turned = [F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("component_a", "component_b"), ("component_b", "component_a"))]
    return pairs.select(*turned).distinct()


def _rest(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs (a, b, component_a, component_b) that may reach the threshold, of lines of one bucket and different components. rows:
    bucket, h, component.

    Every pair of a bucket is looked at by its sketches; a large bucket goes to tasks in pairs of blocks of some BLOCK lines."""
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "bucket").withColumn("block", F.expr("CAST(pmod(xxhash64(h, bucket), blocks) AS INT)"))
    dealt = cut(dealt.join(sketches, "h"), "dealt")
    left = dealt.select("bucket", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("h").alias("a"), F.col("component").alias("component_a"), *_sketch("a"))
    right = dealt.select("bucket", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("h").alias("b"), F.col("component").alias("component_b"), *_sketch("b"))
    met = left.join(right, ["bucket", "i", "j"]).where(F.expr("component_a <> component_b AND (i < j OR a < b)") & _reachable())
    return cut(_once(met.select("a", "b", "component_a", "component_b")), "rest")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "lines") -> DataFrame:
    """All rows and columns of docs; text without lines that a line before (by key, then place) is equal or similar
    to, and a struct column out: n_lines, n_removed (long).

    Blank lines (white space alone) stay. A null text stays null and has no lines; a text whose lines all go is empty. Rows that agree
    in key and text count as one and keep the same lines; a null key comes first. Lines compare trimmed of
    white space and in lower case. A column named like out is replaced.
    """
    signed = _told_apart(cut(signatures(_lines(docs, key, text)), "signed"))
    lines = cut(signed.groupBy("h", "bands").agg(F.count(F.lit(1)).alias("n")), "distinct")
    rows = lines.select("h", F.explode("bands").alias("bucket"))
    buckets = cut(rows.groupBy("bucket").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select("bucket", "a"), "buckets")
    met = cut(maybe_among(rows, "bucket", buckets, "bucket").join(buckets, "bucket").where("a <> h").select("bucket", "a", F.col("h").alias("b")), "met")
    pairs = cut(met.select("a", "b").distinct(), "pairs")
    wanted = cut(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "wanted")
    texts = _texts(wanted, docs, signed, key, text)
    sketches = _sketches(texts)
    found = connected_components(_verified(_may_link(pairs, sketches), texts), "a", "b")
    rows = _open_rows(met.select("bucket", F.col("b").alias("h")), found)
    if not rows.isEmpty():
        some = cut(rows.select("h", "component").distinct(), "open")
        closer = _closer(cut(some.join(maybe_among(lines.drop("n"), "h", some, "h"), "h"), "open"), sketches)
        found = merged_components(found, _verified(closer, texts), "component_a", "component_b")
        rest = _rest(_open_rows(rows.select("bucket", "h"), found), sketches)
        if not rest.isEmpty():
            found = merged_components(found, _verified(rest, texts), "component_a", "component_b")

    # A line that occurs once and has no link stays, so others alone are grouped (and few that are taken for such).
    busy = lines.where("n > 1").select("h").union(found.select(F.col("node").alias("h")))
    some = cut(maybe_among(signed, "h", busy, "h").select("doc", "row", "row2", "pos", "h"), "busy")
    first = some.groupBy("h").agg(F.min(F.struct("doc", "row", "row2", "pos")).alias("first"))
    groups = first.join(found.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    kept = groups.groupBy("component").agg(F.min("first").alias("x")).select("x.row", "x.row2", "x.pos", F.lit(True).alias("first"))
    # All of a row's places in some, and those of them that stay.
    marks = some.select("row", "row2", "pos", F.lit(False).alias("first")).union(kept).groupBy("row", "row2", "pos").agg(F.max("first").alias("first"))
    gone = marks.where("not first").groupBy(F.col("row").alias("_gone_row"), F.col("row2").alias("_gone_row2")).agg(F.collect_list("pos").alias("_gone"))

    d = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in (text.lower(), out.lower())]).alias("_row"), F.col(text).alias("_text"), *_row_key(key, text))
    d = d.join(gone, (F.col("row") == F.col("_gone_row")) & (F.col("row2") == F.col("_gone_row2")), "left").withColumn("_lines", F.split("_text", "\n"))
    new = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.filter("_lines", lambda x, p: ~F.array_contains("_gone", p)), "\n"))
    n, removed = F.coalesce(F.size("_lines").cast("long"), F.lit(0)), F.coalesce(F.size("_gone").cast("long"), F.lit(0))
    counted = F.struct(F.when(F.col("_text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col("_text").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))
    d = d.select("_row.*", new.alias(text), counted.alias(out))
    return d.select(*[c for c in docs.columns if c.lower() != out.lower()], out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "lines.n_lines", "lines.n_removed", "text")
