"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of its language's common words are
compared with references of that language by Jensen-Shannon distance (square root of the divergence
with base 2, from 0 to 1); that of words as a share of what a text without common words has. Short texts give noisy histograms, so each comparison has a least length;
below it the comparison passes. All of it is one projection: no shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import documents, free_name

# Shares of character classes in running text of each language.
CLASSES = ("upper", "digit", "space", "punct", "beyond_ascii", "symbol", "lower")
CLASS_SHARES = {
    "en": (0.025, 0.005, 0.170, 0.025, 0.002, 0.001, 0.772),
    "de": (0.050, 0.005, 0.145, 0.025, 0.020, 0.001, 0.754),
    "fr": (0.025, 0.005, 0.165, 0.030, 0.040, 0.001, 0.734),
    "es": (0.025, 0.005, 0.170, 0.025, 0.025, 0.001, 0.749),
}
# The commonest words of each language and their shares of all words, in thousandths.
COMMON_WORDS = {
    "en": {"the": 61, "of": 33, "and": 29, "to": 26, "in": 21, "a": 21, "that": 11, "is": 10, "for": 9, "was": 9, "with": 8, "be": 7, "on": 7, "by": 6, "he": 6, "at": 5, "this": 5, "are": 5, "from": 4, "or": 4},
    "de": {"der": 33, "die": 32, "und": 28, "in": 17, "den": 12, "von": 10, "zu": 10, "das": 10, "mit": 9, "des": 9, "ist": 8, "auf": 8, "im": 8, "dem": 7, "ein": 7, "eine": 7, "für": 7, "es": 6, "nicht": 6, "er": 5},
    "fr": {"de": 50, "la": 32, "le": 28, "et": 24, "les": 20, "des": 17, "un": 15, "en": 14, "une": 12, "du": 12, "est": 10, "que": 10, "dans": 9, "qui": 8, "par": 8, "pour": 7, "au": 7, "sur": 6, "pas": 5, "il": 5},
    "es": {"de": 62, "la": 38, "que": 29, "el": 28, "en": 26, "y": 26, "los": 17, "a": 20, "se": 13, "del": 12, "las": 11, "un": 10, "por": 9, "con": 9, "una": 8, "no": 8, "para": 6, "es": 6, "su": 6, "lo": 5},
}
#: Largest distances that pass, and the least characters and words at which they are judged. That of words is a share of what a text
#: without common words of the language has. Set by the distances of all of sf0.1 that pass the base rules: labelled good documents
#: reach 0.225 in classes and 0.727 in words; labelled bad ones have 0.76 or more in words.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.30, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.735, 100
#: Words beyond which windows are told apart by 64 bits beside their place, not by the bits that a place leaves.
LONG = 16_384


def _js_distance(p, q):
    """Of two histograms (array columns that sum to 1)."""
    term = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / (2 * math.log(2)), F.lit(0.0)))


def _without_common(name: str) -> float:
    """Distance of a text that has no common word of a language."""
    q = [s / 1000 for s in COMMON_WORDS[name].values()]
    other = 1 - sum(q)
    total = sum(x * math.log(2) for x in q) + math.log(2 / (1 + other)) + other * math.log(2 * other / (1 + other))
    return math.sqrt(total / (2 * math.log(2)))


def _table(values: dict[str, list]):
    """A literal map from language to array."""
    return F.create_map(*[x for name, v in values.items() for x in (F.lit(name), F.array(*map(F.lit, v)))])


def _matched(t: str, pattern: str):
    """Characters of t that match a class."""
    return (F.length(t) - F.length(F.regexp_replace(t, f"{pattern}+", ""))).cast("long")


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", out: str = "quality") -> DataFrame:
    """All rows and columns of docs, with a struct column: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed (boolean), class_distance, word_distance (double, null below
    the least length), kept (boolean).

    A null text has no words. A document is kept if the base rules and both distances pass. Repeated
    rows are judged one by one; a column of docs named like out is replaced.
    """
    d = docs.select(F.struct(*[c for c in docs.columns if c.lower() != out.lower()]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(lang).alias("_lang"))
    d = d.withColumn("_words", F.array_remove(F.split("_t", r"[ \x09-\x0D]+"), ""))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")))
    d = d.withColumns(
        {
            "_n": F.size("_words"),
            "_length": F.length("_t").cast("long"),
            "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_symbols": _matched("_t", r"[#*$%&|<>]"),
            "_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_upper": _matched("_t", r"[A-Z]"),
            "_digit": _matched("_t", r"[0-9]"),
            "_punct": _matched("_t", r"[.,;:!?'\"()-]"),
            "_beyond": _matched("_t", r"[^\x00-\x7F]"),
        }
    ).drop("_lines")
    # Windows of 3 words: a hash, with the place in the low bits, so that one sort of plain numbers brings equal windows
    # together. Long texts would leave the hash too few bits, so there it stands beside the place.
    d = d.withColumn("_bits", F.length(F.bin("_n")))
    window = "xxhash64(_words[i - 1], _words[i], _words[i + 1])"
    d = d.withColumn("_short", F.expr(f"CASE WHEN _n > 2 AND _n <= {LONG} THEN sort_array(transform(sequence(1, _n - 2), i -> shiftleft({window}, _bits) | CAST(i AS BIGINT))) ELSE array() END"))
    d = d.withColumn("_long", F.expr(f"CASE WHEN _n > {LONG} THEN sort_array(transform(sequence(1, _n - 2), i -> struct({window} AS h, CAST(i AS BIGINT) AS i))) END"))
    same = "shiftrightunsigned(x, _bits) = shiftrightunsigned(get(_short, {}), _bits)"
    d = d.withColumn("_found", F.expr(f"filter(_short, (x, j) -> {same.format('j - 1')} OR {same.format('j + 1')})")).drop("_short")
    d = d.withColumn("_found_long", F.expr("filter(_long, (x, j) -> x.h = get(_long, j - 1).h OR x.h = get(_long, j + 1).h)")).drop("_long")
    d = d.withColumn("_again", F.expr(f"CASE WHEN _n > {LONG} THEN transform(_found_long, x -> x.i) ELSE transform(_found, x -> x & (shiftleft(1L, _bits) - 1)) END")).drop("_found", "_found_long")
    repeated = F.expr("aggregate(sort_array(_again), named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)")
    d = d.withColumn("_repeated", repeated).drop("_again")
    n, length = F.col("_n"), F.col("_length")
    counts = [F.col("_upper"), F.col("_digit"), length - F.col("_word_chars"), F.col("_punct"), F.col("_beyond"), F.col("_symbols")]
    classes = F.array(*[c / length for c in [*counts, length - sum(counts[1:], counts[0])]])
    # A language that is null or unknown is judged by the nearest reference.
    languages = F.when(F.col("_lang").isin(*CLASS_SHARES), F.array("_lang")).otherwise(F.array(*map(F.lit, CLASS_SHARES)))
    d = d.withColumns(
        {
            "_languages": languages,
            "_classes": F.when(length >= MIN_CHARS, classes),
            "_common": F.when(n >= MIN_WORDS, F.filter("_words", lambda w: w.isin(*sorted({w for ws in COMMON_WORDS.values() for w in ws})))),
        }
    ).drop("_words")
    class_shares = _table({name: list(q) for name, q in CLASS_SHARES.items()})
    common = _table({name: list(q) for name, q in COMMON_WORDS.items()})
    word_shares = _table({name: [*(s / 1000 for s in q.values()), 1 - sum(s / 1000 for s in q.values())] for name, q in COMMON_WORDS.items()})

    without = F.create_map(*[x for name in COMMON_WORDS for x in (F.lit(name), F.lit(_without_common(name)))])

    def words_histogram(name):
        counts = F.transform(common[name], lambda w: F.size("_common") - F.size(F.array_remove("_common", w)))
        other = n - F.aggregate(counts, F.lit(0), lambda a, c: a + c)
        return F.transform(F.concat(counts, F.array(other)), lambda c: c / n)

    d = d.withColumn("_class_distance", F.when(F.col("_classes").isNotNull(), F.array_min(F.transform("_languages", lambda x: _js_distance(F.col("_classes"), class_shares[x])))))
    d = d.withColumn("_word_distance", F.when(F.col("_common").isNotNull(), F.array_min(F.transform("_languages", lambda x: _js_distance(words_histogram(x), word_shares[x]) / without[x]))))
    failed = (n < 50) | (100 * F.col("_repeated") > 50 * n)
    passed = F.coalesce(F.col("_class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("_word_distance") <= MAX_WORD_DISTANCE, F.lit(True))
    verdict = F.struct(
        n.cast("long").alias("n_words"),
        F.col("_word_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.col("_dup_lines").alias("n_dup_lines"),
        F.col("_repeated").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col("_class_distance").alias("class_distance"),
        F.col("_word_distance").alias("word_distance"),
        (~failed & passed).alias("kept"),
    )
    # A filter on the verdict would be pushed below all steps of its computation, each of them written out as often as it is
    # used, which no planner ends. It isn't pushed below a row made from the verdict.
    return d.select("_row", F.explode(F.array(verdict)).alias("_verdict")).select("_row.*", F.col("_verdict").alias(out))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of docs that judge_quality keeps, with the columns of docs."""
    verdict = free_name(docs, "quality")
    return judge_quality(docs, text, lang, verdict).where(f"{verdict}.kept").select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def quality_sql(table: str = "documents") -> str:
    """DuckDB SQL for the same counts and verdict over a table or subquery."""

    def distance(p: list[str], q: list[float]) -> str:
        terms = []
        for x, y in zip(p, q, strict=True):
            m = f"(({x}) + {y!r}) / 2"
            terms.append(f"CASE WHEN ({x}) > 0 THEN ({x}) * ln(({x}) / ({m})) ELSE 0.0 END + {y!r} * ln({y!r} / ({m}))")
        return f"sqrt(greatest(({' + '.join(terms)}) / {2 * math.log(2)!r}, 0.0))"

    def words(name: str) -> str:
        p = [f"len(list_filter(ws, lambda w: w = '{w}')) / n::DOUBLE" for w in COMMON_WORDS[name]]
        q = [s / 1000 for s in COMMON_WORDS[name].values()]
        listed = ", ".join(f"'{w}'" for w in COMMON_WORDS[name])
        return distance([*p, f"(n - len(list_filter(ws, lambda w: w IN ({listed})))) / n::DOUBLE"], [*q, 1 - sum(q)]) + f" / {_without_common(name)!r}"

    def classes(name: str) -> str:
        return distance([f"{c} / length::DOUBLE" for c in ("n_upper", "n_digit", "n_space", "n_punct", "n_beyond", "n_symbols", "n_lower")], list(CLASS_SHARES[name]))

    def choose(f) -> str:
        cases = " ".join(f"WHEN lang = '{x}' THEN {f(x)}" for x in CLASS_SHARES)
        return f"CASE {cases} ELSE least({', '.join(f(x) for x in CLASS_SHARES)}) END"

    def matched(pattern: str) -> str:
        return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"

    return f"""
WITH q_d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM {table}),
q_w AS (SELECT *, list_filter(string_split_regex(t, '[ \\x09-\\x0D]+'), lambda w: w <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS ls FROM q_d),
q_pos AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM q_w WHERE len(ws) > 2),
q_win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM q_pos),
q_rep AS (SELECT rid, count(DISTINCT i + k) AS n_rep FROM q_win, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
q_c AS (SELECT q_w.*, len(ws) AS n, length(t) AS length, length(array_to_string(ws, '')) AS word_chars, {matched('[#*$%&|<>]')} AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, {matched('[A-Z]')} AS n_upper,
        {matched('[0-9]')} AS n_digit, {matched('''[.,;:!?''''"()-]''')} AS n_punct, {matched('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AS n_beyond
        FROM q_w LEFT JOIN q_rep USING (rid)),
q_s AS (SELECT *, length - word_chars AS n_space, length - n_upper - n_digit - (length - word_chars) - n_punct - n_beyond - n_symbols AS n_lower,
        n < 50 OR 100 * n_repeat_words > 50 * n AS base_failed FROM q_c),
q_j AS (SELECT *, CASE WHEN length >= {MIN_CHARS} THEN {choose(classes)} <= {MAX_CLASS_DISTANCE} ELSE true END
        AND CASE WHEN n >= {MIN_WORDS} THEN {choose(words)} <= {MAX_WORD_DISTANCE} ELSE true END AS passed FROM q_s)
SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passed AS kept FROM q_j
"""
