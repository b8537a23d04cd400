"""What line dedup rules out before it verifies pairs, and how later links join components."""

import itertools
import random

from pyspark.sql import functions as F

from parlance.llm import components, line_dedup


def test_sketches_rule_out_pairs_below_the_threshold_alone(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    base = [word() for _ in range(47)]
    lines = [" ".join(base)]
    for k in range(60):
        x = list(base)
        for i in rng.sample(range(47), k % 6 + 1):
            x[i] = word()
        lines.append(" ".join(x))
    lines += ["short", "a line alone " * 30]
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    share = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(len(lines)), 2)}
    texts = spark.createDataFrame(list(enumerate(lines)), "h long, line string")
    got = {(r.a, r.b) for r in line_dedup._may_link(spark.createDataFrame(list(share), "a long, b long"), line_dedup._sketches(texts)).collect()}
    low = {p for p, x in share.items() if 0.6 < x < 0.75}
    assert {p for p, x in share.items() if x >= 0.8} <= got and len(low) > 300
    assert len(got & low) < 0.05 * len(low)


def test_links_between_components(spark):
    found = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (7, 2), (3, 3), (8, 3)], "node long, component long")
    links = spark.createDataFrame([(2, 1), (2, 5), (9, 6)], "x long, y long")
    got = {r.node: r.component for r in components.merged_components(found, links, "x", "y").collect()}
    assert got == {1: 1, 4: 1, 2: 1, 7: 1, 5: 1, 3: 3, 8: 3, 6: 6, 9: 6}
    assert {r.node: r.component for r in components.merged_components(found, links.limit(0), "x", "y").collect()} == {r.node: r.component for r in found.collect()}


def test_stars_take_no_round(spark, monkeypatch):
    rounds = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(a[1]) or star(*a))
    edges = lambda *e: spark.createDataFrame(list(e), "a long, b long")
    found = lambda d: {r.node: r.component for r in components.connected_components(d, "a", "b").collect()}
    assert found(edges((1, 4), (4, 1), (5, 1), (2, 3), (6, 6), (None, 1))) == {1: 1, 4: 1, 5: 1, 2: 2, 3: 2}
    assert found(edges()) == {} and not rounds
    # A node between two others, and one with two lesser ones.
    assert found(edges((1, 2), (2, 3))) == {1: 1, 2: 1, 3: 1} and len(rounds) == 2
    assert found(edges((1, 3), (2, 3))) == {1: 1, 2: 1, 3: 1} and len(rounds) == 4


def _optimized(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_split_and_shingled_once(spark):
    docs = spark.createDataFrame([(1, "one line\n another"), (2, None), (3, "")], "doc_id long, text string")
    lines = line_dedup._lines(docs, "doc_id", "text")
    assert _optimized(lines).count("split(") == 1
    assert {(r.doc, r.pos, r.line) for r in lines.collect()} == {(1, 0, "one line"), (1, 1, "another")}
    sets = line_dedup._exploded(spark.createDataFrame([(1, "abcdefghijabcdefghij"), (2, "short"), (3, "")], "h long, line string"))
    assert _optimized(sets).count("transform(sequence(") == 1 and "Generate explode(s#" in _optimized(sets)
    assert {r.h: r.n for r in sets.groupBy("h").agg(F.count_distinct("s").alias("n")).collect()} == {1: 10, 2: 1, 3: 1}
    assert sets.count() == 12


def test_lines_without_a_twin_are_not_grouped(spark, monkeypatch):
    seen = {}
    cut = line_dedup.cut

    def kept(d, name):
        seen[name] = cut(d, name)
        return seen[name]

    monkeypatch.setattr(line_dedup, "cut", kept)
    alone = [f"{k} line of its own {k * 7919}" for k in range(50)]
    rows = [(k, x) for k, x in enumerate(alone)]
    # Equal rows, a line twice in a text, blank lines, no text; a null key is the first.
    rows += [(60, "twice\n \nTwice \n"), (61, "\n \n"), (62, None), (70, "same row"), (70, "same row"), (None, "at last"), (80, "at last\nsame row\nmore")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.text, r.lines.n_lines, r.lines.n_removed) for r in line_dedup.dedup_lines(d).collect()), key=lambda x: x[0])
    assert [x for x in got if 0 <= x[0] < 50] == [(k, x, 1, 0) for k, x in enumerate(alone)]
    assert [x for x in got if not 0 <= x[0] < 50] == [(-1, "at last", 1, 0), (60, "twice\n \n", 4, 1), (61, "\n \n", 3, 0), (62, None, 0, 0), (70, "same row", 1, 0), (70, "same row", 1, 0), (80, "more", 3, 2)]
    assert seen["busy"].count() < 10
