"""Prefixes of shingle sets are told by the sets' least shingles, so texts are shingled once; where those don't tell, by the texts."""

import random

import numpy as np

from parlance.llm import ngram_join


def test_prefix_of_least_shingles():
    rng = np.random.default_rng(3)
    told = untold = 0
    for k in range(400):
        s = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 80)) if k % 2 else 300).astype(np.uint64) * np.uint64(4))
        late = np.sort(np.concatenate((s[rng.random(len(s)) < (0.01, 0.2, 0.9, 1)[k % 4]], rng.integers(0, 1 << 62, 5).astype(np.uint64))))
        is_late = np.isin(s, late)
        size = ngram_join.prefix_size(len(s), 80)
        want = np.concatenate((s[~is_late], s[is_late]))[:size]
        least = s[: size + len(s) // ngram_join.SPARE]
        assert (ngram_join._are_late(s, late) == is_late).all()
        assert ngram_join.prefix(s, is_late, len(s), 80).tolist() == want.tolist()
        got = ngram_join.prefix(least, is_late[: len(least)], len(s), 80)
        told, untold = told + (got is not None), untold + (got is None)
        assert got is None or got.tolist() == want.tolist()
    assert told > 100 and untold > 100


def test_texts_tell_what_least_shingles_do_not(spark, monkeypatch):
    asked = []
    real = ngram_join._prefixes_of_texts
    monkeypatch.setattr(ngram_join, "_prefixes_of_texts", lambda *a: asked.append(a) or real(*a))
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    rows = [(i, " ".join(base[:k] + [f"n{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 300, 20))]
    rows += [(100 + i, " ".join(f"x{rng.randrange(9000)}" for _ in range(80))) for i in range(5)] + [(7, rows[7][1]), (3, "other words under that id, not seen again"), (200, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(d, frequent=2).collect())
    # Every two of the family share all but ten of 296 shingles each; id 3 stands for two texts.
    assert got == sorted([(i, 0) for i in range(15)] + [(7, 0), (3, 3), (200, 200)] + [(100 + i, 100 + i) for i in range(5)])
    assert asked
