import random
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import near
from marlstone.llm.text import WordHashes, words_of


def plain_classes(rows):
    """All pairs by weighted Jaccard similarity over plain dictionaries, then union-find."""
    words = {}
    for d, t in rows:
        words.setdefault(tuple(words_of(t)), []).append(d)
    hashes, df, n = WordHashes(), Counter(), 0
    for _, t in rows:
        if w := set(words_of(t)):
            n += 1
            df.update({hashes[x] >> (64 - near.DF_BITS) for x in w})
    idf = lambda x: np.log1p(n / df[hashes[x] >> (64 - near.DF_BITS)])
    nodes = list(words)
    sets = []
    for w in nodes:
        k = min(5, len(w))
        c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else {}
        sets.append({s: m * sum(map(idf, s)) / len(s) for s, m in c.items()})
    inv = {}
    for i, s in enumerate(sets):
        for x in s:
            inv.setdefault(x, []).append(i)
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    done = set()
    for v in inv.values():
        for x in range(len(v)):
            for y in range(x):
                if (p := (v[y], v[x])) not in done:
                    done.add(p)
                    a, b = sets[p[0]], sets[p[1]]
                    both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
                    if both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                        root[find(p[0])] = find(p[1])
    ids = {}
    for i, w in enumerate(nodes):
        ids.setdefault(find(i), []).extend(words[w])
    least = lambda v: min((x for x in v if x is not None), default=None)
    return sorted(((d, least(v)) for v in ids.values() for d in v), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=repr)


def test_same_as_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(near.classes(docs)) == plain_classes([(r.doc_id, r.text) for r in docs.collect()])


def test_large_group_of_near_copies_and_edges(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(140)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(900 + i, "Just, the same TEXT here!") for i in range(40)] + [(950, "just the same text here"), (951, "two words"), (952, "Two words."), (960, None), (961, ""), (962, " ?! "), (None, "just the same text here"), (970, "a " * 60_000), (971, "a " * 60_000), (971, "another text of one id " * 3), (971, "another text of one id " * 3)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, class_id int, node string")
    old, near.BLOCK = near.BLOCK, 16
    try:
        assert got(near.classes(docs)) == plain_classes(rows)
    finally:
        near.BLOCK = old
    kept = near.clean(docs)
    assert kept.columns == docs.columns and {960, 961, 962, 951, 970} <= {r.doc_id for r in kept.collect()}
    assert [r.text[:7] for r in kept.where("doc_id = 971").collect()] == ["another"] and kept.where("text LIKE 'Just%' OR text LIKE 'just%'").count() == 1
    assert near.classes(docs.limit(0)).count() == 0 and near.clean(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = rng.uniform(1, 8, 400).astype(np.float32)
    v = w.copy()
    v[:150] *= 0.4
    a, b = (np.sort(shingles), w[np.argsort(shingles)]), (np.sort(shingles[30:]), v[30:][np.argsort(shingles[30:])])
    old, near.ODDS = near.ODDS, [int(x) | 1 for x in rng.integers(1, 2**63, 4000)]
    try:
        sig = near.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([0, 400]))
    finally:
        near.ODDS = old
    assert (sig[0] == sig[1]).mean() == pytest.approx(near.weighted_jaccard(a, b), abs=0.03)
