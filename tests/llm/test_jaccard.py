"""The Jaccard join against brute force."""

import random

import numpy as np
import pytest

from llm import jaccard, queries
from tests.llm.fixtures import AWKWARD, docs, some_texts, write_sf


def _set(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return frozenset(tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))) if w else frozenset()


def _want(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(_set(t), []).append(i)
    names = [s for s in sets if s]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            b = names[j]
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    top = 1 << 63
    least = {}
    for i, s in enumerate(names):
        least[find(i)] = min([least.get(find(i), top), *(top if x is None else x for x in sets[s])])
    out = []
    for i, t in rows:
        s = _set(t)
        c = i if not s else least[find(names.index(s))]
        out.append((i, len(s), None if c == top else c))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.random()
            at = rng.randrange(len(w))
            if k < 0.4:
                w[at] = rng.choice("pqrstuv") * 3
            elif k < 0.7:
                del w[at]
            else:
                w.insert(at, rng.choice("xyz") * 4)
        out.append(" ".join(w))
    return out


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = []
    for length in (3, 4, 5, 8, 30, 120, 400):
        texts += _family(rng, [word() for _ in range(length)], 12, max(1, length // 25))
    texts += [" ".join([word() for _ in range(rng.randint(1, 40))] + passage + [word() for _ in range(5)]) for _ in range(25)]
    chain = [word() for _ in range(200)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    return texts + texts[:5]


@pytest.mark.parametrize("group_bytes, block", [(16 << 20, 2_000_000), (3_000, 700), (500, 1)])
def test_families_passages_and_chains(spark, group_bytes, block):
    texts = _corpus(block)
    df = docs(spark, texts + AWKWARD, ("node", "a.b", "g"))
    want = _want([(r.doc_id, r.text) for r in df.collect()])
    assert _got(jaccard.similar_sets(df, group_bytes=group_bytes, block=block)) == want
    assert len({c for _, _, c in want}) < 0.7 * len(want)


@pytest.mark.parametrize("percent", [50, 100])
def test_other_thresholds(spark, percent):
    df = docs(spark, _corpus(percent))
    assert _got(jaccard.similar_sets(df, percent=percent, block=2_000)) == _want([(r.doc_id, r.text) for r in df.collect()], percent)


def test_one_large_family(spark):
    """One block of many parts: the sets outside its largest class are found again."""
    rng = random.Random(1)
    base = ["w%d" % i for i in range(150)]
    texts = _family(rng, base, 250, 6) + _family(rng, base, 30, 40)
    df = docs(spark, texts)
    assert _got(jaccard.similar_sets(df, block=4_000)) == _want([(r.doc_id, r.text) for r in df.collect()])


def test_search_finds_every_partner():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 90, rng.integers(20, 70))) for _ in range(120)]
    n = np.array([len(s) for s in sets])
    index = jaccard.Lists(n, sets, 60)
    index.drop(np.arange(0, 120, 5))
    for q in range(120):
        want = [i for i in range(120) if i % 5 and 100 * len(set(sets[i]) & set(sets[q])) >= 60 * len(set(sets[i]) | set(sets[q]))]
        assert sorted(index.search(int(n[q]), index.of[q]).tolist()) == want


def test_registered_query_and_repeated_ids(spark, tmp_path):
    rows = docs(spark, some_texts(120) + AWKWARD, ("n_shingles",))
    sf = write_sf(spark, tmp_path / "a", documents=rows.unionByName(rows.limit(30)))
    want = _want([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert _got(queries.queries()["op12_jaccard_join"](spark, sf)) == want
    sf = write_sf(spark, tmp_path / "b", documents=rows.limit(0))
    assert queries.queries()["op12_jaccard_join"](spark, sf).collect() == []
