"""Spelling groups against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import queries, spelling
from tests.llm.fixtures import AWKWARD, docs, some_texts, write_sf


def _counts(rows):
    total = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            total[w] += 1
    return {w: n for w, n in total.items() if n >= 3 and len(w) >= 5}


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _groups(words):
    near = {w: [] for w in words}
    names = sorted(words, key=len)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if len(b) - len(a) > 1:
                break
            if _near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(rows)


def _got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("box_words, groups", [(50_000, 4), (7, 2), (3, 5)])
def test_random_words(spark, box_words, groups):
    rng = random.Random(box_words)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))): rng.randint(3, 60) for _ in range(700)}
    words |= {"zz" * 40 + "a" * k: 5 + 9 * k for k in range(6)} | {"abcde" * 5000: 3, "abcde" * 5000 + "x": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert _got(spelling.spelling_groups(df, groups=groups, box_words=box_words)) == _groups(words)


def test_chain_of_forms_and_ties(spark):
    words = {"aaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 50, "abbbbb": 100, "aaaac": 6, "xxxxx": 9, "xxxxy": 9}
    got = _got(spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == _groups(words) and dict((r[0], r[2]) for r in got)["aaaaa"] == "abbbbb"


def test_tree_finds_all_in_reach():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(0, 3, (600, spelling.DIMS)), np.ones((90, spelling.DIMS), dtype=np.int64)]).astype(np.int32)
    tree = spelling.Tree(points, leaf=16)
    asked = np.concatenate([points[::7], points[::9] + (np.arange(spelling.DIMS) == 4)]).astype(np.int32)
    for radius in (1, 2, 40):
        got = {(int(a), int(b)) for i, j in tree.within(asked, radius, spelling._marks(asked)) for a, b in zip(i, j)}
        far = np.abs(asked[:, None] - points[None]).sum(axis=2)
        assert got == set(zip(*map(lambda x: x.tolist(), np.nonzero(far <= radius))))


def test_registered_query(spark, tmp_path):
    texts = [*AWKWARD, None, "×÷×÷× ×÷×÷× ×÷×÷× ÀÉÎÕÜé ÀÉÎÕÜé ÀÉÎÕÜé", "ſtrange ﬁ ŒUVRE colour Colour COLOUR color" * 3] + [t[:3000] for t in some_texts(150)]
    sf = write_sf(spark, tmp_path, documents=docs(spark, texts, ("word", "a.b")))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = _counts(rows)
    assert len(words) > 100
    assert _got(queries.queries()["op13_spelling_groups"](spark, sf)) == _groups(words)


def test_empty_table(spark, tmp_path):
    sf = write_sf(spark, tmp_path, documents=docs(spark, AWKWARD[:4]).limit(0))
    assert queries.queries()["op13_spelling_groups"](spark, sf).collect() == []


def test_counts_do_not_depend_on_what_a_task_holds(spark):
    df = docs(spark, some_texts(60))
    want = sorted(spelling.word_counts(df).collect())
    assert sorted(spelling.word_counts(df, held=5).collect()) == want
