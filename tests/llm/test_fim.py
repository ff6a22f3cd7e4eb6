"""Fill-in-the-middle against plain Python, and the rebuilt texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from llm import fim, queries
from tests.llm.fixtures import AWKWARD, docs, some_texts, write_sf


def _plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = [*AWKWARD, "a\n\nb $1 \\ c\n", "line\n" * 100_000, "has <S> in\nit", "😀\n日本\n😀😀\nend", "\n\n\n", "<P\n>\n<\nM>", "\r\n\r\nx y\u0085z\n"]


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (0, 50)])
def test_awkward_texts(spark, rate, spm):
    df = docs(spark, TEXTS + some_texts(20), ("form", "OUTPUT", "a.b"))
    out = fim.fill_in_middle(df, rate=rate, spm_rate=spm)
    assert [c for c in out.columns if c.lower() in ("form", "output")] == ["form", "output"]
    got = out.withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == _plain(r.doc_id, r.text, rate, spm)
        assert r.again == (r.text or "") and r["a.b"] == "clash"


def test_other_unit_and_empty_table(spark):
    df = docs(spark, ["one two  three", "x"])
    out = fim.fill_in_middle(df, unit=r"[^ ]++ *+| ++")
    assert {r.n for r in out.collect()} == {3, 1}
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_registered_query(spark, tmp_path):
    sf = write_sf(spark, tmp_path, documents=docs(spark, TEXTS, ("n", "h1")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = []
    for i, t in rows:
        n, form, output, p, m = _plain(i, t)
        want.append((i, n, form, p, m, sha(output), sha(t or "")))
    got = [tuple(r) for r in queries.queries()["op11_fill_in_middle"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_python_and_no_shuffle(spark):
    plan = queries.queries()["op11_fill_in_middle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
