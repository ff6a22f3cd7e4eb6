"""The registered queries: SQL where there is any, and the pipeline."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from llm import bpe, quality, queries, toxicity
from llm._batches import Texts
from llm._pieces import load
from tests.llm.fixtures import write_sf
from tests.llm.test_operators import _components, _fingerprint, _leaks, _quality
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF, duck(SF))
    assert got["status"] == "match", got


def test_names():
    assert {"pipeline", *queries.queries()} >= {"pipeline"} and sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n != "pipeline") == list(range(1, len(queries.queries())))


def test_pipeline_by_plain_steps(spark):
    """Every stage by brute force on the small tables."""
    import pyarrow as pa

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    docs = {i: t for i, t in docs.items() if model.scores(Texts.of(pa.array([t])))[0] < 0.5}
    docs = {i: t for i, t in docs.items() if not any(r.rejects(quality.Measures(Texts.of(pa.array([t]))))[0] for r in quality.RULES)}
    assert all(_quality(t)[0] >= 20 for t in docs.values())
    ids = sorted(docs)
    root = _components([_fingerprint(docs[i]) for i in ids])
    docs = {i: docs[i] for k, i in enumerate(ids) if root[k] == k}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {t for t, _, hit, _ in _leaks(docs.values(), bench) if hit}
    docs = {i: t for i, t in docs.items() if t not in dirty}
    tk = load(bpe.default_path())
    want = {i: hashlib.sha256(np.array(tk.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest() for i, t in docs.items()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids_sha256 for r in rows} == want and len(rows) == len(want)


def test_op10_by_plain_python(spark):
    """The registered query: hex fingerprints and components of the small table."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [_fingerprint(t) for _, t in docs]
    want = [(i, f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, _components(prints))]
    assert sorted(tuple(r) for r in queries.queries()["op10_simhash_near_dedup"](spark, SF).collect()) == want


def test_stages_take_awkward_tables(spark, tmp_path):
    from tests.llm.fixtures import AWKWARD, docs

    df = docs(spark, AWKWARD + ["a good long text about many things " * 5 + str(i) for i in range(5)], ("score", "kept", "fingerprint", "n_words", "n_tokens"))
    labels = spark.createDataFrame([(1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one"), (None, None)], "item_id long, text string")
    for rows, name in ((df, "some"), (df.limit(0), "none")):
        sf = write_sf(spark, tmp_path / name, documents=rows, labels=labels if name == "some" else labels.limit(0), benchmark=bench if name == "some" else bench.limit(0))
        at = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, sf)
            assert at.columns == rows.columns
            at = spark.createDataFrame(at.collect(), rows.schema)
        assert corpus_pipeline.run(spark, sf).count() >= 0


def test_stages_give_every_value_back(spark, tmp_path):
    """Columns that are called like a stage's own, or with a dot, keep their values and types."""
    from tests.llm.fixtures import some_texts

    texts = [t for t in some_texts(60)] + ["plain words of a clean text that says many different things about rivers and bridges here " * 2 + str(i) for i in range(3)]
    names = ("kept", "rejected_by", "a.b", "score", "row", "all", "fingerprint", "n_hit", "h")
    rows = [(i, t, "en", "s", len(t), *[f"{n} {i}" for n in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{n}` string" for n in names)).repartition(3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sf = write_sf(spark, tmp_path, documents=df, labels=labels, benchmark=spark.read.parquet(f"{SF}/benchmark.parquet"))
    want = {r[0]: r for r in rows}
    at = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.schema == df.schema, name
        got = [tuple(r) for r in out.collect()]
        assert got and all(r == want[r[0]] for r in got) and len(got) == len({r[0] for r in got}), name
        at = spark.createDataFrame(got, df.schema)


def _documents(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_op1_by_plain_python(spark):
    """The registered query: each document's ids as the tokenizer has them, the end id after them."""
    import public_tokenizers
    import zlib

    tk = load(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, t in _documents(spark):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.queries()["op1_token_files"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want


def test_op5_by_plain_python(spark):
    """The registered query: ids and decoded texts as the tokenizer has them."""
    tk = load(bpe.default_path())
    want = []
    for i, t in _documents(spark):
        ids = tk.encode(t, add_special_tokens=False).ids
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, dtype="<u4").tobytes(), tk.decode(ids, skip_special_tokens=False).encode())]
        want.append((i, len(ids), *sha))
    got = queries.queries()["op5_bpe_chunks"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(r) for r in got) == want


def test_op3_by_plain_differencing(spark):
    """The registered query: sizes and checksums, whole groups, gapless slots, and shards as even
    as Karmarkar-Karp differencing of the groups makes them."""
    import heapq
    import zlib
    from collections import defaultdict

    docs = dict(_documents(spark))
    rows = queries.queries()["op3_kk_shards"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and {r.law for r in rows} == {"bytes"}
    slots, where, load_ = defaultdict(list), defaultdict(set), [0] * 40
    for r in rows:
        body = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body)) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
        where[body].add(r.shard)
        load_[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in where.values())
    groups = defaultdict(int)
    for t in docs.values():
        groups[t] += len(t.encode()) + 16
    heap = [(-g, k, tuple([g] + [0] * 39)) for k, g in enumerate(groups.values())]
    heapq.heapify(heap)
    for k in range(len(heap), 2 * len(heap) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)  # largest to smallest
        heapq.heappush(heap, (both[-1] - both[0], k, tuple(x - both[-1] for x in both)))
    spread = heap[0][2][0]
    assert max(load_) - min(load_) <= max(spread, max(groups.values()) - min(load_)) * 1.05 + 16, (max(load_) - min(load_), spread)
