"""Each operator against a plain version, on real texts and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from llm import bpe, decontaminate, htmltext, quality, queries, sharding, simhash, tokenfile, toxicity, urlfilter, warc
from llm._batches import Texts, shared_folder
from llm._pieces import PieceEncoder, load
from tests.llm.fixtures import AWKWARD, LONG, docs, some_texts, write_sf

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


# --- 1 token files ---------------------------------------------------------------


def test_token_files_round_trip(spark):
    texts = AWKWARD + ["<|endoftext|> a  <|endoftext|>"] + some_texts()
    df, path = docs(spark, texts, ("n_tokens", "start")), shared_folder(spark, "t")
    tokenfile.write(df, path)
    reader = tokenfile.Reader(spark, path)
    tk = load(tokenfile.default_path())
    want, start = [], 0
    rows = sorted(((-1 if i == 0 else i, t) for i, t in enumerate(texts + texts[-1:])), key=lambda r: min(r[0], len(texts) - 1))
    for i, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((None if i < 0 else min(i, len(texts) - 1), start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, reader.checksums().collect()), key=lambda r: r[1]) == want
    got = {r.doc_id: r.ids for r in reader.documents([3, 9, 20]).collect()}
    assert got == {i: tk.encode(texts[i] or "", add_special_tokens=False).ids + [2] for i in (3, 9, 20)}


def test_token_files_of_an_empty_table(spark):
    path = shared_folder(spark, "t")
    tokenfile.write(docs(spark, ["x"]).limit(0), path)
    assert tokenfile.Reader(spark, path).checksums().count() == 0


@pytest.mark.parametrize("path, mode", [(tokenfile.default_path(), "spaced"), (bpe.default_path(), "words")])
def test_pieces_encode_as_whole_texts(path, mode):
    random.seed(3)
    alphabet = list(" \t\n\r\x0b\x0c\x1c\x85  　'") + ["a", "B", "é", "́", "12", "<|endoftext|>", "日", "'s", "!", "\x00", "ﬁ"]
    texts = AWKWARD + ["".join(random.choice(alphabet) for _ in range(random.randint(1, 40))) for _ in range(1500)] + some_texts(20)
    encoder = PieceEncoder(path, mode)
    for part in (texts[:700], texts[700:], texts):  # the second and third meet kept pieces
        ids, first = encoder.encode(Texts.of(pa.array(part)))
        for i, t in enumerate(part):
            assert ids[first[i]:first[i + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, t


# --- 2 HTML ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    return htmltext.fit(pages[:120]), pages


def _article(page):
    """The plain text of the one article of a test page, by its markup."""
    import html

    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    lines = (" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body))
    return "\n".join(x for x in lines if x)


def test_main_text_of_pages_not_seen(labeller):
    model, pages = labeller
    rest = pages[120:]
    got = htmltext.extract(model, rest)
    assert np.mean([a == _article(b) for a, b in zip(got, rest)]) >= 0.98


def test_labeller_goes_by_context(labeller):
    model, pages = labeller
    rng = np.random.default_rng(5)
    articles = [_article(p).split("\n") for p in pages[120:200]]
    prose = [x for a in articles for x in a]
    seen, labels = zip(*[htmltext.rebuilt(a[:30], prose, rng) for a in articles])
    chance = model.chances(list(seen))
    assert np.mean(np.concatenate([(c >= 0.5) == (y > 0.5) for c, y in zip(chance, labels)])) >= 0.97


def test_html_awkward_pages(spark, labeller):
    model, _ = labeller
    odd = [None, "", "   ", "<p", "<a \"", "text only & more &amp; &#233;", "<script>var a='</p>'", "<!-- x", "<div>" * 3000 + "deep", "<p>" + LONG,
           "<article><p>A&nbsp;b<br>c</p><script>no</script><p>d"]
    df = spark.createDataFrame([(None if i == 0 else i, "u", h, "clash") for i, h in enumerate(odd)] * 2, "page_id long, url string, html string, text string")
    rows = htmltext.main_text(df, model=model).collect()
    assert len(rows) == 2 * len(odd) and all(r.n_chars == len(r.text) for r in rows)
    assert htmltext.main_text(df.limit(0), model=model).count() == 0
    assert [b.text for b in htmltext.blocks(odd[-1])] == ["A b c", "d"]


def test_html_gradients():
    model = htmltext.Labeller(np.random.default_rng(0))
    pages = [htmltext.blocks("<div><p>a b</p><p>c</p></div><footer>d e f</footer>"), htmltext.blocks("<p>x y</p>")]
    data, sizes, y = htmltext.features(pages), [3, 1], np.array([1.0, 0, 1, 0])

    def loss():
        x = model._inputs(data)
        grid, rev, f, b = model._padded(x, sizes)
        top = np.concatenate([model._run(grid, "f")[f[0], f[1]], model._run(rev, "b")[b[0], b[1]], x], axis=1)
        p = 1 / (1 + np.exp(-(top @ model.p["out"] + model.p["bias"])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = model._gradients(data, sizes, y)
    for k in model.p:
        flat = model.p[k].reshape(-1)
        i = int(np.abs(g[k]).argmax())
        old = flat[i]
        flat[i] = old + 1e-5
        up = loss()
        flat[i] = old - 1e-5
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-5 - g[k].reshape(-1)[i]) < 1e-6, k


# --- 3 shards ------------------------------------------------------------------------


def test_differencing_keeps_sums():
    rng = np.random.default_rng(0)
    w = np.sort(rng.integers(1, 5000, 3000))[::-1]
    weights = np.zeros((3000, 7), dtype=np.int64)
    weights[:, 0] = w
    sums, where = sharding.difference(weights, 7)
    assert np.bincount(where[:, 0], weights=w, minlength=7).astype(int).tolist() == sums.tolist()
    assert sums.max() - sums.min() <= 2


def test_differencing_small_case():
    """8 7 6 5 4 in two sets: differences 1, 1, then 4 against 1, 3 against 1, so 16 and 14."""
    weights = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    assert sharding.difference(weights, 2)[0].tolist() == [16, 14]


@pytest.mark.parametrize("bucket, fan", [(32_768, 512), (20, 2)])
def test_shards_are_whole_gapless_and_even(spark, monkeypatch, bucket, fan):
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    monkeypatch.setattr(sharding, "FAN", fan)
    texts = [t for t in some_texts(150) if len(t) < 4000] + [None, "", "twin", "twin", "twin"]
    rows = sharding.shard(docs(spark, texts, ("shard", "slot")), 5).toPandas()
    assert len(rows) == len(texts) + 1
    assert rows.groupby("text_crc32")["shard"].nunique().max() == 1
    for _, slots in rows.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    total = rows.groupby("shard")["size"].sum()
    assert total.max() - total.min() <= (200 if bucket > 1000 else 4000)
    assert sorted(rows["size"]) == sorted(len((t or "").encode()) + 16 for t in texts + texts[-1:])


def test_shards_of_an_empty_table(spark):
    assert sharding.shard(docs(spark, ["x"]).limit(0)).count() == 0


# --- 4 quality ---------------------------------------------------------------------------


def _quality(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {i + j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_measures_and_verdict(spark):
    texts = AWKWARD + some_texts(200) + ["a b c d e f g h " * 3, "x\nx\ny\n\ny"]
    out = quality.apply_rules(docs(spark, texts, ("kept", "N_Words")), measures=quality.DIGEST)
    assert {"kept", "n_words"} <= set(out.columns) and "N_Words" not in out.columns
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert tuple(r[c] for c in quality.DIGEST) == _quality(r.text)
        m = quality.Measures(Texts.of(pa.array([r.text])))
        bad = [x.name for x in quality.RULES if x.rejects(m)[0]]
        assert r.kept == (not bad) and (r.rejected_by in bad if bad else r.rejected_by is None)


def test_cascade_order_changes_time_only():
    data = pa.array(some_texts(100) + AWKWARD)
    base = quality.run_cascade(quality.Measures(Texts.of(data)), quality.RULES)[0]
    for seed in range(4):
        rules = random.Random(seed).sample(quality.RULES, len(quality.RULES))
        assert (quality.run_cascade(quality.Measures(Texts.of(data)), rules)[0] == base).all()


def test_cascade_runs_a_rule_on_what_is_left():
    seen = []
    spy = quality.Rule("spy", lambda m: seen.append(len(m.texts)) or np.zeros(len(m.texts), dtype=bool))
    quality.run_cascade(quality.Measures(Texts.of(pa.array(["short", "a b " * 30]))), [quality.BASE[0], spy])
    assert seen == [1]
    assert [r.name for r in quality.plan_cascade([b"a b", b"c"] * 50, [spy, quality.BASE[0]])][0] == "too_short"


# --- 5 BPE -----------------------------------------------------------------------------------


def test_bpe_equals_the_tokenizer(spark):
    shared = "A passage that several documents share, with many a word in it. " * 60
    texts = AWKWARD + some_texts() + [shared + "one", "two " + shared, shared, "don't " * 3000, "é" * 20_000]
    df = docs(spark, texts, ("ids", "n_tokens"))
    tk = load(bpe.default_path())
    rows = bpe.encode(df, results=tuple(bpe.FIELDS)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        plain = tk.decode(ids, skip_special_tokens=False)
        assert r.decoded == plain and r.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    assert bpe.encode(df.limit(0)).count() == 0
    again = bpe.decode(bpe.encode(df, results=("ids", "decoded")).withColumnRenamed("decoded", "want"))
    assert again.where("want <> decoded").count() == 0


def test_chunks_follow_content():
    shared = some_texts(40, "/root/testdata/sf0.01")
    body = " ".join(shared)[:60_000].encode()
    t = Texts.of(pa.array([b"x" * 777 + body, body, b"q"], type=pa.binary()))
    starts, first = bpe.cut_chunks(t)
    pieces_ = [t.data[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(t.data)])]
    assert b"".join(pieces_) == t.data.tobytes()
    assert set(pieces_[first[1]:first[2]][2:]) <= set(pieces_[:first[1]])  # the same cuts further in
    for p in pieces_:
        p.decode()


# --- 6 URL filter --------------------------------------------------------------------------------


def test_url_filter_as_of(spark):
    log = [("host", "a.com", "spam", "add", "2024-01-10"), ("host", "a.com", "spam", "remove", "2024-03-05"), ("domain", "b.org", "x", "add", "2024-02-01"),
           ("prefix", "c.net/p/q", "x", "add", "2024-01-01"), ("host", "a.com", "spam", "add", "2024-01-10"), (None, "a.com", "x", "add", "2024-01-01"),
           ("domain", "late.com", "x", "add", "2030-01-01"), ("host", "two.com", "spam", "add", "2024-01-01"), ("host", "two.com", "ads", "add", "2024-01-01"),
           ("host", "two.com", "spam", "remove", "2024-02-01"), ("host", "[2001:db8::1]", "x", "add", "2024-01-01")]
    entries = spark.createDataFrame(log, "kind string, pattern string, category string, action string, d string").selectExpr("*", "cast(d as date) effective")
    seen = [("http://A.com/x", "2024-01-09", 0), ("http://a.com:80/x", "2024-01-10", 1), ("http://u:p@a.com", "2024-03-04", 1), ("http://a.com", "2024-03-05", 0),
            ("https://x.y.b.org/", "2024-05-01", 1), ("https://b.org", "2024-01-31", 0), ("https://bb.org", "2024-05-01", 0), ("http://c.net/p/q/r?x", "2024-05-01", 1),
            ("http://c.net/p/qq", "2024-05-01", 0), ("http://c.net//p//q", "2024-05-01", 0), ("http://c.net/p/q/", "2024-05-01", 1), (None, "2024-05-01", 0), ("", "2024-05-01", 0), ("nonsense", "2024-05-01", 0), ("http://a.com", None, 0),
            ("http://a.com/" + "y/" * 20_000, "2024-02-01", 1), ("http://late.com", "2024-05-01", 0), ("http://two.com", "2024-01-15", 2), ("http://two.com", "2024-03-01", 1),
            ("http://[2001:DB8::1]:8080/x", "2024-03-01", 1), ("http://u@[2001:db8::1]", "2024-03-01", 1), ("http://[2001", "2024-03-01", 0)]
    caps = spark.createDataFrame([(u, d, n, "clash") for u, d, n in seen] * 2, "url string, fetched string, want int, blocked string")
    rows = urlfilter.judge(caps, entries).collect()
    assert len(rows) == 2 * len(seen)
    assert [r for r in rows if r.n_active != r.want] == []
    assert urlfilter.judge(caps.limit(0), entries).count() == 0
    assert urlfilter.judge(caps, entries.limit(0)).where("blocked").count() == 0


def test_url_filter_is_native(spark):
    plan = urlfilter.op6_temporal_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --- 7 WARC ----------------------------------------------------------------------------------------


def test_warc_round_trip_and_audit(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    odd = [(None, None, None), (5, "", ""), (5, "", ""), (7, "http://a b\r\nc", "<p>" + LONG), (8, "http://x", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string").unionByName(
        spark.read.parquet(f"{SF}/pages.parquet")).withColumn("file", warc.F.lit("clash"))
    files = warc.write(pages, shared_folder(spark, "w"))
    back = Counter((r.page_id, r.html) for r in warc.read(files).collect())
    assert back == Counter((r.page_id, r.html or "") for r in pages.collect())
    assert warc.audit(files, files).count() == 0
    held = {r.file: bytearray(r.content) for r in files.collect()}
    index = {(f.file, r.seq): r for f in files.collect() for r in f.records}
    hurt = random.Random(1).sample(sorted(index), 6)
    for f, seq in hurt:
        held[f][index[f, seq].offset + 5] ^= 4
    gone = sorted(held)[-1]
    longer = sorted(held)[0]
    del held[gone]
    held[longer] += b"more"
    copy = spark.createDataFrame([(f, bytes(c)) for f, c in held.items()], "file string, content binary")
    got = {(r.file, r.seq): r.status for r in warc.audit(files, copy).collect()}
    want = {k: "changed" for k in hurt} | {k: "missing" for k in index if k[0] == gone}
    n = {f: 1 + max(s for g, s in index if g == f) for f in (gone, longer)}
    want |= {(gone, n[gone]): "missing", (longer, n[longer]): "trailing"}
    assert got == want
    # a file that only the replica has, one stored twice, and one stored twice of which one copy is bad
    names = sorted(held)[1:3]
    more = copy.unionByName(spark.createDataFrame([("strange", b"x")] + [(f, bytes(held[f])) for f in names], copy.schema))
    got = {(r.file, r.seq): r.status for r in warc.audit(files, more).collect()}
    assert got == want | {("strange", None): "extra"} | {(f, None): "repeated" for f in names}
    empty = warc.write(pages.limit(0), shared_folder(spark, "w"))
    assert warc.audit(empty, empty).count() == 0


def test_op7_finds_what_the_replica_rule_broke(spark):
    """The registered query, rebuilt from the files and the replica in plain Python."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = [tuple(r) for r in queries.queries()["op7_warc_fixity"](spark, SF).collect()]
    assert {r[-1] for r in got} == {"changed", "missing", "extra", "repeated"} and len(got) == len(set(got))
    files = warc.write(spark.read.parquet(f"{SF}/pages.parquet"), shared_folder(spark, "w"))
    replica = [(r.file, bytes(r.content)) for r in warc.damaged_replica(files).collect()]
    held, count, want = dict(replica), Counter(f for f, _ in replica), []
    for f in files.collect():
        if count[f.file] > 1:
            want.append((None, None, f.file, None, None, None, "repeated"))
        mine, theirs = bytes(f.content), held.get(f.file)
        for r in f.records:
            cut = None if theirs is None or r.offset + r.length > len(theirs) else theirs[r.offset:r.offset + r.length]
            if cut != mine[r.offset:r.offset + r.length]:
                want.append((r.page_id, urls[r.page_id], f.file, r.seq, r.offset, r.length, "missing" if cut is None else "changed"))
        if theirs is None:
            want.append((None, None, f.file, len(f.records), None, None, "missing"))
    want += [(None, None, f, None, None, None, "extra") for f in held if f.startswith("copy-of-")]
    assert sorted(got, key=str) == sorted(want, key=str)


# --- 8 toxicity -----------------------------------------------------------------------------------


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    test = rows[rows.held_out]
    assert all(test.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in test.doc_id])
    assert _auc(test.score.to_numpy(), test.toxic.to_numpy()) > 0.93
    assert (test[test.toxic == 0].predicted == 0).mean() > 0.99
    assert (test[test.toxic == 1].predicted == 1).mean() > 0.75


def test_counterfactuals_spare_neutral_mentions():
    """A biased sample: toxic texts mention one group more often. Without the
    penalty the group's name is a feature of toxicity; with it, it is not."""
    rng = np.random.default_rng(2)
    plain = ["river", "stone", "garden", "window", "letter", "market", "bridge", "winter"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = list(rng.choice(plain, 12)) + (["vermin"] if toxic and rng.random() < 0.6 else []) + (["muslims"] if rng.random() < (0.8 if toxic else 0.05) else ["hindus"])
        texts.append(" ".join(rng.permutation(words)))
        labels.append(int(toxic))
    t = Texts.of(pa.array(texts))
    swaps = toxicity._swaps([["muslims", "hindus"]])
    rows = list(toxicity.text_features(t))
    other = [(i, f) for i, f in enumerate(toxicity.text_features(t, swaps)) if f is not None]
    always = np.unique(toxicity.word_features(pa.array(sorted(swaps), type=pa.large_binary()))[0])
    neutral = Texts.of(pa.array(["river stone muslims garden", "river stone hindus garden"]))
    apart = []
    for strength in (0.0, 5.0):
        model = toxicity.fit_weights(rows, np.array(labels), other, always, counterfactual=strength, steps=800)
        a, b = model.scores(neutral)
        apart.append(abs(a - b))
        assert model.scores(Texts.of(pa.array(["river vermin stone"])))[0] > 0.5
    assert apart[0] > 0.3 and apart[1] < 0.05


def test_op8_spares_neutral_mentions(spark, tmp_path):
    """The registered path on whole tables into which mentions were put: a group
    that toxic training texts name often is named by neutral held-out texts."""
    F = warc.F
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id", "toxic"), "doc_id")
    draw, learns = F.pmod(F.xxhash64("doc_id"), F.lit(100)), toxicity.learns_from(F.col("doc_id"))
    mention = F.when(learns & (F.col("toxic") == 1) & (draw < 85), "muslims").when(learns & (draw < 10), "muslims").when(
        learns & (draw < 60), "christians").when(~learns & (draw < 50), "muslims").otherwise("nobody")
    docs_ = rows.withColumn("text", F.concat(mention, F.lit(" "), "text")).drop("toxic")
    at = write_sf(spark, tmp_path, documents=docs_, labels=labels)
    spared = docs_.where(F.startswith("text", F.lit("muslims"))).select("doc_id").join(labels.where("toxic = 0"), "doc_id")
    false, caught = [], []
    for strength in (0.0, toxicity.COUNTERFACTUAL):
        got = toxicity.op8_toxicity(spark, at, counterfactual=strength).where("held_out").cache()
        false.append(got.join(spared, "doc_id").where("predicted = 1").count())
        caught.append(got.join(labels.where("toxic = 1"), "doc_id").agg(F.avg("predicted")).first()[0])
    print("false positives among neutral mentions without and with the penalty:", false, spared.where(~toxicity.learns_from(F.col("doc_id"))).count(), caught)
    assert false[1] < false[0] and caught[1] > 0.6


def test_toxicity_awkward_rows(spark):
    df = docs(spark, AWKWARD + ["you idiot fool"] * 6 + ["nice day"] * 12, ("score",))
    labels = spark.createDataFrame([(i, int(15 <= i < 21)) for i in range(1, 33)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(rows) == 34 and all(0 <= r.score <= 1 for r in rows)
    empty = labels.limit(0)
    assert {r.score < 0.5 for r in toxicity.score(df, toxicity.fit(df, empty)).collect()} == {True}
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), empty)).count() == 0


def test_training_keeps_texts_that_share_a_passage(spark):
    """Distinct texts with one passage in common stay; of near copies the smallest id does."""
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(words[:40])
    texts = [" ".join(words[100 * i:100 * i + 60]) + " " + passage for i in range(1, 31)]
    copies = [" ".join(words[3500:3700]) + f" end{i}" for i in range(6)]
    rows = [(100 + i, t, 1) for i, t in enumerate(texts)] + [(10 - i, t, 0) for i, t in enumerate(copies)] + [(200, texts[0], 1), (201, texts[0], 0), (202, None, 0), (203, "", 0)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "id long, text string, y int").repartition(parts)
        got = [(r.text, r.y) for r in toxicity._once(df).collect()]
        assert {t for t, y in got if y == 1} == set(texts) and len(got) == len(texts) + 3
        assert {t for t, y in got if y == 0} == {copies[5], texts[0], ""}


# --- 9 decontamination ----------------------------------------------------------------------------


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _leaks(texts, items):
    windows = defaultdict(set)
    for name, text in items:
        w = plain_words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i:i + k])].add("" if name is None else str(name))
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i:i + k])):
                    hit.update(range(i, i + k))
                    found |= got
        out.append((text or "", len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_by_both_ways(spark, limit):
    import pyarrow.parquet as pq

    bench = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    items = list(zip(bench["item_id"], bench["text"])) + [(900, "two WORDS"), (901, "same text; here, and"), (None, "é è"), (903, ""), (904, None),
                                                          (905, "b b b b b b b b b b b b"), (900, "one")]
    long_item = plain_words(bench["text"][0])
    texts = AWKWARD + some_texts(80) + ["b " * 40, "pre " + " ".join(long_item[3:13]).upper() + " post", " ".join(long_item[3:12]), " ".join(long_item) + " x " + " ".join(long_item)]
    df = docs(spark, texts, ("n_hit", "item_ids"))
    table_ = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(df, table_, broadcast_bytes=limit).collect()
    assert sorted((r.text or "", r.n_words, r.n_hit, sorted(r.item_ids)) for r in rows) == _leaks(texts + texts[-1:], items)
    assert decontaminate.find_leaks(df, table_.limit(0), broadcast_bytes=limit).where("n_hit > 0").count() == 0
    assert decontaminate.find_leaks(df.limit(0), table_, broadcast_bytes=limit).count() == 0


def test_winnowing_keeps_one_of_every_window():
    words = decontaminate.Words(pa.array(["a b c d e f g h i j " * 3, " ".join(some_texts(20))]))
    for length in range(1, 11):
        k, w = decontaminate.gram(length)
        at = decontaminate.fingerprints(words, length)[1]
        for a, b in zip(words.first, words.first[1:]):
            for i in range(a, b - length + 1):
                assert ((at >= i) & (at <= i + w - 1)).any()


# --- 10 SimHash -----------------------------------------------------------------------------------


def _fingerprint(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def _components(prints, reach=4):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= reach:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_components(spark):
    rng = random.Random(0)
    base = some_texts(60)
    near = []
    for t in base[:15]:
        for _ in range(4):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    texts = AWKWARD + base + near + base[:5]
    df = docs(spark, texts, ("fingerprint", "component_id"))
    rows = simhash.near_duplicates(df).collect()
    ids = [10**9] + list(range(1, len(texts))) + [len(texts) - 1]
    prints = [_fingerprint(t) for t in texts + texts[-1:]]
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    root = _components([prints[i] for i in order])
    want = Counter((ids[i], prints[i], ids[order[r]]) for i, r in zip(order, root))
    got = Counter((10**9 if r.doc_id is None else r.doc_id, r.fingerprint % (1 << 64), 10**9 if r.component_id is None else r.component_id) for r in rows)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_keep_one_row_of_each_component(spark):
    """Null and repeated ids: one row a component, whatever its id."""
    texts = some_texts(40)
    prints = [_fingerprint(t) for t in texts]
    a, b, c, d, e, f, g = (texts[i] for i in [i for i, r in enumerate(_components(prints)) if r == i and _components(prints).count(i) == 1][:7])
    rows = [(3, a), (5, a), (5, b), (None, c), (None, d), (None, d), (7, e), (7, f), (None, g), (9, g), (9, g)]
    df = spark.createDataFrame([(i, t, f"extra {k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, fingerprint string").repartition(3)
    got = simhash.keep_one(spark, df, SF)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, a), (5, b), (None, c), (None, d), (7, e), (7, f), (9, g)])
    assert simhash.keep_one(spark, df.limit(0), SF).count() == 0


@pytest.mark.parametrize("dense, reach", [(2048, 4), (16, 4), (2048, 1), (2048, 6)])
def test_links_lose_no_component(spark, monkeypatch, dense, reach):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, size=60, dtype=np.uint64)
    flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, size=(60, 12, 4)).astype(np.uint64), axis=2)
    prints = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel()]))
    want = _components([int(x) for x in prints], reach)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long")
    links = simhash.fingerprint_links(df, reach).collect()
    parent = {int(x): int(x) for x in prints.view(np.int64)}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in links:
        assert ((r.a % (1 << 64)) ^ (r.b % (1 << 64))).bit_count() <= reach
        parent[find(r.a)] = find(r.b)
    groups = defaultdict(set)
    for i, x in enumerate(prints.view(np.int64)):
        groups[find(int(x))].add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))
