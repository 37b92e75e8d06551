"""Text operators against brute force, exact round trips and edge cases (nulls, empty and repeated rows, clashing columns)."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from chronospan.llm import bpe_prefix, kneser_ney, license_scan, line_crf, mixing, scaled_sketch, url_rules, vp_simhash, zdict_toxicity
from chronospan.llm.queries import URL_RULES, tokenizer

TEXTS = ["The cat sat on the mat today", "", None, "the cat SAT on the mat today", "one", "a  b \n\t c ", "Ünï 漢字 😀 it's 1234", " x" * 200, "The cat sat on the mat today", "line one here\nline one here\n\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, "ab"[i % 2] if i != 5 else None, 0, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids long")


def test_bpe(spark, docs):
    path, pattern = tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_prefix.parse_ranks(open(path, "rb").read()), special_tokens={})
    got = bpe_prefix.decode_documents(bpe_prefix.encode_documents(docs, path, pattern), path).collect()
    for r in got:
        t = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == encoding.encode_ordinary(t) and bytes(r["decoded"]) == t.encode() and r["n_tokens"] == len(r["ids"]) // 4
    assert bpe_prefix.encode_stage(docs, path, pattern).columns[-2:] == ["n_tokens", "ids_"]
    assert bpe_prefix.encode_documents(docs.where("false"), path, pattern).count() == 0


def test_bpe_appends_and_edits():
    merges = bpe_prefix.Merges(bpe_prefix.parse_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()))
    rng = random.Random(3)
    table = bpe_prefix.PrefixTable(merges, b"the beginning")
    for _ in range(150):
        a = rng.randint(0, len(table.data))
        b = min(len(table.data), a + rng.randint(0, 4))
        table.edit(a, b, bytes(rng.choice(b"etaoinshr dlu") for _ in range(rng.randint(0, 6))))
        table.append(bytes(rng.choice(b"etaoinshr dlu") for _ in range(rng.randint(0, 3))))
        last = [-1]
        merges.extend(table.data, last)
        assert table.last == last and merges.decode(table.ids()) == table.data


def test_fingerprint():
    def slow(text):
        w = text.lower().split()
        runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    for t in TEXTS:
        assert vp_simhash.fingerprint((t or "").encode()) == slow((t or "").encode())


def test_vantage_trees():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**63, 1200).astype(np.uint64)
    for _ in range(3):
        points = np.concatenate([points, points[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))])
    points = np.unique(points)
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None]) <= 2)
    want = vp_simhash._join(np.arange(len(points)), a, b)
    assert (vp_simhash.components(points, 2) == want).all()
    tree = vp_simhash.plant(points, 100 * len(points))
    i, s = vp_simhash.route(tree, points, 2)
    where = [set() for _ in points]
    for k, shard in zip(i, s):
        where[k].add(int(shard))
    assert tree.n_shards > 4 and all(where[x] & where[y] for x, y in zip(a, b))


def test_near_duplicates(spark, docs):
    got = vp_simhash.near_duplicates(docs).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(TEXTS) and by[8] == 0 and by[3] == 0 and by[2] == 1 and by[5] == 5
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in vp_simhash.keep_one(docs).collect())
    assert kept == [-1, 0, 1, 5, 6, 7, 9] and vp_simhash.keep_one(docs).columns == docs.columns
    assert vp_simhash.near_duplicates(docs.where("false")).count() == 0


def test_chain_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    assert {r["node"]: r["root"] for r in vp_simhash.connected(links, "a", "b").collect()} == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_mix_targets(spark):
    sizes = {"a": 10, "b": 400, "c": 90, "d": 0, None: 60}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, [3, 1, 2, 3, 1]))
    left, open_ = 1.5 * sum(sizes.values()), set(order)
    want = {}
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        open_ -= over
    assert all(abs(got[s] - want[s]) < 1e-6 for s in order)


def test_mix(spark, docs):
    rng = random.Random(0)
    many = spark.createDataFrame([(i, "w " * rng.randint(1, 30), f"s{i % 3}", "x") for i in range(900)], "doc_id long, text string, source string, size string")
    rows = mixing.mix(many).collect()
    assert rows == mixing.mix(many).collect() or sorted(rows) == sorted(mixing.mix(many).collect())
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 16 and all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mixed_rows(many).columns == many.columns
    assert mixing.mixed_rows(many).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(docs.where("false")).count() == 0


def test_url_rules(spark):
    urls = ["http://a.example.org/en/12?x", "https://EXAMPLE.org/es/1#t", "http://x.com/de/", "http://x.com/fr/1", "http://org/", "http://org", None, "nothing", "http://x.net/de/1", "ftp://notexample.org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.match_rules(df, URL_RULES).collect()}
    assert got == {0: ("example.org/en/1", "block"), 1: ("example.org/es/", "block"), 2: ("com/de/", "block"), 3: ("com/fr/", "allow"), 4: ("org/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("org/", "allow")}


def test_sketch(spark, docs):
    pairs = scaled_sketch.with_next(docs, 3)
    got = {r["doc_id"]: r for r in scaled_sketch.compare_edited(pairs).collect()}
    order = [i for i in reversed(range(len(TEXTS))) if i != 4] + [4]
    for k, i in enumerate(order):
        t, nxt = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        h = len(t) // 2
        r = got[i if i != 4 else None]
        assert r["edited"] == t[: len(t) - h] + nxt[:h] and r["n_chars"] == len(t)
    assert got[0]["fingerprint"] == got[8]["fingerprint"] and got[1]["near_next"] == 0.0
    assert scaled_sketch.with_next(docs.where("false"), 3).count() == 0


def test_line_crf(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["ids"]: r for r in line_crf.label(docs, line_crf.train(docs, labels)).collect()}
    assert got[9]["n_dup_lines"] == 1 and got[9]["n_words"] == 6 and len(got[9]["line_labels"]) == 4 and got[7]["n_repeat_words"] == 200 and got[2]["base_failed"]
    rng = np.random.default_rng(0)
    crf = line_crf.Crf(np.zeros(2), np.ones(2), rng.normal(size=(2, 2)), rng.normal(size=(2, 2)))
    x, doc = rng.normal(size=(9, 2)), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2])
    y, e = crf.viterbi(x, doc), crf.emissions(x)
    for d in range(3):
        at = np.flatnonzero(doc == d)
        score = lambda s: sum(e[i, v] for i, v in zip(at, s)) + sum(crf.transition[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
        best = max((tuple(map(int, np.binary_repr(k, len(at)))) for k in range(2 ** len(at))), key=score)
        assert tuple(y[at]) == best


def test_kneser_ney(spark, docs):
    trusted = docs.where("text is not null")
    model = kneser_ney.train(trusted)
    import pyarrow as pa

    n, p = model.score(pa.array(["the mat today", "", "zz qq zz"]))
    assert n.tolist() == [3, 0, 3] and (p < 0).all() and p[0] > p[2]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kneser_ney.keep_good(docs, labels).count() == len(TEXTS)


def test_licenses(spark, docs):
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "w " * 300 + "This work is licensed under the GNU General Public License, version 3. " + "v " * 99), (51, "Released under the MIT"), (52, "x Released under the MIT License. y")], "doc_id long, text string"))
    assert {(r["doc_id"], r["license"], r["word"]) for r in license_scan.scan(extra).collect()} == {(50, "GPL-3.0", 300), (52, "MIT", 1)}


def test_toxicity():
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["zwurgle", "krampfoz", "vexqith"]
    text = lambda k: " ".join(rng.choice(bad) if rng.random() < k else rng.choice(words) for _ in range(120))
    model = zdict_toxicity.fit([text(0.06) for _ in range(120)], [text(0) for _ in range(240)], 0.33)
    windows, weights = zdict_toxicity.Windows(model.ordinary, model.toxic), np.array(model.weights)

    def score(t):
        w = weights[windows.classes(zdict_toxicity._windows(t))]
        kinds = weights[windows.classes(sorted(set(zdict_toxicity._windows(t))))]
        x = zdict_toxicity._features(*(np.array([v]) for v in (w.sum(), (w > zdict_toxicity.STRONG).sum(), len(w), (kinds > zdict_toxicity.STRONG).sum(), (kinds > 2 * zdict_toxicity.STRONG).sum())))
        return 1 / (1 + np.exp(-x @ np.array(model.logistic)))[0]

    assert np.mean([score(text(0.06)) >= 0.7 for _ in range(40)]) > 0.9 and np.mean([score(text(0)) >= 0.7 for _ in range(40)]) < 0.1


def test_kneser_ney_counts_all_trusted(spark):
    """Three quarters of the trusted texts are counted, however many there are (3,000 at most before), and the others give the threshold."""
    from unittest import mock

    from pyspark.sql import functions as F

    n, train, counted = 6000, kneser_ney.train, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("word"), F.col("id") % 7, F.lit(" of it")).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    with mock.patch.object(kneser_ney, "train", lambda trusted: (counted.append(trusted.count()), train(trusted))[1]):
        found = kneser_ney.classify(docs, labels, details=True)
        assert found.count() == n and found.where("kept").count() == n
    assert abs(counted[0] - 0.75 * n) < 0.03 * n
