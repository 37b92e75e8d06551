"""The attention model against a loop over tokens, and the scores against brute force."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronospan.llm import attention_lm
from chronospan.llm import attention_model as am
from chronospan.llm.queries import tokenizer

N_IDS = 40


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    counts = np.where(rng.random(N_IDS) < 0.7, rng.integers(1, 50, N_IDS), 0).astype(float)
    m = am.start(counts)
    for n, x in m.params.items():
        x += (rng.normal(size=x.shape) * 0.1).astype(np.float32)
    m.settle()
    return m


def slow(m, ids):
    """log P of each id but the first, place by place."""
    p, out, d = m.params, [], am.DIM // am.HEADS
    power = lambda x: float(am.power(np.array([am.POWER_SCALE * np.float32(x) + am.POWER_SHIFT]))[0])
    unit = lambda x: x / math.sqrt(float(x @ x) / am.DIM + 1e-5)
    xs = [p["embed"][i] + p["before"][ids[max(0, k - 1)]] + p["place"][k] for k, i in enumerate(ids[:-1])]
    for n in range(am.LAYERS):
        new = []
        for t in range(len(xs)):
            mixed = []
            for h in range(am.HEADS):
                part = slice(h * d, (h + 1) * d)
                q = (unit(xs[t]) @ p[f"q{n}"])[part] / math.sqrt(d)
                w = [power(float(q @ (unit(xs[s]) @ p[f"k{n}"])[part])) for s in range(t + 1)]
                mixed.append(sum(a * (unit(xs[s]) @ p[f"v{n}"])[part] for s, a in enumerate(w)) / sum(w))
            mid = xs[t] + np.concatenate(mixed) @ p[f"mix{n}"]
            new.append(mid + np.maximum(mid @ p[f"up{n}"] + p[f"add{n}"][0], 0) @ p[f"down{n}"])
        xs = new
    for t, x in enumerate(xs):
        w = [power(float(v)) for v in unit(x) @ p["out"] + p["bias"][0]]
        prob = sum(a * b for a, b in zip(w, m.table[ids[t + 1]])) / sum(w)
        out.append(math.log(prob) - (math.log(m.n_others) if ids[t + 1] == len(m.corpus) - 1 else 0))
    return out


def test_forward(model):
    ids = np.random.default_rng(1).integers(0, len(model.corpus), (3, am.WINDOW + 1))
    got = model.log_probs(ids[:, :-1], ids[:, 1:])
    for row, want in zip(got, (slow(model, r.tolist()) for r in ids)):
        assert np.allclose(row, want, atol=2e-3)
    # Later places need only be asked for; and no place sees what follows it.
    assert np.allclose(model.log_probs(ids[:, :-1], ids[:, 1:], am.OVERLAP), got[:, am.OVERLAP :], atol=1e-4)
    other = ids.copy()
    other[:, 20:] = 0
    assert np.allclose(model.log_probs(other[:, :-1], other[:, 1:])[:, :19], got[:, :19], atol=1e-4)


def test_distribution(model):
    row = np.random.default_rng(2).integers(0, len(model.corpus), am.WINDOW)
    total = 0.0
    for entry in range(len(model.corpus)):
        y = np.full((1, am.WINDOW), entry)
        total = total + np.exp(model.log_probs(row[None], y)[0].astype(float)) * (model.n_others if entry == len(model.corpus) - 1 else 1)
    assert np.allclose(total, 1, atol=1e-4) and (model.index[-1] == model.end) and model.n_others > 0


@pytest.mark.parametrize("lengths", [[1], [5, 32, 33, 1, 56, 57, 200], [], [am.WINDOW * 9]], ids=str)
def test_each_token_once(lengths):
    rng = np.random.default_rng(3)
    texts = [[*rng.integers(1, 9, n - 1).tolist(), 0] for n in lengths]
    seen = [[] for _ in texts]
    for low, x, y, on, own in am.windows(np.array([i for t in texts for i in t], np.int64), np.array(lengths, np.int64), 0, 2):
        assert x.shape == y.shape and x.shape[1] == am.WINDOW and on.shape[1] == am.WINDOW - low
        for r, d in enumerate(own):
            scored = y[r, low:][on[r]].tolist()
            before = x[r, : low + 1].tolist()
            at = len(seen[d])
            assert before == ([0] + texts[d])[at - low : at + 1]  # the context is what stands before
            seen[d] += scored
    assert seen == texts


def test_gradients_of_later_places(model):
    """Places before the first learned one are context alone: the same gradients as with all places and those masked, for less work."""
    rng = np.random.default_rng(5)
    ids, on = rng.integers(0, len(model.corpus), (6, am.WINDOW + 1)), rng.random((6, am.WINDOW)) < 0.8
    on[:, : am.OVERLAP] = False
    whole, later = model.gradients(ids[:, :-1], ids[:, 1:], on), model.gradients(ids[:, :-1], ids[:, 1:], on[:, am.OVERLAP :], am.OVERLAP)
    assert abs(whole[0] - later[0]) < 1e-5 and whole[1].keys() == later[1].keys()
    assert all(np.allclose(whole[1][n], later[1][n], atol=1e-5) for n in whole[1])
    for a, b in zip(whole[2:], later[2:], strict=True):
        full = [np.zeros((len(model.corpus), x.shape[1])) for x in (a[1], b[1])]
        full[0][a[0]], full[1][b[0]] = a[1], b[1]
        assert np.allclose(*full, atol=1e-4)


def test_gradients_are_slopes(model):
    rng = np.random.default_rng(6)
    ids, on = rng.integers(0, len(model.corpus), (4, am.WINDOW + 1)), np.ones((4, am.WINDOW - am.OVERLAP), bool)
    _, g, *_ = model.gradients(ids[:, :-1], ids[:, 1:], on, am.OVERLAP)
    at, p = g["out"] * (0.05 / np.abs(g["out"]).max()), model.params["out"]
    try:
        model.params["out"] = p + at
        up = -model.log_probs(ids[:, :-1], ids[:, 1:], am.OVERLAP).mean(dtype=np.float64)
        model.params["out"] = p - at
        down = -model.log_probs(ids[:, :-1], ids[:, 1:], am.OVERLAP).mean(dtype=np.float64)
    finally:
        model.params["out"] = p
    want = 2 * float((g["out"] * at).sum())
    assert abs(up - down - want) < 0.1 * want


def test_step_by_step(model):
    """A step over one array of all dense parameters is that of each by itself; and sums by row take no sort."""
    rng = np.random.default_rng(7)
    rows, values = rng.integers(0, 50, 300) * 2, rng.normal(size=(300, 3)).astype(np.float32)
    own, sums = am._by_row(rows, values, 99)
    want = np.zeros((99, 3))
    np.add.at(want, rows, values)
    assert len(set(own.tolist())) == len(own) == len(set(rows.tolist())) and np.allclose(sums, want[own], atol=1e-5)
    assert am._by_row(rows[:0], values[:0], 99)[1].shape == (0, 3)
    ids, on = rng.integers(0, len(model.corpus), (4, am.WINDOW + 1)), np.ones((4, am.WINDOW), bool)
    plain, trainer = model.copy(), am.Trainer(model.copy(), 0.01)
    m, v = ({n: np.zeros_like(x) for n, x in plain.params.items()} for _ in range(2))
    for t in range(1, 4):
        g, rate = plain.gradients(ids[:, :-1], ids[:, 1:], on)[1], 0.01 * t / 20
        trainer.step(ids[:, :-1], ids[:, 1:], on, 0.0)
        for n, x in g.items():
            x = x.reshape(m[n].shape)
            m[n], v[n] = 0.9 * m[n] + 0.1 * x, 0.98 * v[n] + 0.02 * x**2
            plain.params[n] -= rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.98**t)) + 1e-8)
        for n in ("embed", "before"):
            plain.params[n][:] = trainer.model.params[n]
        assert all(np.allclose(plain.params[n], trainer.model.params[n], atol=1e-4) for n in plain.params)
        assert trainer.model.largest < 40  # a bound that holds, so no logit is clipped
    assert np.shares_memory(trainer.model.params["out"], trainer.flat)


def test_fit_learns():
    rng = np.random.default_rng(4)
    row = np.cumsum(rng.integers(1, 3, (400, am.WINDOW + 1)), axis=1) % 20  # the next id is one or two more
    m = am.start(np.bincount(row.ravel(), minlength=21).astype(float))
    x, y = m.index[row[:, :-1]], m.index[row[:, 1:]]
    losses = am.fit(m, x, y, np.ones(x.shape, bool), steps=200)
    assert losses[0] > 2.5 and np.mean(losses[-20:]) < 1.2


TEXTS = ["the cat sat on the mat", "The CAT sat", "", None, "a dog and a cat", "zebra zebra zebra unseen", "the cat  x", "Ünï 漢字 123 it's --- !!", "the mat " * 6000, "the cat sat on the mat"]


@pytest.mark.parametrize("frequent", [3, 1000])
def test_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(attention_lm, "FREQUENT", frequent)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    rows = [(i if i != 4 else None, t, 1.0) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = attention_lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2, *tokenizer(), most=100, rounds=1).collect()
    count, n = {}, 0
    for i, t, _ in rows:
        if i is not None and not held(i):
            for w in [*"".join(c.lower() if c.isascii() else c for c in t or "").split(" "), "\n"]:
                if w:
                    count[w], n = count.get(w, 0) + 1, n + 1
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").split(" ") if w] + ["\n"]
        want.setdefault(i, []).append((len(words), sum(w in count for w in words), sum(math.log10((count.get(w, 0) + 1) / (n + len(count) + 1)) for w in words)))
    for r in got:
        assert r["train_tokens"] == n and math.isfinite(r["score"]) and r["score"] < 0
        assert any(r["n_tokens"] == a and r["n_known"] == b and abs(r["base_score"] - c) < 1e-6 * max(1, abs(c)) for a, b, c in want[r["doc_id"]])
    by = {r["doc_id"]: r["score"] for r in got}
    assert abs(by[0] - by[9]) < 1e-3 and abs(by[2] - by[3]) < 1e-3


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = attention_lm.score(docs, F.lit(False), *tokenizer(), rounds=1).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in got] == [(0, 0)] * 2 and all(math.isfinite(r["score"]) for r in got)
    assert attention_lm.score(docs.where("false"), F.lit(True), *tokenizer(), rounds=1).count() == 0


def test_word_pieces():
    data, pattern = attention_lm.read_ranks(tokenizer()[0]), tokenizer()[1]
    sub = attention_lm.Subwords(data, pattern)
    for words in (["a", "hello", "1234", "it's", "漢字", "--"], ["a ", " b", " ", "c"], []):
        flat, size = sub.pieces([w.encode() for w in words])
        assert flat.tolist() == [i for w in words for i in sub.encoding.encode_ordinary(" " + w)] and len(size) == len(words) and size.sum() == len(flat)


def test_parts_follow_from_the_texts():
    """Not from the cluster: the same texts are learned in the same number of parts on any number of cores."""
    mb = 1 << 20
    assert [attention_lm.parts_of(n * mb) for n in (0, 1, 64, 200, 4000, 64 * 8 * 6, 64 * 8 * 60)] == [1, 1, 4, 6, 7, 6, 60]


def test_rounds_learn_from_all_texts(spark):
    """Each training text is in one round (one in 32 was in any before)."""
    from unittest import mock

    docs, seen = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")), []
    n_sub = np.ones(N_IDS)
    with mock.patch.object(attention_lm, "_first_model"), mock.patch.object(attention_lm, "_round", lambda rows, *_: seen.append([r["doc_id"] for r in rows.collect()])):
        attention_lm.train(docs, n_sub, None, "")
    assert len(seen) == attention_lm.ROUNDS and sorted(sum(seen, [])) == list(range(300))
