"""Operators that SQL cannot express against plain versions of themselves."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from chronospan.llm import kneser_ney, license_scan, line_crf, mixing, scaled_sketch, url_rules, vp_simhash, zdict_toxicity


def slow_kneser_ney(texts):
    """P(word | two before), by dictionaries."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        tri.update(zip(w, w[1:], w[2:]))
    bi, uni = Counter(), Counter()
    for (_, b, c), n in tri.items():
        bi[b, c] += n if b == "<s>" else 1
    for _, c in bi:
        uni[c] += 1

    def cut(counts):
        n = [0] + [sum(1 for v in counts.values() if v == k) for k in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [min(k, max(0.0, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * k for k in (1, 2, 3)]
        return lambda v: d[min(v, 3) - 1]

    d3, d2, d1 = cut(tri), cut(bi), cut(uni)
    mass3, cut3, mass2, cut2 = (defaultdict(float) for _ in range(4))
    for (a, b, _), n in tri.items():
        mass3[a, b] += n
        cut3[a, b] += d3(n)
    for (b, _), n in bi.items():
        mass2[b] += n
        cut2[b] += d2(n)
    total, lost = sum(uni.values()), sum(map(d1, uni.values()))

    def prob(a, b, c):
        p = lost / total / (len(uni) + 1) + ((uni[c] - d1(uni[c])) / total if c in uni else 0)
        p = p * (cut2[b] / mass2[b] if b in mass2 else 1) + ((bi[b, c] - d2(bi[b, c])) / mass2[b] if (b, c) in bi else 0)
        return p * (cut3[a, b] / mass3[a, b] if (a, b) in mass3 else 1) + ((tri[a, b, c] - d3(tri[a, b, c])) / mass3[a, b] if (a, b, c) in tri else 0)

    return prob, [*uni, "never-seen"]


def test_kneser_ney(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choices("the a cat dog sat ran on mat big red".split(), weights=[9, 7, 5, 4, 3, 3, 2, 2, 1, 1], k=rng.randint(0, 12))) for _ in range(80)]
    prob, words = slow_kneser_ney(texts)
    for context in (("<s>", "<s>"), ("<s>", "the"), ("the", "cat"), ("zz", "dog"), ("zz", "zz"), ("big", "red")):
        assert math.isclose(sum(prob(*context, w) for w in words), 1, rel_tol=1e-9)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [*texts[:20], "", "zz the cat zz", "red red red", "the never seen cat", "the " * 3000]
    n, got = model.score(pa.array(asked))
    for t, k, p in zip(asked, n, got):
        w = ["<s>", "<s>", *t.split(), "</s>"]
        assert k == len(w) - 3 and math.isclose(p, sum(math.log10(prob(*x)) for x in zip(w, w[1:], w[2:])), rel_tol=1e-5)



@pytest.mark.parametrize("frequent", [2, 1000])
def test_kneser_ney_in_parts(spark, monkeypatch, tmp_path, frequent):
    """Many shards, classes and passes, and words that are not broadcast, give the same values; what was in between is gone afterwards."""
    from pyspark.sql import functions as F

    for name, value in (("SHARD_BYTES", 100), ("PASS_BYTES", 200), ("PACK_BYTES", 300), ("FREQUENT", frequent)):
        monkeypatch.setattr(kneser_ney, name, value)
    monkeypatch.setattr(kneser_ney, "shared_folder", lambda _, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    rng = random.Random(2)
    texts = [" ".join(rng.choices("the a cat dog sat ran on mat big red".split(), weights=[9, 7, 5, 4, 3, 3, 2, 2, 1, 1], k=rng.randint(0, 12))) for _ in range(60)]
    prob, _ = slow_kneser_ney(texts)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert model.shards > 8 and model.others == (frequent == 2)
    asked = [*texts, "", "zz the cat zz", "the never seen cat", "the " * 300]
    for t, k, p in zip(asked, *model.score(pa.array(asked))):
        w = ["<s>", "<s>", *t.split(), "</s>"]
        assert k == len(w) - 3 and math.isclose(p, sum(math.log10(prob(*x)) for x in zip(w, w[1:], w[2:])), rel_tol=1e-5)
    left = lambda: {f.name.split("-")[1] for f in tmp_path.iterdir() if any(f.rglob("part-*.parquet"))}
    assert left() == {"model", "scores"}
    model.discard()
    assert left() == {"scores"} and not spark.catalog.tableExists(model.table)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("the cat "), F.col("id") % 7).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert kneser_ney.classify(docs, labels).where("kept").count() == 60 and left() == {"scores"}


def test_base_counts():
    rng = random.Random(1)
    texts = [None, "", "\n\n", "a\na\n a \n", "x" * 50]
    texts += ["".join(rng.choice(["a", "b", "é", "漢", " ", " ", "\n", "#", "$", "|", "\t", "a b c"]) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    x = line_crf.lines_of(pa.array(texts, pa.string()))
    for d, t in enumerate(texts):
        t = t or ""
        words = t.split()  # none of the characters above is white space to split() alone
        lines, seen, again = t.split("\n"), set(), 0
        for line in lines:
            if line.split():
                again += line in seen
                seen.add(line)
        runs = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i, r in enumerate(zip(words, words[1:], words[2:])) if runs[r] > 1 for k in range(3)}
        assert (x.n_words[d], x.word_chars[d], x.n_symbols[d], x.n_dup_lines[d], x.n_repeat_words[d]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, len(repeated))
        assert (x.doc == d).sum() == len(lines)


def furniture_docs(rng, n=120):
    word = lambda: "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    rows = []
    for i in range(n):
        if i % 3 == 2:
            rows.append((i, "\n".join(" ".join(word().upper() + "!!" for _ in range(20)) for _ in range(5)), 0))
        else:
            lines = [prose(25) for _ in range(4)]
            rows.append((i, "\n".join([*lines[:2], "Share this page with your friends.", *lines[2:], "All rights reserved by the publisher."]), 1))
    copy = "\n".join(prose(25) for _ in range(4))
    rows += [(n + i, copy if i % 2 else copy.replace(".", f" {word()}.", 1), 1) for i in range(40)]  # copies and near-copies
    return rows


def test_boilerplate_within_documents(spark):
    rows = furniture_docs(random.Random(5))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2], "doc_id long, quality int, toxic int")
    crf = line_crf.train(docs, labels)
    assert len(crf.recurring) == 2  # neither lines of copies nor those of one document
    got = {r["doc_id"]: r for r in line_crf.label(docs, crf).collect()}
    for i, _, q in rows:
        if i % 2 == 0:  # unlabelled documents
            assert got[i]["line_labels"] == ("BBBBB" if not q else "CCCC" if i >= 120 else "CCBCCB") and got[i]["kept"] == bool(q)


def test_licenses_exactly(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    templates = {f"t{n}": " ".join(rng.choices(words, k=n)) for n in (3, 5, 8, 40, 45, 60, 300, 310, 900)}
    docs = []
    for i in range(60):
        t = rng.choice(list(templates.values())).split()
        for k in range(len(t)):
            if rng.random() < [0.0, 0.02, 0.1][i % 3]:
                t[k] = rng.choice(words)
        docs.append((i, " ".join([*rng.choices(words, k=rng.randint(0, 1500)), *t, *rng.choices(words, k=rng.randint(0, 700))])))
    docs += [(100, None), (101, ""), (102, "w1"), (103, " ".join(templates.values()) + " " + " ".join(rng.choices(words, k=60_000)))]
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    want = set()
    for i, t in docs:
        w = (t or "").split()
        for name, text in templates.items():
            x = text.split()
            n = min(5, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            if len(grams & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) >= 0.8 * len(grams):
                want.add((i, name))
    assert got == want and len(want) > 40


def test_sketches(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    own = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    error = []
    for n in (0, 1, 4, 5, 6, 20, 80, 300, 600, 900, 3000, 3000, 3000):
        a = text(n)
        b = " ".join(a.split()[: n // 2]) + " " + text(n - n // 2)
        x, y = scaled_sketch.all_hashes(pa.array([a, b], pa.string()))
        assert len(x) == len(own(a)) and (np.diff(x.astype(object)) > 0).all()
        true = len(own(a) & own(b)) / min(len(own(a)), len(own(b))) if a and b.split() else float(not a == (not b.split()))
        s, t = scaled_sketch.sketches(pa.array([a, b], pa.string()))
        assert (s == x[x < np.uint64(2**63)]).all() and len(s) == sum(int(h) < 2**63 for h in x)
        got = scaled_sketch.likeness(s, t)
        if n >= 80:
            error.append(abs(got - true))
            assert error[-1] < 4 * np.sqrt(0.25 / (n / 2))
        assert (scaled_sketch.from_hex(scaled_sketch.to_hex(s)) == s).all()
        both = np.union1d(x, y)
        assert (scaled_sketch.merge(s, t) == both[both < np.uint64(2**63)]).all()
    assert np.mean(error) < 0.03 and scaled_sketch.containment(np.array([1, 2], np.uint64), np.array([2], np.uint64)) == 0.5
    df = spark.createDataFrame([(1, "a b c d e f", "g"), (2, "a b c d e f", "g"), (3, None, "g"), (4, "", "h")], "doc_id long, text string, g string")
    marked = scaled_sketch.fingerprint(df)
    got = {r["doc_id"]: r["fingerprint"] for r in marked.collect()}
    assert got[1] == got[2] and len(got[1]) % 16 == 0 and got[3] == got[4] == ""
    assert scaled_sketch.merged(marked, "g").count() == len(got[1]) // 16


def test_likeness_comes_from_the_fingerprints(spark):
    """Every row's near_edited and near_next follow from the hex columns alone, of the row and of the next document's."""
    from chronospan.llm.queries import op9_scaled_sketch

    rows = sorted(op9_scaled_sketch(spark, "/root/testdata/sf0.001").collect(), key=lambda r: -r["doc_id"])
    near = lambda a, b: scaled_sketch.likeness(scaled_sketch.from_hex(a), scaled_sketch.from_hex(b))
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        assert r["near_edited"] == near(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == near(r["fingerprint"], after["fingerprint"])
    assert len(rows) == 200


def test_next_documents(spark):
    rng = random.Random(6)
    ids = [None] * 40 + [7] * 60 + [rng.randint(-500, 500) for _ in range(80)] + [7, 7]
    rows = [(i, f"text {k}" if k % 9 else None) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    for n in (1, 4, 16):
        got = scaled_sketch.with_next(docs, n).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t or "") for i, t in rows)
        # Following next_text from the largest id goes through all rows once, by falling ids, null last.
        assert Counter(r["next_text"] for r in got) == Counter(t or "" for _, t in rows)
        place = lambda i: (i is None, -(i or 0))
        by_text = {r["text"]: r for r in got if r["text"]}
        top = min(place(i) for i in ids)
        for r in got:
            if r["text"] and r["next_text"]:
                after = by_text[r["next_text"]]["doc_id"]
                assert place(after) >= place(r["doc_id"]) or place(after) == top
                between = [i for i in ids if place(r["doc_id"]) < place(i) < place(after)]
                assert not between
    assert scaled_sketch.with_next(docs.where("doc_id is null")).count() == 40


def test_urls(spark):
    rng = random.Random(7)
    part = ["example", "www", "a", "org", "com", "net", "x"]
    urls = [None, "", "no scheme", "http://", "http:///de/", "http://org", "://org/es/"] + [f"{rng.choice(['http', 'HTTPS'])}://" + ".".join(rng.choices(part, k=rng.randint(1, 4))).upper() + rng.choice(["", "/", "/es/1", "/en/12", "/de/", "/fr/?q", "/de#f", "/e"]) for _ in range(400)]
    urls += [urls[20]] * 200
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "com", "/de/"), ("block", "", ""), ("block", "x.net", "/"), ("allow", "a.x.net", "")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, HOST string, rule string")

    def judge(u, rules):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
            path = rest[len(host) :]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
            host = host.lower()
        fits = [(len(h + p), a == "block", h + p, a) for a, h, p in rules if (host == h or h and host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    for some in (rules, rules[:5], []):
        got = url_rules.match_rules(pages, some).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(urls[r["page_id"]], some)
    assert url_rules.match_rules(pages.where("false"), rules).count() == 0


def test_mix_is_stable(spark):
    rng = random.Random(8)
    rows = [(i if i % 50 else None, "w " * rng.randint(0, 40), rng.choice(["a", "b", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    take = lambda d: sorted((r["doc_id"] or -1, r["size"], r["source"] or "", r["taken"]) for r in mixing.mix(d).collect())
    first = take(docs)
    assert first == take(docs.repartition(7)) and sum(x[3] for x in first) > 0
    # Complete epochs come first: where a source is taken more than once, every document is taken once at least.
    for r in mixing.mix(docs).collect():
        assert r["target"] < r["source_size"] or r["taken"] >= r["size"]


def test_rows_that_stay(spark):
    rng = random.Random(9)
    text = lambda: " ".join(rng.choices([f"v{k}" for k in range(900)], k=60))
    a, b = text(), text()
    rows = [(5, a), (5, b), (5, b), (9, a), (2, b), (7, text()), (None, a), (None, a), (8, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "k", "t") for i, t in rows], "doc_id long, text string, KEY string, th string")
    got = sorted(((r["doc_id"] or -1), (r["text"] or "")) for r in vp_simhash.keep_one(docs).collect())
    assert got == sorted([(-1, a), (-1, a), (5, a), (2, b), (7, rows[5][1]), (3, "")]) and vp_simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("n", [0, 1, 33])
def test_large_bucket_keeps_links(spark, n):
    """Chains within one large bucket: each text resembles its neighbours, the ends do not resemble each other."""
    from chronospan.llm import jaccard_dedup

    base = [f"w{k}" for k in range(200)]
    texts = [" ".join([f"x{j}" for j in range(3 * i)] + base[3 * i :]) for i in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in jaccard_dedup.keep_one(docs).collect()] == ([0] if n else [])


def test_toxicity_against_a_plain_version(spark):
    """The registered query's scores, and those of a loop over words with the same model; held-out rows of the given tables."""
    from chronospan.llm.queries import op3_zdict_toxicity

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in texts}
    sample = [[texts[i] for i in sorted(toxic) if toxic[i] == y and not out(i)] for y in (1, 0)]
    model = zdict_toxicity.fit(*sample, len(sample[0]) / (len(sample[0]) + len(sample[1])))
    windows, weight = zdict_toxicity.Windows(model.ordinary, model.toxic), model.weights

    def plain(text):
        words = [x for w in text.lower().encode().split() if (x := w.strip(zdict_toxicity.ENDS))]
        of = {w: weight[int(windows.classes([w])[0])] for w in set(words)}
        total, n = sum(of[w] for w in words), len(words)
        strong, kinds, stronger = sum(of[w] > 1 for w in words), sum(v > 1 for v in of.values()), sum(v > 2 for v in of.values())
        x = [1, total / math.sqrt(n + 25), strong / math.sqrt(n + 25), 10 * strong / (n + 25), math.log1p(strong), math.log1p(n) / 5, math.log1p(kinds), math.log1p(stronger)]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.logistic, strict=True))))

    got = {r["doc_id"]: r for r in op3_zdict_toxicity(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert math.isclose(got[i]["score"], plain(text), abs_tol=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7) and got[i]["held_out"] == out(i)
    held = [i for i in toxic if out(i) and toxic[i] is not None]
    hit = lambda y: [got[i]["predicted"] for i in held if toxic[i] == y]
    assert np.mean(hit(1)) >= 0.7 and np.mean(hit(0)) <= 0.02


def test_stems_of_inflected_words():
    """Words that all differ, told by their beginnings: a dictionary of whole words would not know those of other texts."""
    rng = random.Random(9)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "ri", "sa", "te", "vu", "zo", "pa"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 5)))
    text = lambda bad: " ".join(rng.choice(["grox", "plimf"]) + word() if rng.random() < bad else word() for _ in range(120))
    model = zdict_toxicity.fit([text(0.04) for _ in range(100)], [text(0) for _ in range(200)], 0.33)
    score = lambda bad: zdict_toxicity.probabilities(model, pa.array([text(bad) for _ in range(60)]))
    assert np.mean(score(0.04) >= 0.7) > 0.9 and np.mean(score(0) >= 0.7) < 0.05


def test_kneser_ney_stored_trigrams():
    """What a shard of pairs sends on for each trigram is small, words that recur are stored once, and all of it comes back."""
    rng = np.random.default_rng(8)
    n, shards = 60_000, 4
    vocab = rng.integers(10, 1 << 63, 3000, dtype=np.uint64)
    m, c, a = (vocab[np.minimum(rng.zipf(1.3, n) - 1, 2999)] for _ in range(3))
    of = kneser_ney.chain(m, c) % np.uint64(shards) == 1
    rows = np.unique(np.stack([m[of], c[of], a[of]], axis=1), axis=0)
    m, c, a = rows.T
    first = kneser_ney._firsts(kneser_ney.chain(m, c))
    size = np.diff(np.append(first, len(m))).astype(np.uint32)
    pack = kneser_ney._pack
    columns = [pack(m[first], True), pack(c[first]), pack(size), pack(size), pack(a), pack(np.ones(len(m), np.uint32))]
    pairs = pa.table([[1], *([x] for x in columns)], ["shard", "m", "c", "n2", "size", "a", "n"])
    words = np.unique(np.concatenate([m, c]))
    counts = np.full(len(words), 5)
    asked = pa.table([words.view(np.int64), *[counts] * 5], ["word", "n1", "t", "e1", "e2", "e3"])
    d = np.array([0.0, 0.5, 1.0, 1.5])
    found = kneser_ney._shares(shards, 1, d, d, 5.0 * len(words), 1e-6)(pairs, asked)
    sent = found.filter(pc.is_valid(found.column("context")))
    context, last = kneser_ney._column(sent, "context", np.uint64, True), kneser_ney._decoded(sent, "words", "last", np.uint64)
    want = zip(kneser_ney.chain(a, m).tolist(), (c & kneser_ney.NEXT).tolist(), strict=True)
    assert sorted(zip(context.tolist(), last.tolist(), strict=True)) == sorted(want)
    held = sum(len(pa.compress(x.as_py(), "zstd", asbytes=True)) for name in ("words", "last") for x in sent.column(name))
    assert held < 4 * len(m), held / len(m)  # 6 bytes each as bare hashes
