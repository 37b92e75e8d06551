"""Every operator over null, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from chronospan.llm import attention_lm, bpe_prefix, jaccard_dedup, kneser_ney, license_scan, line_crf, mixing, scaled_sketch, vp_simhash, zdict_toxicity
from chronospan.llm.queries import tokenizer

LONG = "Some words of a very long text, line after line.\n" * 20_000
TEXTS = ["a plain text of some words", "a plain text of some words", "", None, LONG, "x", "\n \t", "Released under the MIT License."]
CLASHES = ["_limit", "_lang", "SCORE", "KEPT", "key", "t", "component", "th", "h", "range", "guest", "n_words", "Perplexity", "ids", "N_tokens", "_n", "_t", "fp", "copies_", "line_labels"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "en" if i % 2 else None, "s", i) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("z").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (6, 0, 1), (7, 0, 1), (4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def toxic(docs, labels):
    return zdict_toxicity.scored(docs, zdict_toxicity.train(docs, labels, F.lit(True)))


KEEP_ALL = {
    "classify": lambda d, l: kneser_ney.classify(d, l, name="kept"),
    "lines": lambda d, l: line_crf.label(d, line_crf.train(d, l)),
    "toxic": toxic,
    "mix": lambda d, l: mixing.mix(d.select("doc_id", "text", "source")),
    "lm": lambda d, l: attention_lm.score(d, F.col("doc_id") % 2 == 0, *tokenizer(), most=200, rounds=1),
    "simhash": lambda d, l: vp_simhash.near_duplicates(d),
    "edited": lambda d, l: scaled_sketch.compare_edited(scaled_sketch.with_next(d, 3)),
    "sketch": lambda d, l: scaled_sketch.fingerprint(d),
    "bpe": lambda d, l: bpe_prefix.decode_documents(bpe_prefix.encode_documents(d.select("doc_id", "text", "source"), *tokenizer()), tokenizer()[0]),
}
SAME_COLUMNS = {
    "keep_good": kneser_ney.keep_good,
    "keep_content": line_crf.keep_content,
    "keep_one": lambda d, l: vp_simhash.keep_one(d),
    "keep_similar": lambda d, l: jaccard_dedup.keep_one(d),
    "mixed": lambda d, l: mixing.mixed_rows(d),
}


@pytest.mark.parametrize("name", KEEP_ALL)
def test_one_row_each(docs, labels, name):
    got = KEEP_ALL[name](docs, labels)
    assert got.count() == len(TEXTS) and len({c.lower() for c in got.columns}) == len(got.columns)
    assert KEEP_ALL[name](docs.where("false"), labels).count() == 0
    if name in ("classify", "lines", "toxic"):  # nothing to learn from
        assert KEEP_ALL[name](docs.where("doc_id < 3"), labels.where("false")).count() == 3


@pytest.mark.parametrize("name", SAME_COLUMNS)
def test_same_columns(docs, labels, name):
    got = SAME_COLUMNS[name](docs, labels)
    assert got.columns == docs.columns and got.count() <= 2 * len(TEXTS)
    assert SAME_COLUMNS[name](docs.where("false"), labels).count() == 0


def test_defined_results(docs, labels):
    score = {r["doc_id"]: r["score"] for r in toxic(docs, labels).collect()}
    assert all(0 <= v <= 1 for v in score.values()) and score[2] == score[3] == score[6] and score[0] == score[1]
    kept = {r["doc_id"] for r in jaccard_dedup.keep_one(docs).collect()}
    assert kept == {0, 2, 4, None, 7}
    assert {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()} == {(7, "MIT")}
    assert license_scan.scan(docs.where("false")).count() == 0 and license_scan.scan(docs, {}).count() == 0
    lines = {r["doc_id"]: r for r in line_crf.label(docs, line_crf.train(docs, labels)).collect()}
    assert lines[2]["base_failed"] and len(lines[4]["line_labels"]) == 20_001 and lines[4]["n_dup_lines"] == 19_999
    assert not mixing.mixed_rows(docs.where("text is null or text = ''")).count()
