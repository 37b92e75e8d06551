"""The whole pipeline on a small folder: every stage's decision, and the run as the stages one after the other."""

import random

import numpy as np
import tiktoken

import corpus_pipeline
from chronospan.llm import bpe_prefix, mixing
from chronospan.llm.queries import tokenizer
from chronospan.llm.text import table
from tests.llm.test_brute_force import furniture_docs


def test_run(spark, tmp_path):
    rng = random.Random(11)
    rows = furniture_docs(rng, 150)
    docs = [(i, t + "\nAll in all it was a quiet day for everyone who came along to see it." * (1 + i % 2), "en", f"s{i % 3}", len(t), "extra") for i, t, _ in rows]
    docs += [(1000, None, "en", "s0", 0, "x"), (1001, "", None, None, 0, "x"), (None, docs[0][1], "en", "s1", 1, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, IDS string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, names = table(spark, str(tmp_path), "documents"), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_dedup", "source_mix", "bpe_encoding"]
    columns, results = kept.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        results[name] = kept.collect()
        kept = spark.createDataFrame(results[name], kept.schema)
        assert kept.columns[: len(columns)] == columns
    ids = {n: [r["doc_id"] for r in x] for n, x in results.items()}
    good = {i for i, _, q in rows if q}
    assert {i for i in ids["quality_classifier"] if i in good} >= {i for i in good if i % 10}  # clean documents stay
    assert not set(ids["quality_rules"]) & {i for i, _, q in rows if not q} and 1000 not in ids["quality_rules"]
    copies = range(150, 190)
    assert sum(i in copies for i in ids["near_dedup"]) == 1 and len(ids["near_dedup"]) == len(set(ids["near_dedup"]))
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(results["near_dedup"], table(spark, str(tmp_path), "documents").schema)).collect()}
    assert sum(wanted.values()) == len(ids["source_mix"]) and all(ids["source_mix"].count(i) == n for i, n in wanted.items())
    path, pattern = tokenizer()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_prefix.parse_ranks(open(path, "rb").read()), special_tokens={})
    for r in results["bpe_encoding"]:
        assert np.frombuffer(r["ids_"], "<u4").tolist() == encoding.encode_ordinary(r["text"] or "")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((i or -1) for i in ids["bpe_encoding"])
