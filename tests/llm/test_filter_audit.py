"""The audit against every order applied to the documents in turn; edges."""

import itertools
import math
import re

import pytest

from chronospan.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    texts = [(d, t or "") for d, t, _ in rows]
    out = []
    for d, t in texts:
        w = WORD.findall(t)
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if d is not None and any(e is not None and e < d and u == t for e, u in texts) else set()
        out.append(f)
    return out


def plain(rows, labels):
    fails, out = failures(rows), set()
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for i, x in enumerate(order):
                gone, stay = [m for m in left if x in m[1]], [m for m in left if x not in m[1]]
                steps.append((order, i + 1, x, len(stay), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
                left = stay
        total = {x: sum(s[4] for s in steps if s[2] == x) for x in "ABCDE"}
        out |= {(part, o, i, *rest, total[x]) for o, i, x, *rest in steps}
    return out


def found(df):
    return [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()]


@pytest.fixture(scope="module")
def tables(spark):
    plainly, mixed = " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i} %" for i in range(250))
    texts = [plainly, plainly, mixed, "", None, "a b", "a b", "A|B", "w " * 300, "x\x85y\x0b\x1f" * 120, "é " * 201, "a b", "w " * 300_000]
    rows = [(i * 7 % 13, t, [None, "s", "s", "u"][i % 4]) for i, t in enumerate(texts)] + [(None, "a b", "s"), (99, plainly, None), (99, plainly, None), (99, plainly, "s")]
    labels = [(0, 1, 0), (7, 1, 1), (7, 0, 0), (1, None, 1), (2, 1, 1), (None, 1, 1), (99, 1, 0), (5, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n", "'z' as PART", "2 as digest", "true as A", "3 as good")
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_all_orders(tables):
    rows, labels, docs, marks = tables
    got = found(filter_audit.audit(docs, marks))
    assert len(got) == 600 * 3 and set(got) == plain(rows, labels)


def test_a_third_are_copies(spark, tables):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 70), "hot" if i % 2 else "cold") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = found(filter_audit.audit(docs, tables[3]))
    assert {(g[0], g[1], g[2], g[4]) for g in got if g[1] == "EABCD" and g[2] == 1} == {("hot", "EABCD", 1, sum("E" in f for f, r in zip(failures(rows), rows, strict=True) if r[2] == "hot")), ("cold", "EABCD", 1, sum("E" in f for f, r in zip(failures(rows), rows, strict=True) if r[2] == "cold"))}
    assert sum(g[9] for g in got if g[1] == "ABCDE") == math.factorial(5) * sum(bool(f) for f in failures(rows))


def test_no_documents(spark, tables):
    assert filter_audit.audit(tables[2].where("false"), tables[3]).count() == 0
    assert filter_audit.audit(tables[2], tables[3].where("false")).agg({"good_lost": "max"}).first()[0] == 0
