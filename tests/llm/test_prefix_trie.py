"""The trie against one built by prefixes in a dictionary; parts of nodes over several blocks; edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from chronospan.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves, saved = below_of = [0, (len(nodes[p]) - 1) * len(p[-1][1].split()) if p else 0]
        for q in children[p]:
            leaves, saved = leaves + below[q][0], saved + below[q][1]
        below_of[:] = [leaves if children[p] else 1, saved]
        below[p] = below_of
    return {
        (len(p), min(m), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), below[p][0], below[p][1], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p)))).encode()).hexdigest())
        for p, m in nodes.items()
    }


def got(df):
    return [(r.depth, r.conv_id, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]


@pytest.fixture
def many_blocks(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,symbols", [(1, 2), (2, 1), (3, 4)])
def test_against_a_dictionary(spark, many_blocks, seed, symbols):
    """Few symbols make prefixes and whole conversations that many share, so that nodes span several blocks."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 150):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", None]), rng.choice([" ".join("w" * (k + 1)) for k in range(symbols)])))
    rng.shuffle(rows)
    df = prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))
    found = got(df)
    assert len(found) == len(set(found)) and set(found) == plain(rows)
    assert df.schema["depth"].dataType.simpleString() == "bigint"


def test_one_conversation_of_thousands(spark, many_blocks):
    """One conversation makes a third of all, another has thousands of turns."""
    rows = [(20 * i, t, "user", f"a {t}") for i in range(60) for t in range(4)]
    rows += [(20 * i, t, "user", f"b {i} {t}") for i in range(60, 180) for t in range(2)] + [(4000, t, "user", "again") for t in range(3000)]
    assert set(got(prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))) == plain(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "x"), (0, None, None, "first"), (0, 2, "user", None), (0, 1, "user", "b b"), (7, 0, "user", "c"), (47, 0, "user", "only"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = got(prefix_trie.trie(prefix_trie.rebuilt(df.selectExpr("*", "1 as depth", "2 as Block", "'z' as seq", "3 as parent_start"))))
    assert set(found) == plain(rows)  # 47 has no base and, by its h, no turn of its own left or one
    assert prefix_trie.trie(prefix_trie.rebuilt(df.where("false"))).count() == 0
    long = spark.createDataFrame([(0, 0, "user", "w " * 500_000), (20, 0, "user", "w " * 500_000)], SCHEMA)
    assert {(r.depth, r.saved_tokens) for r in prefix_trie.trie(prefix_trie.rebuilt(long)).collect()} == {(0, 500_000), (1, 500_000)}


def test_common_prefix():
    a, b = bytes(range(64)), bytes(range(40)) + b"x" * 24
    assert prefix_trie.common(a, b) == 2 and prefix_trie.common(a, a) == 4 and prefix_trie.common(a, b"") == 0 and prefix_trie.common(b"y" + a, a) == 0
