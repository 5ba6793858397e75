"""The conversation trie against a nested-dict trie in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.llm import prefix_trie
from docloom.llm import queries as Q
from tests.compare import rows_equal

SCHEMA = "conv_id long, turn long, role string, text string"


def _want(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    nodes = defaultdict(list)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        # the remainder has the sign of c, as in SQL
        paths[c] = tuple(own.get(c - int(abs(c) % 5 * (1 if c > 0 else -1)), [])[:h] + turns[h:])
        for d in range(len(paths[c]) + 1):
            nodes[paths[c][:d]].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    out = []

    def below(p):
        kids = [below(k) for k in children[p]]
        leaves = sum(k[0] for k in kids) or 1
        saved = sum(k[1] for k in kids) + (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if paths[c] == p)))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        below(())
    return sorted(out, key=repr)


def _check(spark, rows, shards):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), shards).collect()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == _want(rows)


def _rows(seed, convs=120):
    """Conversations over few texts; a third are copies of one, and one is a start of it."""
    rng = random.Random(seed)
    out = []
    for c in range(-12, convs):
        if c % 3 == 0:
            turns = ["hello", "yes", "and then", "the end"][: 3 if c % 2 else 4]
        else:
            turns = [rng.choice("abcé") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 7))]
        out += [(c, t, "user" if t % 2 else "bot", x) for t, x in enumerate(turns)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_equals_nested_dicts(spark, shards):
    _check(spark, _rows(shards), shards)


def test_long_paths_and_cut_splitters(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", 3)
    monkeypatch.setattr(prefix_trie, "ENDS_BYTES", 30)
    rows = _rows(5) + [(c, t, None, f"t{t if t < 290 else (t, c)}") for c in (201, 202, 203, 206) for t in range(300)]
    _check(spark, rows, 9)


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", None), (1, 0, None, ""), (1, 0, None, ""), (7, 3, "bot", "x" * 200_000), (8, 1, "a:b", "c"), (9, 1, "a", "b:c"), (13, 0, "user", "one"), (13, 0, "user", "one"), (-6, 1, "q", "z")]
    _check(spark, rows, 3)
    turns = spark.createDataFrame(rows, SCHEMA)
    assert prefix_trie.trie(turns.limit(0)).count() == 0
    plain = sorted(map(repr, prefix_trie.trie(turns).collect()))
    extra = turns.withColumns({c: F.lit("x") for c in ("c", "r", "d", "b", "own", "base", "h", "path", "sizes", "shard", "skel", "kind", "depth", "s", "above")})
    assert sorted(map(repr, prefix_trie.trie(extra).collect())) == plain


def test_equals_sql(spark):
    rows_equal(Q.op11_prefix_trie(spark, "/root/testdata/sf0.01"), Q.ORACLES["op11_prefix_trie"], "/root/testdata/sf0.01")
