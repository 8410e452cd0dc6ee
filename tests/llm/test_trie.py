"""Prefix trie against brute force, for all shapes of shards."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketreach.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c >= 0 else -1)
        built[c] = own.get(c - rest, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own_saved
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p, m))
        for p, m in members.items()
    ), key=str)


def _got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n long, key string")


ODD = [
    (0, 1, "user", "a b"), (0, 0, None, None), (0, None, "x", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "u", "lone"),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (23, 5, "user", "q"), (21, 0, "u", "only"), (24, 0, "u", "x"), (-5, 0, "u", "v w"),
    (-5, 1, "u", "v w"), (-5, 2, "u", "v w"), (None, 0, "u", "nobody"), (40, 0, "", ""), (41, 0, None, None), (7, 0, "u", "long " * 40_000),
    (8, 1, "ab", "c"), (9, 1, "a", "bc"),
]


@pytest.mark.parametrize("leaf", [1, 4096])
def test_defined_cases(spark, leaf):
    assert _got(trie.trie(_frame(spark, ODD), leaf)) == _brute(ODD)


def test_empty_table(spark):
    assert _got(trie.trie(_frame(spark, ODD).limit(0))) == []
    assert _got(trie.trie(_frame(spark, [(None, 0, "u", "x")]))) == []


@pytest.mark.parametrize("leaf,packed", [(1, 1), (2, 1 << 18), (30, 20)])
def test_shared_prefixes(spark, monkeypatch, leaf, packed):
    """Hot first turns, copies, and sequences that end inside others."""
    monkeypatch.setattr(trie, "PACKED", packed)
    rng = np.random.default_rng(leaf)
    rows = []
    for c in range(160):
        start = ["hot one"] * int(rng.integers(0, 6)) if c % 3 else ["hot one", "two", "three"]
        turns = start + [f"t{x} y" for x in rng.integers(0, 3, int(rng.integers(0, 4)))]
        rows += [(c, k, "user" if k % 2 else "bot", t) for k, t in enumerate(turns or ["t0"])]
    assert _got(trie.trie(_frame(spark, rows).repartition(3), leaf)) == _brute(rows)


def test_double_array_holds_exactly_its_sequences():
    rng = np.random.default_rng(1)
    made = sorted({tuple(rng.integers(0, 40, int(rng.integers(0, 6))).tolist()) for _ in range(800)}, key=len, reverse=True)
    sizes = np.array([len(s) for s in made])
    found = trie.DoubleArray(np.array([c for s in made for c in s]), np.cumsum(sizes) - sizes, sizes)
    prefixes = {s[:d] for s in made for d in range(len(s) + 1)}
    places = {}
    for p in sorted(prefixes, key=len):
        state = np.zeros(1, np.int64)
        for code in p:
            state = found.step(state, np.array([code]))
        assert state[0] >= 0
        places[p] = int(state[0])
    assert len(set(places.values())) == len(prefixes) == (found.check >= 0).sum()
    assert all(found.step(np.array([places[p]]), np.array([c]))[0] == places.get((*p, c), -1) for p in prefixes for c in range(41))
