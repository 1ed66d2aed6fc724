"""Operator 12 against tries built turn by turn, with hashes and primes so small that groups collide."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from linkloom.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp string, part long"


def brute(rows, regraft=True):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if regraft else 0
        paths[c] = own.get(c - c % 5, [])[:h] + turns[h:] if regraft else turns
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, ms in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in ms if len(paths[c]) == len(node))
        out.append((ms[0], len(node), members[node[:-1]][0] if node else None, len(ms), sum(len(n) == len(node) + 1 for n in below),
                    sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below) for n in below),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(n=60, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        same = c % 3 == 0  # a third of all are copies of one conversation
        for t in range(12 if same else int(rng.integers(0, 12))):
            rows.append((c, t, "user" if t % 2 else None, "héllo" if same else ["a", "b", "", None, "long " * 5][int(rng.integers(5))], "x", "y", t))
    rows += [(90, None, "user", "first", "x", "y", 0), (90, 3, "user", "a", "x", "y", 0), (90, 3, "user", "a", "x", "y", 0), (91, 1, None, None, None, None, None), (None, 1, "user", "a", "x", "y", 0)]
    return rows


@pytest.mark.parametrize("bits, primes", [(64, T.PRIMES), (64, (11, 7)), (2, (11, 13))])
def test_nodes(spark, bits, primes):
    df = spark.createDataFrame(rows_of(), SCHEMA).repartition(5)
    turns = T.ordered_turns(df, bits)
    got = T.prefix_trie(*T.graft(turns), primes=primes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows_of())


def test_a_long_conversation_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 100)
    monkeypatch.setattr(T, "IDS", 3)
    rows = [(c, t, "u", f"t{t % 7}" if t < 900 else f"{c}", "", "", 0) for c in (1, 2, 7) for t in range(1000)] + [(c, 0, "u", "t0", "", "", 0) for c in range(20, 60)]
    got = T.prefix_trie(*T.as_given(T.ordered_turns(spark.createDataFrame(rows, SCHEMA)))).collect()
    nodes = {(r["depth"], r["conv_id"]): r for r in got}
    assert len(got) == 1 + 900 + 300 and nodes[1000, 7]["n_leaves"] == 1
    root, first, last = nodes[0, 1], nodes[1, 1], nodes[900, 1]
    assert (root["n_convs"], root["n_children"], root["n_leaves"]) == (43, 1, 3)
    assert (last["n_convs"], last["n_children"], last["n_leaves"], last["saved_tokens"]) == (3, 3, 3, 4)
    assert first["saved_tokens"] == 42 * 2 + 899 * 2 * 2
    assert first["ends_sha256"] == hashlib.sha256(",".join(map(str, range(20, 60))).encode()).hexdigest()
    assert nodes[901, 7]["parent_conv_id"] == 1


def test_without_conversations(spark):
    assert T.prefix_trie(*T.graft(T.ordered_turns(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_powers():
    for base, p in zip(T.BASES, T.PRIMES):
        at = np.array([0, 1, 2, 63, 10**6, 2**40 + 7])
        assert T.powers(base, at, p).tolist() == [pow(base, int(e), p) for e in at]
