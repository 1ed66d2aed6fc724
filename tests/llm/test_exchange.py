"""Packing of several groups against the bound of all pieces."""

import numpy as np
import pytest
from linkloom.llm import packing

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sequences(rows, size):
    """How many sequences there are, all without gaps."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in seqs.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= size
    return len(seqs)


@pytest.mark.parametrize("n, group, most, over", [(3000, 300, 25, 0), (1200, 80, 25, 1), (1000, 100, 60, 1)])
def test_groups_share_their_last_sequences(spark, n, group, most, over):
    lengths = np.random.default_rng(2).integers(1, most, n)
    rows = [(i, 0, 0, int(w), i) for i, w in enumerate(lengths)] + [(5000, 0, 0, 100, 7)]
    got = packing.pack(spark.createDataFrame(rows, PIECE), 100, group=group).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    bound = packing.bin_bound(np.array([r[3] for r in rows]), 100)
    assert sequences(got, 100) - bound <= over and {r["over_bound"] for r in got} == {sequences(got, 100) - bound}


def test_rows_without_an_id_or_of_one_id_are_dealt_like_others(spark):
    big = (1 << 62) + 1
    rows = [(None if i % 2 else big, 0, 0, 1 + i % 40, i) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, PIECE), 100, group=50).collect()
    assert sorted((r["doc_id"] or 0, r["length"], r["ids_crc32"]) for r in got) == sorted((r[0] or 0, r[3], r[4]) for r in rows)
    assert sequences(got, 100) <= packing.bin_bound(np.array([r[3] for r in rows]), 100) + 1
