"""Operator 11: the fixed patterns against Python's own, the field against enumeration, and evasive forms held out."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from linkloom.llm import personal_data as P

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(re.sub("[^0-9]", "", x)) <= 19 and P.luhn(re.sub("[^0-9]", "", x))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(re.sub("[^0-9]", "", x)) <= 15)]


def plain(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m[0]))


@pytest.fixture(scope="module")
def field():
    return P.fit(P.labelled_rows())


def test_base_spans_are_the_patterns():
    rng = np.random.default_rng(3)
    signs = list("0123456789") * 2 + list("..@@ab-+ ()_%é") + ["255", "4111111111111111", "+1 (555) 123-4567", "a@b.co", "1.2.3.4"]
    for _ in range(4000):
        text = "".join(rng.choice(signs, int(rng.integers(0, 40))))
        assert P.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "1..1." * 50_000, "@" * 200_000, "+1" + "(" * 200_000, "a@b" * 60_000, "1 " * 100_000])
def test_base_spans_of_long_runs_take_linear_time(text):
    import time

    began = time.time()
    P.base_spans(text)
    assert time.time() - began < 5


def test_the_field_is_the_sum_and_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    model = P.Field(np.zeros((P.BUCKETS, P.STATES)), rng.normal(size=(P.STATES, P.STATES)), rng.normal(size=P.STATES))
    lengths = np.array([4, 1, 3])
    scores = rng.normal(size=(3, 4, P.STATES))
    probs, pairs, total = P.marginals(scores, lengths, model)
    got = P.viterbi(scores, lengths, model)
    step, first = model.step + P._STEPS, model.first + P._FIRST
    steps = np.zeros_like(pairs)
    for s, n in enumerate(lengths):
        paths = np.array(list(itertools.product(range(P.STATES), repeat=int(n))))
        weight = first[paths[:, 0]] + sum(scores[s, i, paths[:, i]] for i in range(n)) + sum(step[paths[:, i - 1], paths[:, i]] for i in range(1, n))
        assert (got[s, :n] == paths[weight.argmax()]).all()
        assert np.isclose(total[s], np.log(np.exp(weight).sum()))
        p = np.exp(weight - total[s])
        for i in range(n):
            assert np.allclose(probs[s, i], np.bincount(paths[:, i], p, P.STATES), atol=1e-9)
            if i:
                np.add.at(steps, (paths[:, i - 1], paths[:, i]), p)
    assert np.allclose(steps, pairs, atol=1e-9)


def test_held_out_rows(field):
    rows = P.labelled_rows(400, seed=77)
    got = P.added_spans([t for t, _ in rows], [[] for _ in rows], field)
    right = sum(len(set(g) & set(s)) for g, (_, s) in zip(got, rows))
    assert right / sum(map(len, got)) > 0.95
    assert right / sum(len(s) for _, s in rows) > 0.92


def test_evasive_forms_are_added_and_base_spans_stay(field):
    texts = ["write to ann.lee (at) mailbox (dot) org about it", "er schrieb ann at mailbox dot org gestern", "ring 555-867-5309 now", "call (212) 867-5309 ok", "card 4111.1111.1111.1111 was", "host 10[.]20[.]30[.]40 down",
             "ann@mailbox.org and bob [at] mailbox [dot] org"]
    kinds = [0, 0, 3, 3, 2, 1, 0]
    base = [P.base_spans(t) for t in texts]
    got = P.added_spans(texts, base, field)
    assert [[k for _, k, _ in g] for g in got] == [[k] for k in kinds]
    assert base[-1] == [(0, 0, 15)]
    clean = ["version 2.0 of the licence, section 4.1", "at 10:30 on 2024-05-06 we met", "id 12345678 costs $20.00", 'token = "76ce86d4952db1ee140095c8f6e334d186126d15"', "password=e3b3ed3cc8548923d6", "a dot on the map at noon. Then 3 more", ""]
    assert P.added_spans(clean, [[] for _ in clean], field) == [[] for _ in clean]


def test_all_places_of_a_text_are_decoded(field):
    """Spans without a digit, an @ or a word for a dot, and spans longer than any reach around those."""
    fill = "nothing to see in this long part of the page, and " * 20
    long = "-".join(["lorem"] * 30)
    texts = [f"{fill}write to ann (at) mailbox.org about it, {fill}", f"{fill}write to ann.lee [at] {long}.org about it, {fill}"]
    got = P.added_spans(texts, [[], []], field)
    assert [[(t[s:e], k) for s, k, e in g] for t, g in zip(texts, got)] == [[("ann (at) mailbox.org", 0)], [(f"ann.lee [at] {long}.org", 0)]]


def test_known_contexts_change_no_span(field):
    texts, known = [t for t, _ in P.labelled_rows(60, seed=8)], ({}, [])
    none = [[] for _ in texts]
    want = [P.added_spans([t], [[]], field)[0] for t in texts]
    assert P.added_spans(texts, none, field) == P.added_spans(texts, none, field, known) == P.added_spans(texts, none, field, known) == want


def test_find_on_odd_rows(spark, odd, none, field):
    got = P.find(odd, field).collect()
    assert len(got) == odd.count()
    texts = [r["text"] or "" for r in odd.select("text").collect()]
    want = sorted(hashlib.sha256(P.spans_text(P.base_spans(t)).encode()).hexdigest() for t in texts)
    assert sorted(r["base_sha256"] for r in got) == want
    assert P.find(none, field).count() == 0
    assert P.find(odd, P.fit([])).filter("n_added > 0").count() == 0
    docs = spark.createDataFrame([(1, "x 1.2.3.4 and a@b.co, +1 (555) 123-4567 or 4111 1111 1111 1111")], "doc_id long, text string")
    r = P.find(docs, field).first()
    assert [r[f"n_{k}"] for k in P.KINDS] == [1, 1, 1, 1] and r["spans"].startswith("ip:2:9,email:14:20,phone:22:39,card:43:62")
