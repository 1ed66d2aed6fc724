"""Operator 11 over many texts at once: the same contexts as token by token, and the best path of every whole text."""

import numpy as np
import pytest
from linkloom.llm import personal_data as P

ODD = ["", " ", "a", "KKarte İ ǅx ²a ½ Ⅷ ٣٤ 12٣", "Write TO ann (at) Mail dot org. Or a@b.c, x.\ud800y", "+1 (555) 867-5309, [10] . 20 dot 30 / 40 ( 50 ) - 6", "1" * 30 + ".2.3.4 5", "card\n4111.1111-1111 1111", "PUNKT punto Σας ΣΑΣ 中文 mail:3"]


def odd_texts(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["at", "DOT", "dot", "punto", ".", "@", "(", ")", "[", "1", "25", "4111", "1234567", "mail", "Host", "fax", "word", "Und", "X", "é", "ß", "ª", "²", "Ⅷ", "٣", "中", "Karte", "+", "-", "_", "\x00", "\ud800", "😀", "#"]
    return ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n", " "]) for _ in range(int(rng.integers(0, 60)))) for _ in range(n)]


def test_packed_contexts_are_the_contexts_of_each_text():
    texts = ODD + odd_texts(300, 1) + [t for t, _ in P.labelled_rows(100, seed=3)]
    row, s, e, key, chains = P.packed_contexts(texts)
    got = [[] for _ in texts]
    for i, t in enumerate(row.tolist()):
        got[t].append(((int(s[i]), int(e[i])), P.unpacked(int(key[i]), chains.get(i, "-"))))
    for t, x in zip(texts, got):
        spans = P.tokens(t, 0, len(t))
        assert [y for y, _ in x] == spans, t
        assert [y for _, y in x] == P.contexts(t, spans), t
    assert (key >= 0).all() and len(P._COARSE) <= 64 and len(P._CUES) <= 32


@pytest.mark.parametrize("seed", range(12))
def test_best_path_of_texts_is_that_of_all_their_tokens(seed):
    """Random models and scores, from ones that stay outside to ones that seldom do."""
    rng = np.random.default_rng(seed)
    model = P.Field(np.zeros((1, P.STATES)), rng.normal(size=(P.STATES, P.STATES)) * 2, rng.normal(size=P.STATES) * 2)
    scores = rng.normal(size=(50, P.STATES)) * 3
    scores[:, 0] += rng.choice([0, 2, 6, 10])
    lengths = np.sort(rng.integers(1, 80, 60))[::-1]
    of, text = rng.integers(0, 50, lengths.sum()), np.repeat(np.arange(60), lengths)
    assert (P.best_path(scores, of, text, model) == P.best_states(scores[of], lengths, model)).all()


def test_plain_stretches_take_no_steps(monkeypatch):
    """Of a long text only few tokens are decoded step by step, and the spans are those of all of them."""
    field = P.fit(P.labelled_rows())
    texts = [" ".join(t for t, _ in P.labelled_rows(20, seed=9)) + " and then nothing but words, as most pages have them" * 3000, "so it is. " * 500 + "write to ann (at) mailbox.org", ""]
    seen, steps = [], P.best_states
    monkeypatch.setattr(P, "best_states", lambda scores, lengths, model: (seen.append(len(scores)), steps(scores, lengths, model))[1])
    got = P.added_spans(texts, [[] for _ in texts], field)
    toks = [P.tokens(t, 0, len(t)) for t in texts]
    assert sum(seen) < 0.05 * sum(map(len, toks))
    for t, x, spans in zip(texts, toks, got):
        want = []
        if x:
            states = steps(field.emit[P.features(t, x)].sum(axis=1), np.array([len(x)]), field)
            for b in np.flatnonzero(states % 2 == 1).tolist():
                e = b + 1
                while e < len(x) and states[e] == states[b] + 1:
                    e += 1
                want.append((x[b][0], int(states[b] - 1) // 2, x[e - 1][1]))
        assert spans == [w for w in want if P._sound(w[1], t[w[0]: w[2]])]
    assert len(got[0]) > 10 and len(got[1]) == 1
