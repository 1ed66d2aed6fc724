"""Personal data: emails, addresses of machines, card and phone numbers, by fixed patterns and by a sequence model.

The patterns give the base spans, in linear time whatever the text: they never run from every place of a long run. The
model is a linear-chain conditional random field over the shapes of words and numbers, for the forms that the patterns
don't know ("ann (at) mail (dot) org", numbers without a plus, broken up addresses). It is trained on the driver from
a small labelled table, a rule's rows by default, and its best path (Viterbi) is found over all tokens of every text. What
a token's features are made of is like that of many others, so its scores are worked out once in a worker for all of
them. Where the scores of a token and the next one show that a path through any other state gets better by being
outside there, the best path is outside; the stretches between such tokens are decoded with what joins them, which
gives the best path of the whole text. Spans that the model adds never touch base spans."""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, state_key, worker_state

KINDS = ("email", "ip", "card", "phone")
#: O, then a beginning and an inside of each kind.
STATES = 1 + 2 * len(KINDS)
BUCKETS = 1 << 14
REACH = 64  # characters of a labelled row that the model learns from before and after a mark
AT_ONCE = 1 << 19  # characters of texts that are decoded together
CONTEXTS = 1 << 17  # contexts whose scores a worker knows
#: Words that stand for signs in written-out addresses.
AT_WORDS = {"at", "arroba", "arobase"}
DOT_WORDS = {"dot", "punkt", "point", "punto"}
CUES = {"email", "mail", "contact", "write", "correo", "courriel", "tel", "phone", "call", "fax", "mobile", "telefon", "anrufen", "ip", "host", "server", "address", "card", "visa", "karte", "carte", "tarjeta"}


# --- base spans -------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_DOTTED = re.compile(r"[0-9.]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL_BACK.match(text[last:at][::-1]).end()
        domain = _DOMAIN.match(text, at + 1) if local else None
        last = domain.end() if domain else at + 1
        if domain:
            yield at - local, domain.end()
        at = text.find("@", last)


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        fields = run[0].split(".")
        if len(fields) < 4:
            continue
        at, i = run.start(), 0
        while i + 4 <= len(fields):
            four = fields[i: i + 4]
            if all(four):
                end = at + sum(map(len, four)) + 3
                if all(len(f.lstrip("0")) <= 3 and int(f) <= 255 for f in four):
                    yield at, end
                at, i = end + 1, i + 4
            else:
                at, i = at + len(fields[i]) + 1, i + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, ascending: leftmost matches of each kind without overlaps among them;
    matches that fail their kind's test (parts, digits, Luhn) go and aren't tried again."""
    out = [(s, 0, e) for s, e in _emails(text)] + [(s, 1, e) for s, e in _ips(text)]
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- tokens and features ----------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_DIGITS = re.compile(r"[0-9]+")
_DOT_WORD = re.compile(r"(?i)(?<![^\W_])(?:%s)(?![^\W_])" % "|".join(sorted(DOT_WORDS)))


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of a labelled row around digits, @ and words for a dot; those that touch are one. The model learns from
    these; texts are decoded whole."""
    marks = [(m.start(), m.end()) for m in _DIGITS.finditer(text)]
    marks += [(m.start(), m.end()) for m in re.finditer("@", text)] if "@" in text else []
    low = text.lower() if len(text) < 1 << 20 or text.isascii() else text
    if any(w in low for w in DOT_WORDS):
        marks += [(m.start(), m.end()) for m in _DOT_WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(marks):
        s, e = max(0, s - REACH), min(len(text), e + REACH)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def tokens(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, begin, end)]


def _coarse(word: str, glued_after: bool) -> str:
    low = word.lower()
    if low in AT_WORDS or word == "@":
        return "AT"
    if low in DOT_WORDS:
        return "DOT"
    if word == ".":
        return "p" if glued_after else "E"
    if word[0].isdigit() and word.isascii():
        return f"d{min(len(word), 6)}"
    if word[0].isalpha():
        return "w" if word.islower() else "W" if word.isupper() else "Ww"
    return word if word in "()[]{}<>+-/:=\"',;_%#&" else "o"


_BREAKS = re.compile(r"[-. ()\[\]+/]|(?i:dot|punkt|punto|point)")


def _chains(text: str, spans: list[tuple[int, int]], coarse: list[str]) -> list[str]:
    """For each token the signature of the chain of numbers it is in: lengths of the numbers and the signs between
    them. A chain goes over at most three signs without a letter, or a word for a dot."""
    out = ["-"] * len(spans)
    i = 0
    while i < len(spans):
        if coarse[i][0] != "d":
            i += 1
            continue
        members, j = [i], i + 1
        while j < len(spans):
            k = j
            while k < len(spans) and k - j < 3 and (coarse[k] in ("-", ".", "p", "E", "(", ")", "[", "]", "/", "DOT")):
                k += 1
            if k < len(spans) and coarse[k][0] == "d" and spans[k][0] - spans[members[-1]][1] <= 9:
                members.append(k)
                j = k + 1
            else:
                break
        numbers = [text[slice(*spans[m])] for m in members]
        digits = "".join(numbers)
        first = members[0]
        lead = "".join(coarse[x] for x in range(max(0, first - 2), first) if coarse[x] in ("+", "(", "[") and text[spans[x][1]: spans[first][0]].strip("([+ ") == "")
        signs = "|".join(re.sub(r"\s+", "_", text[spans[a][1]: spans[b][0]].lower()) for a, b in zip(members, members[1:]))
        groups = "".join(str(min(len(n), 9)) for n in numbers[:8])
        octets = len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
        total = len(digits)
        size = "s" if total < 7 else "m" if total < 10 else "l" if total < 13 else "c" if total <= 19 else "x"
        ok = "y" if 13 <= total <= 19 and luhn(digits) else "n"
        name = f"{lead} {groups} {signs[:24]}\x00{lead} {groups}\x00{size}{min(len(numbers), 9)}{int(octets)}{ok}{lead}\x00{size}{ok}"
        for m in range(max(0, first - len(lead)), members[-1] + 1):
            out[m] = name
        i = members[-1] + 1
    return out


#: What _coarse says of words (of a dot: that nothing is glued to it), for a bounded number of short ones.
_seen: dict[str, str] = {}


def _look(word: str) -> str:
    got = _coarse(word, False)
    if len(word) <= 32:
        _seen[word] = got
    return got


def _near(n: int, places: list[int], before: bool, reach: int = 7) -> list[str]:
    """Of each of n tokens: how far the next (or the last one before it) of some places is, if it is within reach."""
    out = ["-"] * n
    for p in places if before else reversed(places):
        for k in range(1, reach) if before else range(reach):
            if 0 <= (i := p + k if before else p - k) < n:
                out[i] = str(k)
    return out


def contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, ...]]:
    """What the features of each token are made of. Most tokens of a text share theirs with many others."""
    n = len(spans)
    words = [text[s:e] for s, e in spans]
    glued = [a[1] == b[0] for a, b in zip(spans, spans[1:])] + [False] * (n > 0)
    if len(_seen) > 1 << 16:
        _seen.clear()
    coarse = [_seen.get(w) or _look(w) for w in words]
    if "E" in coarse:
        coarse = ["p" if c == "E" and g else c for c, g in zip(coarse, glued)]
    chain = _chains(text, spans, coarse)
    pad = ["^"] * 3 + coarse + ["$"] * 3
    right = ["g" if g else "s" for g in glued]
    at = [i for i, c in enumerate(coarse) if c == "AT"]
    dot = [i for i, c in enumerate(coarse) if c in ("DOT", "p")]
    cue = ["-"] * n
    for i, low in enumerate(map(str.lower, words)):
        if low in CUES:
            cue[i: i + 5] = [low] * min(5, n - i)
    inside = ["i" if a == b != "-" else "b" for a, b in zip(["-", *chain], chain)]
    return list(zip(*(pad[k: k + n] for k in range(7)), ["s", *right], right, _near(n, at, False), _near(n, at, True), _near(n, dot, False), _near(n, dot, True), cue, chain, inside))


def _numbers(context: tuple[str, ...]) -> list[int]:
    """The feature numbers of a context."""
    *c, left, right, a1, a0, d1, d0, cue, chain, inside = context
    parts = chain.split("\x00")
    names = ["0", f"c{c[3]}", f"l{c[2]}", f"r{c[4]}", f"ll{c[1]}", f"rr{c[5]}", f"lc{c[2]}{c[3]}{left}", f"cr{c[3]}{c[4]}{right}", f"lcr{c[2]}{c[3]}{c[4]}{left}{right}", f"5{c[1]}{c[2]}{c[3]}{c[4]}{c[5]}", f"7{''.join(c)}",
             f"a{a1}{a0}", f"d{d1}{d0}", f"ad{a1}{a0}{d1}{d0}", f"adc{a1}{a0}{d1}{d0}{c[3]}{left}{right}", f"k{cue}{c[3]}", f"kc{cue}{parts[-1]}"]
    names += [f"ch{j}{inside}{p}" for j, p in enumerate(parts)] + ["ch-"] * (4 - len(parts))
    return [crc32(x.encode()) % BUCKETS for x in names]


#: What _coarse says, by number.
_COARSE = ["^", "$", "AT", "DOT", "p", "E", "d1", "d2", "d3", "d4", "d5", "d6", "w", "W", "Ww", "o", *"()[]{}<>+-/:=\"',;_%#&"]
_CUES = ["-", *sorted(CUES)]
_char_tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _pack(word: str) -> int:
    return sum((ord(c) - 96) << (5 * i) for i, c in enumerate(word))


#: Words that mean something, of at most eight letters: as numbers of five bits a letter, ascending, and the words.
_WORDS = sorted((_pack(w), w) for w in AT_WORDS | DOT_WORDS | CUES)
_PACKED = np.array([n for n, _ in _WORDS])
_WORD_COARSE = np.array([_COARSE.index(_coarse(w, False)) for _, w in _WORDS])
_WORD_CUE = np.array([_CUES.index(w) if w in CUES else 0 for _, w in _WORDS])
_SIGN = np.array([_COARSE.index(_coarse(chr(i), False)) for i in range(128)])


def _chars() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: which tokens it makes (0 none, 1 numbers, 2 words, 3 one by itself); of those in words, bits for
    lower, upper and title case and for being a letter, and the number of its lower-case form from a to z (31: none)."""
    if not _char_tables:
        every = "".join(map(chr, range(0x110000)))
        kind, case, letter = np.full(0x110000, 3, np.int8), np.zeros(0x110000, np.int8), np.full(0x110000, 31, np.int8)
        for k, pattern in ((0, r"\s+"), (1, "[0-9]+"), (2, r"[^\W\d_]+")):
            for m in re.finditer(pattern, every):
                kind[m.start(): m.end()] = k
        for i in np.flatnonzero(kind == 2).tolist():
            c = every[i]
            case[i] = c.islower() + 2 * c.isupper() + 4 * (c.istitle() and not c.isupper()) + 8 * c.isalpha()
            if "a" <= (low := c.lower()) <= "z" and len(low) == 1:
                letter[i] = ord(low) - 96
        _char_tables.append((kind, case, letter))
    return _char_tables[0]


def _near_numbers(places: np.ndarray, row: np.ndarray, before: bool, reach: int = 7) -> np.ndarray:
    """What _near says of all tokens, as numbers: 0 for none, else the distance (after: and one)."""
    out = np.zeros(len(row), np.int64)
    for k in range(reach - 1, 0 if before else -1, -1):
        at = places + k if before else places - k
        in_ = (at >= 0) & (at < len(row))
        at, of = at[in_], places[in_]
        out[at[row[at] == row[of]]] = k if before else k + 1
    return out


def packed_contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
    """All tokens of texts: each one's text, its beginning and end there, what `contexts` says of it but for its chain as
    one number, and the chains of the tokens that have one. No token is touched one by one but those near digits."""
    kinds, cases, letters = _chars()
    joined = "".join(texts)
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return (np.zeros(0, np.int64),) * 4 + ({},)
    kind = kinds[points]
    cut = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 3)])
    cut[(ends - size)[size > 0]] = True
    at = np.flatnonzero(cut)
    is_token = kind[at] > 0
    case = np.bitwise_or.reduceat(cases[points], at)[is_token] & 7
    s, e = at[is_token], np.append(at[1:], len(points))[is_token]
    n, k, head, row = len(s), kind[s], points[s], np.searchsorted(ends, s, "right")

    code = np.full(n, _COARSE.index("o"))
    sign = np.flatnonzero((k == 3) & (head < 128))
    code[sign] = _SIGN[head[sign]]
    number, word = np.flatnonzero(k == 1), np.flatnonzero(k == 2)
    code[number] = _COARSE.index("d1") - 1 + np.minimum(e - s, 6)[number]
    looks = np.full(8, _COARSE.index("Ww"))
    looks[[1, 2]] = _COARSE.index("w"), _COARSE.index("W")
    code[word] = np.where(cases[head[word]] & 8, looks[case[word]], _COARSE.index("o"))
    cue = np.zeros(n, np.int64)
    short = word[(e - s)[word] <= 8]
    length, low = (e - s)[short], np.concatenate([letters[points], np.zeros(8, np.int8)])
    packed = np.zeros(len(short), np.int64)
    for j in range(8):
        packed |= np.where(j < length, low[s[short] + j], 0).astype(np.int64) << (5 * j)
    hit = np.minimum(np.searchsorted(_PACKED, packed), len(_PACKED) - 1)
    known = _PACKED[hit] == packed
    short, hit = short[known], hit[known]
    # A word for a sign is one however it is written; a cue is a word like others.
    of_sign = _WORD_COARSE[hit] <= _COARSE.index("DOT")
    code[short[of_sign]] = _WORD_COARSE[hit[of_sign]]
    cues, of = short[_WORD_CUE[hit] > 0], _WORD_CUE[hit[_WORD_CUE[hit] > 0]]
    for j in range(4, -1, -1):
        in_ = cues + j < n
        to = cues[in_] + j
        same = row[to] == row[cues[in_]]
        cue[to[same]] = of[in_][same]
    glued = np.append((e[:-1] == s[1:]) & (row[:-1] == row[1:]), False)
    code[(code == _COARSE.index("E")) & glued] = _COARSE.index("p")

    new = np.append(True, row[1:] != row[:-1]) if n else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, n))
    place = np.arange(n) - np.repeat(begin, count)
    left = np.repeat(count, count) - 1 - place
    key = np.zeros(n, np.int64)
    for off in range(-3, 4):
        moved = np.roll(code, -off)
        key = key << 6 | (np.where(place >= -off, moved, 0) if off < 0 else np.where(left >= off, moved, 1))
    dot = np.flatnonzero((code == _COARSE.index("DOT")) | (code == _COARSE.index("p")))
    key = (key << 1 | np.append(False, glued[:-1])[:n]) << 1 | glued
    for places in (np.flatnonzero(code == _COARSE.index("AT")), dot):
        key = (key << 3 | _near_numbers(places, row, False)) << 3 | _near_numbers(places, row, True)
    key = key << 5 | cue

    # Chains go over at most three other tokens, so those of numbers further apart are found apart from each other.
    chains: dict[int, str] = {}
    if len(number):
        apart = np.flatnonzero((np.diff(number) > 4) | (np.diff(row[number]) > 0)) + 1
        first, last = number[np.append(0, apart)], number[np.append(apart, len(number)) - 1]
        for a, b in zip(np.maximum(first - 2, np.maximum.accumulate(np.where(new, np.arange(n), 0))[first]).tolist(), (last + 1).tolist()):
            got = _chains(joined, list(zip(s[a:b].tolist(), e[a:b].tolist())), [_COARSE[c] for c in code[a:b].tolist()])
            chains.update((a + i, x) for i, x in enumerate(got) if x != "-")
    key <<= 1
    inside = [i for i, x in chains.items() if not new[i] and chains.get(i - 1) == x]
    key[inside] |= 1
    shift = (ends - size)[row]
    return row, s - shift, e - shift, key, chains


def unpacked(key: int, chain: str = "-") -> tuple[str, ...]:
    """The context of a number that packed_contexts gives, and a chain."""
    take = lambda bits, by: key >> by & (1 << bits) - 1
    after, before = [str(k - 1) if k else "-" for k in (take(3, 15), take(3, 9))], [str(k) if k else "-" for k in (take(3, 12), take(3, 6))]
    return (*(_COARSE[take(6, 20 + 6 * k)] for k in range(6, -1, -1)), "sg"[take(1, 19)], "sg"[take(1, 18)], after[0], before[0], after[1], before[1], _CUES[take(5, 1)], chain, "bi"[take(1, 0)])


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Feature numbers of each token: a row of a fixed length each."""
    return np.array([_numbers(c) for c in contexts(text, spans)], np.int32).reshape(len(spans), -1)


# --- the model --------------------------------------------------------------------------------

@dataclass
class Field:
    """Weights of features by state, of steps between states, and of first states."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray


def _allowed() -> np.ndarray:
    """An inside follows a beginning or an inside of its kind only."""
    ok = np.zeros((STATES, STATES))
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = -1e4
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return ok


_STEPS = _allowed()
_FIRST = np.array([0.0] + [0.0, -1e4] * len(KINDS))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, lengths: np.ndarray, model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sequences padded to one length, by forward and backward recursions in logarithms: each state's probability
    at each place, expected counts of steps, and the logarithm of each sequence's sum over all paths."""
    n, t, _ = scores.shape
    step = model.step + _STEPS
    fore = np.zeros_like(scores)
    fore[:, 0] = scores[:, 0] + model.first + _FIRST
    for i in range(1, t):
        fore[:, i] = scores[:, i] + _log_sum(fore[:, i - 1, :, None] + step, 1)
    total = _log_sum(fore[np.arange(n), lengths - 1], 1)
    back = np.zeros_like(scores)
    pairs = np.zeros((STATES, STATES))
    for i in range(t - 2, -1, -1):
        on = (lengths > i + 1)[:, None]
        onward = scores[:, i + 1] + back[:, i + 1]
        back[:, i] = np.where(on, _log_sum(step + onward[:, None, :], 2), 0.0)
        pairs += np.exp(np.where(on[:, :, None], fore[:, i, :, None] + step + onward[:, None, :] - total[:, None, None], -1e9)).sum(axis=0)
    probs = np.exp(fore + back - total[:, None, None]) * (np.arange(t) < lengths[:, None])[:, :, None]
    return probs, pairs, total


def best_states(scores: np.ndarray, lengths: np.ndarray, model: Field) -> np.ndarray:
    """The best states of sequences that stand one after the other, none longer than the one before it: each step goes
    over those that are not at their end, so nothing is padded."""
    place = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(place, kind="stable")
    counts = np.bincount(place)
    at = np.concatenate([[0], np.cumsum(counts)])
    scores, step = scores[order], np.ascontiguousarray((model.step + _STEPS).T)
    came, final = np.zeros((len(scores), STATES), np.int8), np.zeros(len(lengths), np.int8)
    best = scores[: at[1]] + model.first + _FIRST
    for i in range(1, len(counts)):
        n = counts[i]
        final[n: len(best)] = best[n:].argmax(axis=1)
        x = best[:n, None, :] + step
        came[at[i]: at[i + 1]] = x.argmax(axis=2)
        best = x.max(axis=2) + scores[at[i]: at[i + 1]]
    final[: len(best)] = best.argmax(axis=1)
    states = np.zeros(len(scores), np.int8)
    now = final[: counts[-1]]
    for i in range(len(counts) - 1, -1, -1):
        states[at[i]: at[i + 1]] = now
        if i:
            before = final[: counts[i - 1]].copy()
            before[: counts[i]] = came[np.arange(at[i], at[i + 1]), now]
            now = before
    out = np.empty_like(states)
    out[order] = states
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, model: Field) -> np.ndarray:
    """The best states of sequences padded to one length; 0 after their ends."""
    order = np.argsort(-lengths, kind="stable")
    taken = np.arange(scores.shape[1]) < lengths[order][:, None]
    states = np.zeros(taken.shape, np.int8)
    states[taken] = best_states(scores[order][taken], lengths[order], model)
    out = np.zeros_like(states)
    out[order] = states
    return out


def fit(rows: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 40, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """A field from labelled rows (text, spans as (start, kind, end)), by gradient steps (Adam) on their likelihood.
    The table is small: its features are in the driver's memory at once. Without rows all tokens are outside."""
    ids, states, lengths = [], [], []
    for text, spans in rows:
        for begin, end in windows(text):
            toks = tokens(text, begin, end)
            if not toks:
                continue
            got = np.zeros(len(toks), np.int8)
            for s, k, e in spans:
                inside = [i for i, (a, b) in enumerate(toks) if a >= s and b <= e]
                got[inside] = 2 + 2 * k
                got[inside[:1]] = 1 + 2 * k
            ids.append(features(text, toks))
            states.append(got)
            lengths.append(len(toks))
    model = Field(np.zeros((BUCKETS, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES))
    if not ids:
        model.emit[crc32(b"0") % BUCKETS, 0] = 1.0
        return model
    order = np.argsort(lengths, kind="stable")
    parts = [order[i: i + 128] for i in range(0, len(order), 128)]
    sums = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.emit, model.step, model.first)]
    turn = 0
    for _ in range(rounds):
        for part in parts:
            turn += 1
            n = np.array([lengths[i] for i in part])
            flat = np.concatenate([ids[i] for i in part])
            gold = np.concatenate([states[i] for i in part]).astype(np.int64)
            at = np.arange(n.max()) < n[:, None]
            scores = np.zeros((*at.shape, STATES))
            scores[at] = model.emit[flat].sum(axis=1)
            probs, pairs, _ = marginals(scores, n, model)
            wrong = probs[at]
            wrong[np.arange(len(gold)), gold] -= 1
            emit = np.stack([np.bincount(flat.ravel(), np.repeat(wrong[:, k], flat.shape[1]), BUCKETS) for k in range(STATES)], axis=1)
            inner = np.ones(len(gold), bool)
            begins = np.cumsum(n) - n
            inner[begins] = False
            late = np.flatnonzero(inner)
            np.add.at(pairs, (gold[late - 1], gold[late]), -1.0)
            first = probs[:, 0].sum(axis=0) - np.bincount(gold[begins], minlength=STATES)
            for x, g, (m, v) in zip((model.emit, model.step, model.first), (emit, pairs, first), sums):
                g = g / len(part) + decay * x
                m += 0.1 * (g - m)
                v += 0.02 * (g * g - v)
                x -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.98 ** turn)) + 1e-6)
    return model


# --- the labelled table -----------------------------------------------------------------------

#: Words between which a rule puts labelled spans.
_FILL = "the and of to in for with is this from at on by we you have not see page item room about der die und das ist von mit nicht le la et les des est pour el los de que con para una".split()
_SYLLABLES = "ba ko ri ten ma su lo ver ing er na pe ti da ost qu el an mi on".split()


def labelled_rows(n: int = 1200, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The labelled table: n rows made by a rule. Words that carry nothing, with emails, addresses, card and phone numbers
    in plain and in evasive forms, and with numbers that are none of these."""
    rng = np.random.default_rng(seed)

    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    def digits(k):
        return "".join(str(int(x)) for x in rng.integers(0, 10, k))

    def word():
        return pick(_FILL) if rng.random() < 0.4 else "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))

    def fill(k):
        out = [word() for _ in range(k)]
        for i in range(k):
            if rng.random() < 0.12:
                out[i] += pick([".", ",", ";", ":", ".\n"])
        return " ".join(w.capitalize() if rng.random() < 0.1 else w for w in out)

    def email():
        name = pick([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}"])
        host = pick([[word()], ["mail", word()], [f"mail{digits(1)}", word()], [f"{word()}-{word()}"]]) + [pick(["com", "org", "net", "de", "fr", "es", "example", "info"])]
        at, dot = pick([("@", ".")] * 3 + [(" at ", " dot "), (" AT ", " DOT "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("[at]", "."), ("(at)", "."), (" @ ", " . "), (" (at) ", "."), (" at ", " punkt "),
                        (" arroba ", " punto "), (" arobase ", " point "), (" {at} ", " {dot} "), (" [at] ", ".")])
        if dot.strip(" ") != "." and rng.random() < 0.5:
            name = name.replace(".", dot).replace("_", "")
        return name + at + dot.join(host)

    def ip():
        xs = [str(int(x)) for x in rng.integers(0, 256, 4)]
        return pick([".", ".", ".", "[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", " [.] "]).join(xs)

    def card():
        d = [int(x) for x in pick("3456")] + [int(x) for x in rng.integers(0, 10, pick([13, 14, 14, 14, 14]))]
        s = sum(d[-1::-2][k] * 2 - 9 * (d[-1::-2][k] > 4) for k in range(len(d[-1::-2]))) + sum(d[-2::-2])
        x = "".join(map(str, d)) + str(-s % 10)
        sep = pick(["", " ", "-", ".", "/", "  ", "_"])
        return sep.join(x[i: i + 4] for i in range(0, len(x), 4)) if sep else x

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"+49 {digits(3)} {digits(7)}", f"0049 {digits(3)} {digits(7)}", f"0{digits(3)}/{digits(7)}",
                     f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{a} {b} {c}", f"+{digits(2)}-{a}-{b}-{c}", f"+ 1 {a} {b} {c}", f"+1/{a}/{b}-{c}", f"1 ({a}) {b}-{c}"])

    def other():
        hexed = "".join(pick("0123456789abcdef") for _ in range(pick([16, 18, 32, 40])))
        return pick([f"{digits(1)}.{digits(1)}", f"version {digits(1)}.{digits(1)}.", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"1{digits(1)}/0{digits(1)}/19{digits(2)}", f"1{digits(1)}.0{digits(1)}.20{digits(2)}",
                     f"1{digits(1)}:{digits(2)}", f"1{digits(1)}:{digits(2)}:{digits(2)}", f"${digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(3)}", f"{digits(4)}", f"{digits(5)}", f"{digits(6)}", f"{digits(2)}%", f"token = \"{hexed}\"", f"password={hexed[:18]}",
                     "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"1{digits(3)}-1{digits(3)}", f"#{digits(6)}", f"{digits(1)}.", f"CC BY-NC {digits(1)}.0.", f"id {digits(8)}", f"{digits(24)}", f"{digits(2)} {digits(2)}", f"{digits(3)} at {digits(2)}",
                     f"@{word()}", f"{word()} @ {digits(2)}", "the dot", f"a dot {word()}", f"at this point {word()}", f"point {digits(1)} of {digits(2)}", f"{digits(1)} + {digits(2)}", f"({digits(4)})", f"[{digits(2)}]", f"{digits(1)} dot {digits(1)}", f"no. {digits(3)}, p. {digits(2)}-{digits(3)}", f"at 1{digits(1)}.{digits(2)}",
                     f"{digits(2)}, {digits(2)}, {digits(2)}, {digits(2)}", f"{digits(1)} {digits(1)} {digits(1)} {digits(1)} {digits(1)}", f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}"])

    makers = (email, ip, card, phone)
    out = []
    for _ in range(n):
        text, spans = fill(int(rng.integers(0, 9))), []
        for _ in range(pick([1, 1, 1, 2, 2, 3])):
            if text:
                text += pick([" ", " ", " ", " ", ": ", " (", "\n"])
            k = int(rng.integers(0, 8))
            if k < 4:
                cue = pick([pick(sorted(CUES)) + pick([": ", " ", ":\n"]), "", "", "", ""])
                text += cue
                x = makers[k]()
                spans.append((len(text), k, len(text) + len(x)))
                text += x
            else:
                text += other()
            text += pick([" ", " ", ", ", ". ", "!! ", "### ", ") ", "\n"]) + fill(int(rng.integers(0, 8)))
            text = text.rstrip(" ")
        out.append((text, spans))
    return out


# --- spans of texts ---------------------------------------------------------------------------

def _sound(kind: int, x: str) -> bool:
    """Can this text be of the kind at all?"""
    numbers = _DIGITS.findall(x)
    total = sum(map(len, numbers))
    if kind == 0:
        words = {w.lower() for w in re.findall(r"[^\W\d_]+|[@.]", x)}
        return bool(words & (AT_WORDS | {"@"})) and bool(words & (DOT_WORDS | {"."})) and len(x) >= 6
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 13 <= total <= 19 and luhn("".join(numbers))
    return 9 <= total <= 15


def may_leave(scores: np.ndarray, of: np.ndarray, starts: np.ndarray, model: Field, least: float = 1e-3) -> np.ndarray:
    """At which tokens the best path may be in another state than outside. scores: a row of each context; of: each
    token's row; starts: where texts begin. Where a path leaves outside for a stretch of tokens, staying there costs at
    most the stretch's sum of what each token can bring, in any state and by any step to it, and what the step back can
    bring. So a token can't lie in such a stretch if the sum of every stretch with it is less than that: the highest
    sum up to a later place and the lowest one up to an earlier place say so of all of them. `least` only has to be
    above the errors of sums."""
    step, first = model.step + _STEPS, model.first + _FIRST
    more = scores[:, 1:] - scores[:, :1]
    brings = (more + (step[:, 1:].max(axis=0) - step[0, 0])).max(axis=1)[of]
    brings[starts] = (more + (first[1:] - first[0])).max(axis=1)[of[starts]]
    back = max(0.0, (step[1:, 0] - step[0, 0]).max())
    upto = np.concatenate([[0.0], np.cumsum(brings)])
    return np.maximum.accumulate(upto[::-1])[::-1][1:] - np.minimum.accumulate(upto)[:-1] + back > -least


def best_path(scores: np.ndarray, of: np.ndarray, text: np.ndarray, model: Field) -> np.ndarray:
    """The best states of all tokens of texts that stand one after the other: text has each token's text. Between two
    tokens that can only be outside the best stretch is the best one from outside to outside."""
    states = np.zeros(len(of), np.int8)
    ends = np.append(text[1:] != text[:-1], True)[: len(of)]
    starts = np.append(True, ends[:-1])[: len(of)]
    open_ = np.flatnonzero(may_leave(scores, of, starts, model))
    if not len(open_):
        return states
    got = scores[of[open_]].astype(np.float64)
    # A stretch follows a token outside unless its text begins there, and so at its end.
    begin = np.append(True, np.diff(open_) > 1) | starts[open_]
    end = np.append(begin[1:], True)
    got[begin & ~starts[open_]] += model.step[0] - model.first
    got[end & ~ends[open_]] += model.step[:, 0]
    at = np.flatnonzero(begin)
    lengths = np.diff(np.append(at, len(open_)))
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    take = np.repeat(at[order], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    states[open_[take]] = best_states(got[take], n, model)
    return states


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], model: Field, known: tuple[dict, list] | None = None) -> list[list[tuple[int, int, int]]]:
    """The spans that the model finds in each text besides the base spans: the best path over all tokens, those of many
    texts together. known: the contexts whose scores are known and those scores, for calls with the same model."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places, rows = known or ({}, [])  # of contexts the row of their scores, and the scores

    def place(key: int, chain: str = "-") -> int:
        at = places.get((key, chain))
        if at is None:
            at = places[key, chain] = len(rows)
            rows.append(model.emit[_numbers(unpacked(key, chain))].sum(axis=0))
        return at

    def decode(begin: int, end: int) -> None:
        row, s, e, key, chains = packed_contexts(texts[begin:end])
        if not len(row):
            return
        plain = np.ones(len(row), bool)
        plain[list(chains)] = False
        codes, new = pd.factorize(key[plain])
        of = np.empty(len(row), np.int64)
        of[plain] = np.array([place(k) for k in new.tolist()], np.int64)[codes]
        for i, x in chains.items():
            of[i] = place(int(key[i]), x)
        states = best_path(np.array(rows), of, row, model)
        for b in np.flatnonzero(states % 2 == 1).tolist():
            kind, last, t = (states[b] - 1) // 2, b + 1, begin + int(row[b])
            while last < len(row) and states[last] == states[b] + 1 and row[last] == row[b]:
                last += 1
            x, y = int(s[b]), int(e[last - 1])
            if _sound(kind, texts[t][x:y]) and all(y <= p or x >= q for p, _, q in base[t]):
                found[t].append((x, int(kind), y))
        if len(rows) > CONTEXTS:
            places.clear()
            rows.clear()

    begin, held = 0, 0
    for t, text in enumerate(texts):
        if held and held + len(text) > AT_ONCE:
            decode(begin, t)
            begin, held = t, 0
        held += len(text)
    decode(begin, len(texts))
    return [sorted(x) for x in found]


def find(docs: DataFrame, model: Field, keep: list[str] | None = None) -> DataFrame:
    """Per document, its `keep` columns (doc_id) with n_email, n_ip, n_card and n_phone (of the base spans),
    base_sha256, spans (base and added) and n_added. A null text is empty; an empty or clean one has no spans, and
    the empty text's hash. Rows that repeat an id are answered each; an empty table gives no rows."""
    keep = keep or ["doc_id"]
    small_batches(docs.sparkSession, 500)
    key = state_key("personal data")
    shipped = docs.sparkSession.sparkContext.broadcast(Field(model.emit.astype(np.float32), model.step, model.first))

    def run(batches):
        field, known = worker_state(key, lambda: (shipped.value, ({}, [])))
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, field, known)
            counts = [pa.array([sum(k == kind for _, k, _ in x) for x in base], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *counts, pa.array([sha256(spans_text(x).encode()).hexdigest() for x in base], pa.string()), pa.array([spans_text(sorted(x + y)) for x, y in zip(base, added)], pa.string()),
                                              pa.array([len(y) for y in added], pa.int64())], names=[*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    given = docs.select(*keep, F.col("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"n_{k} long" for k in KINDS] + ["base_sha256 string", "spans string", "n_added long"])
    return given.mapInArrow(run, schema)
