"""Workers hold one piece of a batch's texts, however many rows the batch has, and give the same mentions."""

from types import SimpleNamespace

import pyarrow as pa
import pytest
from linkloom.operators import gazetteer as G
from linkloom.operators import mentions as M
from linkloom.operators import tagger as T
from linkloom.session import BATCH_ROWS, TEXT_BYTES, pieces

TEXTS = [f"Nobody {i} saw Kober near Lodan, nor Kober's boat. " * (1 + 400 * (i % 7 == 0)) for i in range(400)] + [None, "", "é" * TEXT_BYTES, "Kober"]


class Given:
    """A frame that gives the function of its mapInArrow."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["text_idx", "text"])


def test_pieces_are_bounded_and_lose_no_row():
    got = list(pieces([batch(TEXTS), batch([]), batch([None])]))
    assert [t for b in got for t in b.column(1).to_pylist()] == [*TEXTS, None]
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= TEXT_BYTES for b in got)


@pytest.mark.parametrize("way", ["automaton", "pattern", "model", "tagger", "tokens"])
def test_a_batch_of_many_texts_is_worked_in_pieces(spark, way):
    names = SimpleNamespace(toArrow=lambda: pa.table({"key": ["kober", "lodan", "kober's boat"]}))
    tagger = T.Tagger.new(["name"])
    tagger.emit[0, 1] = 1.0  # every token begins a name
    run = {"automaton": lambda: G._by_automaton(Given(), names, 5, 5), "pattern": lambda: M.pattern_mentions(Given()), "model": lambda: M.extract(Given(), lambda t: ((i, i + 5, "k") for i in range(0, len(t) - 5, 50))),
           "tagger": lambda: T.tag(Given(), tagger), "tokens": lambda: M.tokens(Given())}[way]()
    got = list(run([batch(TEXTS)]))
    # A token and a pattern's mention take a character of a piece at least; the others go by rows.
    assert max(b.num_rows for b in got) <= (TEXT_BYTES if way in ("tokens", "pattern") else BATCH_ROWS)
    single = [r for i, t in enumerate(TEXTS) for b in run([batch(TEXTS).slice(i, 1)]) for r in b.to_pylist()]
    assert [r for b in got for r in b.to_pylist()] == single and len(got) > 1
