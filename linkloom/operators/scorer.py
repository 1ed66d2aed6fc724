"""A scorer of mentions against labels by context: which of several entities of one name does the text mean?

A pair's features are hashed: how alike the names are, how many words the mention's surroundings share with the
entity's description, and every pair of a word around and a word of the description. A logistic model over them is
trained in Spark: each round every task sums its rows' gradients into one vector of a fixed length, and the sums are
added by feature. Scores come in Arrow batches; words are hashed once for each mention and label, not for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import _finish

BUCKETS = 1 << 16
#: The first features are the bias, the same name, a shared word, and shares of words in tenths.
BIAS, SAME, SHARED, TENTHS, OWN = 0, 1, 2, 3, 16


def word_hashes(text: Column) -> Column:
    """The crc32 of each distinct lower-cased word, ascending; null texts have none."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    return F.array_sort(F.transform(words, lambda w: F.crc32(w.cast("binary"))))


def context_pairs(mentions: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Mentions with each label of their text: the words around, the words of the description, and whether the name is
    the label or an alias."""
    around = word_hashes(F.concat_ws(" ", "left_context", "right_context"))
    m = mentions.select("text_idx", "text", "start", "end", F.lower("text").alias("_q"), around.alias("around"))
    rows = label_rows.select("text_idx", "label_text", "label_ord", "entity_id", word_hashes(F.col("description")).alias("about"),
                             F.transform(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x)).alias("_names"))
    return m.join(rows, "text_idx").withColumn("same", F.array_contains("_names", F.col("_q"))).drop("_q", "_names")


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists, and each row's number of them."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)


def feature_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and end row of a run of rows, its features, and each feature's row within the run: a bounded number of
    features at once, whatever the lengths of contexts and descriptions."""
    same = batch.column("same").to_numpy(zero_copy_only=False)
    x, nx = _lists(batch.column("around"))
    y, ny = _lists(batch.column("about"))
    ox, oy = np.concatenate([[0], np.cumsum(nx)]), np.concatenate([[0], np.cumsum(ny)])
    upto = np.concatenate([[0], np.cumsum(nx * ny)])
    i = 0
    while i < len(nx):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + (1 << 20), "right")) - 1)
        row = np.repeat(np.arange(i, j), (nx * ny)[i:j])
        k = np.arange(len(row)) - (upto[row] - upto[i])
        a, b = x[ox[row] + k // ny[row]], y[oy[row] + k % ny[row]]
        both = np.bincount(row - i, a == b, j - i).astype(np.int64)
        cross = OWN + (a * 31 + b * 17) % (BUCKETS - OWN)
        tenth = TENTHS + np.where(ny[i:j] > 0, 10 * both // np.maximum(ny[i:j], 1), 0)
        rows = np.arange(j - i)
        features = [np.full(j - i, BIAS), np.full(int(same[i:j].sum()), SAME), np.full(int((both > 0).sum()), SHARED), tenth, cross]
        of = [rows, rows[same[i:j]], rows[both > 0], rows, row - i]
        yield i, j, np.concatenate(features), np.concatenate(of)
        i = j


def _sums(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each run its rows' scores before the logistic, with features and rows. Cross features count by the root of
    their number, so long descriptions don't drown the others."""
    for i, j, f, of in feature_rows(batch):
        n = np.bincount(of, f >= OWN, j - i)
        scale = np.where(f >= OWN, 1 / np.sqrt(np.maximum(n, 1))[of], 1.0)
        yield i, j, f, of, np.bincount(of, weights[f] * scale, j - i)


def train(pairs: DataFrame, rounds: int = 12, rate: float = 2.0) -> np.ndarray:
    """Weights of BUCKETS features from pairs (context_pairs) with a boolean column `right`. Each round is one pass: what
    comes to the driver is one row a feature. Both answers weigh the same in all; without rows all weights are 0."""
    weights, step = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n = pairs.agg(F.count("*").alias("n"), F.count_if("right").alias("k")).first()
    if not n["k"] or n["k"] == n["n"]:
        return weights
    weight = {True: 0.5 / n["k"], False: 0.5 / (n["n"] - n["k"])}

    for _ in range(rounds):
        def gradient(batches, weights=weights):
            total = np.zeros(BUCKETS)
            for b in batches:
                right = b.column("right").to_numpy(zero_copy_only=False)
                for i, j, f, of, z in _sums(b, weights):
                    r = right[i:j]
                    error = np.where(r, weight[True], weight[False]) * (r - 1 / (1 + np.exp(-z)))
                    m = np.bincount(of, f >= OWN, j - i)
                    total += np.bincount(f, error[of] * np.where(f >= OWN, 1 / np.sqrt(np.maximum(m, 1))[of], 1.0), BUCKETS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["f", "g"])

        got = pairs.select("around", "about", "same", "right").mapInArrow(gradient, "f long, g double").groupBy("f").agg(F.sum("g").alias("g"), F.count("*").alias("k")).toArrow()
        g = np.zeros(BUCKETS)
        g[got["f"].to_numpy()] = got["g"].to_numpy()
        step += g * g
        weights = weights + rate * g / (np.sqrt(step) + 1e-8)  # steps by what each feature has moved so far
    return weights


def scored(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Pairs with `score`: the logistic of `z`, the sum of their features' weights."""
    shipped = pairs.sparkSession.sparkContext.broadcast(weights)
    names = ["text_idx", "text", "start", "end", "label_text", "label_ord", "entity_id"]

    def run(batches):
        for b in batches:
            z = np.concatenate([s for *_, s in _sums(b, shipped.value)]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(z), pa.array(1 / (1 + np.exp(-z)))], names=[*names, "z", "score"])

    fields = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.select(*names, "around", "about", "same").mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in names) + ", z double, score double")


def context_links(mentions: DataFrame, label_rows: DataFrame, weights: np.ndarray, threshold: float = 0.5, multi_label: bool = False, flat: bool = True, max_labels: int | None = None) -> DataFrame:
    """Links by context: the best label of each span, with every label's score in class_probs. With max_labels each
    chunk of so many labels is by itself."""
    chunk = F.floor((F.col("label_ord") - 1) / max_labels) if max_labels else F.lit(0)
    return _finish(scored(context_pairs(mentions, label_rows), weights).withColumn("chunk", chunk.cast("long")), threshold, multi_label, flat)
