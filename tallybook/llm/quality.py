"""Quality classifier: histogram gradient-boosted trees over document statistics, applied with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import LOWER, NOT_SPACE, byte_class, chunks, join_texts, keyed, original_id, span_hashes, word_spans
from tallybook.session import stage

SAMPLE_ROWS = 20_000  # labelled rows to fit on at most, those with the smallest hashes of their ids
THRESHOLD = 0.7

_CLASSES = {
    "upper": byte_class(lambda b: 65 <= b <= 90),
    "lower": byte_class(lambda b: 97 <= b <= 122),
    "digit": byte_class(lambda b: 48 <= b <= 57),
    "space": ~NOT_SPACE,
    "line": byte_class(lambda b: b == 10),
    "stop": byte_class(lambda b: b == 46),
    "comma": byte_class(lambda b: b == 44),
    "exclaim": byte_class(lambda b: b in b"!?"),
    "bar": byte_class(lambda b: b in b"|<>[]{}/\\_=~^`"),
    "symbol": byte_class(lambda b: b in b"#$%&*+@"),
    "beyond": byte_class(lambda b: b >= 128),
}
FEATURES = [
    "log_bytes", "log_words", "bytes_per_word", "spread_of_word_length", *(f"share_{n}" for n in _CLASSES), "same_as_before",
    "distinct_words", "upper_words", "marked_words", "words_per_line", "repeated_lines",
]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(owner: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=texts)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of a chunk."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, owner = word_spans(data, offsets, NOT_SPACE)
    words = np.bincount(owner, minlength=texts)
    length = (ends - starts).astype(np.float64)
    per_word = lambda values: np.bincount(owner, values, texts) / np.maximum(words, 1)
    columns = [np.log1p(size), np.log1p(words), per_word(length)]
    columns.append(np.sqrt(np.maximum(per_word(length**2) - columns[2] ** 2, 0)))
    columns.extend(_per_text(table[data], offsets) / np.maximum(size, 1) for table in _CLASSES.values())
    hashes = span_hashes(LOWER[data], starts, ends)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    columns += [per_word(same), _distinct(owner, hashes, texts) / np.maximum(words, 1)]
    first, last = (data[starts], data[ends - 1]) if len(starts) else (np.empty(0, np.uint8),) * 2
    second = data[np.minimum(starts + 1, ends - 1)] if len(starts) else first
    columns.append(per_word(_CLASSES["upper"][first] & (_CLASSES["upper"][second] | (second >= 128)) & (ends - starts > 1)))
    columns.append(per_word((_CLASSES["symbol"] | _CLASSES["bar"] | _CLASSES["exclaim"])[last]))
    line_starts, line_ends, line_owner = word_spans(data, offsets, ~_CLASSES["line"])
    lines = np.bincount(line_owner, minlength=texts)
    columns.append(words / np.maximum(lines, 1))
    columns.append(1 - _distinct(line_owner, span_hashes(data, line_starts, line_ends), texts) / np.maximum(lines, 1))
    return np.column_stack(columns).astype(np.float32)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, features): one list of numbers per whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(c.data, c.offsets) for c in chunks(batch.column("text"))]
            values = np.concatenate(rows) if rows else np.empty((0, len(FEATURES)), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features array<float>")


class Forest(NamedTuple):
    """All trees in flat arrays; a leaf points to itself, so a fixed number of steps reaches it."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        index = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                node = np.where(rows[index, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(
    rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, smallest: int = 10, ridge: float = 1.0
) -> Forest:
    """Boosted trees for the logistic loss; splits are searched on histograms of ``bins`` quantile bins.

    Without rows, or with one label only, the forest is a constant.
    """
    n, width = rows.shape
    mean = (labels.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(rows[:, j], np.arange(1, bins) / bins)).astype(np.float32) if n else np.empty(0, np.float32) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, rows[:, j], "left") for j, c in enumerate(cuts)]) if n else np.empty((0, width), np.int64)
    offset = np.arange(width) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)
    for _ in range(trees if n and 0 < labels.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = labels - p, p * (1 - p)
        roots.append(len(feature))
        todo = [(np.arange(n), 0)]
        feature.append(0), threshold.append(0.0), left.append(roots[-1]), right.append(roots[-1]), value.append(0.0)
        nodes = [roots[-1]]
        while todo:
            members, level = todo.pop()
            node = nodes.pop()
            g, h = gradient[members], hessian[members]
            value[node] = rate * g.sum() / (h.sum() + ridge)
            best = None
            if level < depth and len(members) >= 2 * smallest:
                at = (binned[members] + offset).ravel()
                sums = [np.bincount(at, np.repeat(x, width), width * bins).reshape(width, bins).cumsum(1)[:, :-1] for x in (g, h, np.ones(len(members)))]
                gl, hl, cl = sums
                gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
                gain[(cl < smallest) | (len(members) - cl < smallest)] = 0
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                best = (j, b) if gain[j, b] > 1e-6 and b < len(cuts[j]) else None
            if best is None:
                margin[members] += value[node]
                continue
            goes = binned[members, best[0]] <= best[1]
            feature[node], threshold[node] = int(best[0]), float(cuts[best[0]][best[1]])
            for side, part in ((left, members[goes]), (right, members[~goes])):
                new = len(feature)
                side[node] = new
                feature.append(0), threshold.append(0.0), left.append(new), right.append(new), value.append(0.0)
                todo.append((part, level + 1))
                nodes.append(new)
    kinds = [(roots, np.int64), (feature, np.int64), (threshold, np.float32), (left, np.int64), (right, np.int64), (value, np.float64)]
    return Forest(base, depth, *(np.array(x, k) for x, k in kinds))


def held_out(column: str = "doc_id"):
    """Rows that no model is fitted on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def quality_scores(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, score, predicted.

    ``labels`` has doc_id and quality (1 good, 0 bad; rows with a null in either are ignored, of several rows of one
    document the smallest quality counts). The forest is fitted on at most ``sample_rows`` labelled rows that are not
    held out, chosen by the hash of their id. Only statistics of the whole text enter a score; a null text counts as
    empty, and empty texts get the score of their statistics like any other. Repeated rows get the same result; a
    null doc_id is never held out. Without labels every score is 0.5.
    """
    spark = documents.sparkSession
    found = stage(document_statistics(keyed(documents)), "statistics")
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = known.filter(~held_out()).join(found.dropDuplicates(["doc_id"]), "doc_id")
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("quality", "features").toArrow()
    rows = np.array(sample["features"].combine_chunks().values.to_numpy(zero_copy_only=False), np.float32).reshape(-1, len(FEATURES)) if len(sample) else np.empty((0, len(FEATURES)), np.float32)
    marks = (np.array(sample["quality"].to_pylist(), np.float64) > 0).astype(np.float64)
    forest = spark.sparkContext.broadcast(fit_forest(rows, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column("features").flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, len(FEATURES))
            score = forest.value.score(values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = found.mapInArrow(run, "doc_id long, score double").select(original_id(), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
