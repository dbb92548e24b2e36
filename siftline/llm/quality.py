"""Quality scores from document statistics (operator 8).

Random Fourier features approximate a Gaussian kernel over statistics of a text; ridge weights come
from normal equations that are summed by partition; isotonic regression on rows that the weights
never saw turns their output into a probability.

Learning uses about ``sample`` labelled ids, at most 1.25 times as many (those whose hashes are below a
threshold; all, where there are no more), never ids whose crc32 mod 4 is 2, and nothing of a row but its text. An id
on several rows counts once, with the least statistics. Scoring is a narrow stage over every row and whole texts.

Defined cases: null and empty texts have statistics of zero and get a score like any other; rows
without id or label aren't learnt from; conflicting labels of one id count as their mean; repeated
rows are kept; without any label (or with one class alone) every score is the mean label, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import hash_sample, materialise, small_batches, span_hashes, spans_of, text_chunks

SAMPLE = 20_000
FEATURES = 384
RIDGE = 1e-2
THRESHOLD = 0.7
TRAIN_PARTITIONS = 12

_ascii = np.arange(256)
_CLASSES = {
    "upper": (_ascii >= 65) & (_ascii <= 90),
    "lower": (_ascii >= 97) & (_ascii <= 122),
    "digit": (_ascii >= 48) & (_ascii <= 57),
    "wide": _ascii >= 128,
    "space": np.isin(_ascii, [32, 9, 10, 11, 12, 13]),
    "newline": _ascii == 10,
    "stop": np.isin(_ascii, [33, 46, 63]),
    "exclaim": _ascii == 33,
    "comma": _ascii == 44,
    "markup": np.isin(_ascii, [ord(c) for c in "<>{}[]|\\/=_"]),
    "symbol": np.isin(_ascii, [ord(c) for c in "#$%&*@^~+"]),
}
_BLANK = _CLASSES["space"]
N_STATISTICS = 26


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)


def _distinct(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and how often its commonest key occurs."""
    if not len(rows):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
    most = np.zeros(n)
    np.maximum.at(most, r[first], np.diff(np.append(first, len(r))))
    return np.bincount(r[first], minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of N_STATISTICS numbers for each text."""
    out = np.zeros((len(column), N_STATISTICS))
    for i, j, buf, offsets in text_chunks(column):
        n = j - i
        size = np.diff(offsets).astype(float)
        per = {k: _row_sums(t[buf], offsets) for k, t in _CLASSES.items()}
        starts, ends, rows = spans_of(~_BLANK[buf], offsets)
        length = (ends - starts).astype(float)
        count = lambda mask=None, rows=rows, n=n: np.bincount(rows if mask is None else rows[mask], minlength=n).astype(float)
        words, total = count(), np.bincount(rows, length, n)
        kinds, common = _distinct(rows, span_hashes(buf, starts, ends), n)
        ups = np.concatenate([[0], np.cumsum(_CLASSES["upper"][buf])])
        lows = np.concatenate([[0], np.cumsum(_CLASSES["lower"][buf])])
        shout = count((ups[ends] - ups[starts] >= 2) & (lows[ends] == lows[starts]))
        last = buf[np.maximum(ends - 1, 0)]
        odd_end = count(_CLASSES["symbol"][last] | (last == 33))
        line_starts, line_ends, line_rows = spans_of(buf != 10, offsets)
        lines = np.bincount(line_rows, minlength=n).astype(float)
        line_kinds, line_common = _distinct(line_rows, span_hashes(buf, line_starts, line_ends), n)
        line_length = (line_ends - line_starts).astype(float)
        short = np.bincount(line_rows[line_length < 30], minlength=n)
        close = np.bincount(line_rows[_CLASSES["stop"][buf[np.maximum(line_ends - 1, 0)]]], minlength=n)
        per_byte, per_word, per_line = (np.maximum(x, 1) for x in (size, words, lines))
        mean = total / per_word
        out[i:j] = np.column_stack(
            [
                np.log1p(size),
                np.log1p(words),
                np.log1p(lines),
                mean,
                np.sqrt(np.maximum(np.bincount(rows, length**2, n) / per_word - mean**2, 0)),
                kinds / np.maximum(words, 1) ** 0.8,
                common / per_word,
                shout / per_word,
                odd_end / per_word,
                line_kinds / per_line,
                line_common / per_line,
                np.log1p(size / per_line),
                short / per_line,
                close / per_line,
                np.log1p(line_common),
                *(per[k] / per_byte for k in _CLASSES),
            ]
        )
    return out


class Model:
    """Everything needed to score statistics; a few hundred kilobytes at most."""

    def __init__(self, centre, scale, frequency, phase, weight, steps):
        self.centre, self.scale, self.frequency, self.phase, self.weight, self.steps = centre, scale, frequency, phase, weight, steps

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        at, level = self.steps
        parts = [np.interp(self.raw(x[i : i + 1000]), at, level) for i in range(0, len(x), 1000)]
        return np.clip(np.concatenate(parts), 0, 1) if parts else np.zeros(0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and level of each pool, for interpolation between pools.
    Equal x are pooled first; a pool of n labels is drawn towards 1/2 by half a label."""
    at, place = np.unique(x, return_inverse=True)
    count = np.bincount(place, minlength=len(at)).astype(float)
    pools: list[list[float]] = []
    for b, a, n in zip(np.bincount(place, y, len(at)), at * count, count, strict=True):
        pools.append([b, a, n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
    s, t, n = np.array(pools).T
    return t / n, (s + 0.25) / (n + 0.5)


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, fold, label and the statistics of a bounded number of texts, from the folds learnt from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(fold != 2)
    known = materialise(hash_sample(known.groupBy("doc_id").agg(F.avg("quality").alias("label")), sample, "doc_id"))
    # its size is bounded by ``sample``
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", fold.alias("fold"), "label", "text")

    def run(batches):
        for b in batches:
            x = pa.array(list(statistics(b.column(3))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), x], ["doc_id", "fold", "label", "x"])

    found = small_batches(rows).mapInArrow(run, "doc_id long, fold long, label double, x array<double>")
    return found.groupBy("doc_id", "fold", "label").agg(F.min("x").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    rows = labelled(docs, labels, sample).repartition(TRAIN_PARTITIONS, "doc_id").sortWithinPartitions("doc_id")
    data = materialise(rows.select("fold", "label", "x"))
    rng = np.random.Generator(np.random.PCG64(8))
    frequency = rng.standard_normal((N_STATISTICS, features)) / np.sqrt(N_STATISTICS) * 1.2
    phase = rng.uniform(0, 2 * np.pi, features)

    def moments(batches):
        n, s, q, y = 0, np.zeros(N_STATISTICS), np.zeros(N_STATISTICS), 0.0
        for b in batches:
            x = np.array(b.column(2).to_pylist()).reshape(-1, N_STATISTICS)
            n, s, q, y = n + len(x), s + x.sum(0), q + (x**2).sum(0), y + b.column(1).to_numpy().sum()
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n, y], s, q]).tobytes()])], ["part"])

    part = sum(np.frombuffer(r[0]) for r in data.mapInArrow(moments, "part binary").collect())
    n, mean_label = part[0], part[1] / part[0] if part[0] else 0.5
    d = N_STATISTICS
    centre = part[2 : 2 + d] / max(n, 1)
    scale = np.sqrt(np.maximum(part[2 + d :] / max(n, 1) - centre**2, 1e-6))
    constant = Model(centre, scale, frequency, phase, np.zeros(features + 1), (np.array([0.0]), np.array([mean_label])))
    if not n or mean_label in (0.0, 1.0):
        return constant

    def equations(batches):
        """The sums of one partition: features' products, features times labels."""
        a = np.zeros((features + 1, features + 2))
        for b in batches:
            learn = b.column(0).to_numpy() != 3
            x = np.array(b.column(2).to_pylist()).reshape(-1, N_STATISTICS)[learn]
            z = constant.features(x)
            a += z.T @ np.column_stack([z, b.column(1).to_numpy()[learn]])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()])], ["part"])

    # TRAIN_PARTITIONS partitions of a fixed size each reach the driver
    total = sum(np.frombuffer(r[0]).reshape(features + 1, -1) for r in data.mapInArrow(equations, "part binary").collect())
    ridge = RIDGE * np.eye(features + 1)
    ridge[-1, -1] = 0
    weight = np.linalg.lstsq(total[:, :-1] + ridge, total[:, -1], rcond=None)[0]
    held = data.where("fold = 3").select("label", "x").collect()
    model = Model(centre, scale, frequency, phase, weight, constant.steps)
    if held:
        model.steps = isotonic(model.raw(np.array([r[1] for r in held])), np.array([r[0] for r in held]))
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.score(statistics(b.column(1))) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) == 2).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the model accepts; texts stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            if len(b):
                yield b.filter(pa.array(shared.value.score(statistics(b.column(at))) >= threshold))

    return small_batches(docs).mapInArrow(run, docs.schema)
