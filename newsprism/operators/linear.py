"""L2 logistic regressions fitted by truncated Newton steps, one model or many over the same rows.

A pass over the rows is one Spark job: it takes the coefficients of all models that are
still being fitted and returns, summed over the rows, what each asked for: loss, gradient
and curvature diagonal, or the product of the Hessian with a direction. The driver runs
Newton's method with preconditioned conjugate gradients on vectors of the size of the
vocabulary; rows never leave the executors. The objective of each model is

    sum over its rows of log loss + (|w|^2) / 2,

that is C = 1, with a free intercept; it is strictly convex, so a small gradient
certifies the fit (``certificate``).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.session import cut_lineage, drop_cut, reach_workers

#: Rows of a partition, at most so many partitions per core, and tasks that add up partial sums.
ROWS_PER_PARTITION, PARTITIONS_PER_CORE, PARTIALS = 2_000, 4, 16
#: Bytes of partial sums that the driver adds up itself, and numbers of a slice of sums that a task adds up.
DIRECT, SLICE = 1 << 24, 1 << 15
#: Entries of a stretch of rows that is kept as one row of arrays.
STRETCH = 1 << 18
#: Numbers that a task holds in one intermediate table.
CELLS = 1 << 22
GRADIENT, HESSIAN = "gradient", "hessian"
#: Directions that ``newton`` can keep for its preconditioner: 2 * KEPT vectors of a model's terms on the driver.
KEPT = 24
#: Bytes of coefficients up to which they travel with the task instead of as a broadcast.
WITH_THE_TASK = 1 << 19


@dataclass
class Carried:
    """Stands for a broadcast of something small."""
    value: tuple


@dataclass
class Rows:
    """A stretch of rows as arrays: labels, sparse entries in row order, one norm and one membership per model."""
    label: np.ndarray
    starts: np.ndarray
    index: np.ndarray
    value: np.ndarray
    norm: np.ndarray
    member: np.ndarray

    def __len__(self) -> int:
        return len(self.label)

    def pieces(self, width: int) -> Iterator[Rows]:
        """Stretches of which no table of entries x ``width`` exceeds CELLS, but for a single row."""
        at, ends = 0, np.append(self.starts[1:], len(self.index))
        while at < len(self):
            stop = max(at + 1, int(np.searchsorted(ends, self.starts[at] + CELLS // width, side="right")))
            entries = slice(self.starts[at], ends[stop - 1])
            yield Rows(self.label[at:stop], self.starts[at:stop] - self.starts[at], self.index[entries],
                       self.value[entries], self.norm[at:stop], self.member[at:stop])
            at = stop

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """rows x models: each row's entries times the models' weights, over the row's norm."""
        out = np.zeros((len(self), weights.shape[1]))
        filled = np.flatnonzero(np.diff(np.append(self.starts, len(self.index))))
        if len(filled):
            out[filled] = np.add.reduceat(weights[self.index] * self.value[:, None], self.starts[filled], axis=0)
        return out / self.norm


def of_vectors(batch: pa.RecordBatch) -> Rows:
    """Rows (label, features as an ML vector) for a single model."""
    features = batch.column("features").flatten()
    kinds, indices, values = (features[i] for i in (0, 2, 3))
    sizes = np.diff(values.offsets.to_numpy())
    value = values.flatten().to_numpy(zero_copy_only=False)
    dense = kinds.to_numpy(zero_copy_only=False) == 1
    if dense.any():
        lists = [np.arange(n) if d else np.asarray(i) for n, d, i in zip(sizes, dense, indices.to_pylist())]
        index = np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)
    else:
        index = indices.flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    return Rows(batch.column("label").to_numpy(zero_copy_only=False).astype(float), np.cumsum(sizes) - sizes,
                index.astype(np.int64), value, np.ones((n, 1)), np.ones((n, 1), dtype=bool))


def vectors(batch: pa.RecordBatch) -> Iterator[Rows]:
    yield of_vectors(batch)


def in_stretches(rows: DataFrame) -> DataFrame:
    """Rows (label, features) as stretches of rows in one row each, packed: passes then read arrays, not rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in of_vectors(batch).pieces(max(1, CELLS // STRETCH)):
                sizes = np.diff(np.append(part.starts, len(part.index)))
                data = [part.label.astype("<f8"), sizes.astype("<i4"), part.index.astype("<i4"), part.value.astype("<f8")]
                yield pa.RecordBatch.from_arrays([pa.array([d.tobytes()], pa.binary()) for d in data], names)

    names = ["label", "sizes", "index", "value"]
    reach_workers(rows.sparkSession)
    return rows.mapInArrow(pack, ", ".join(f"{n} binary" for n in names))


def of_stretches(batch: pa.RecordBatch) -> Iterator[Rows]:
    """The stretches of ``in_stretches``, for a single model."""
    for i in range(batch.num_rows):
        label, sizes, index, value = (np.frombuffer(batch.column(name)[i].as_buffer(), dtype=kind)
                                      for name, kind in (("label", "<f8"), ("sizes", "<i4"), ("index", "<i4"), ("value", "<f8")))
        n, ends = len(label), np.cumsum(sizes, dtype=np.int64)
        yield Rows(label, ends - sizes, index.astype(np.int64), value, np.ones((n, 1)), np.ones((n, 1), dtype=bool))


def _sums(rows: Rows, models: np.ndarray, gradient: np.ndarray, weights: np.ndarray, bias: np.ndarray,
          direction: np.ndarray, tilt: np.ndarray) -> tuple[np.ndarray, ...]:
    """(terms met, their sums, their curvatures, sums of the intercepts, their curvatures, losses) of a stretch."""
    sizes = np.diff(np.append(rows.starts, len(rows.index)))
    term = np.flatnonzero(np.bincount(rows.index))
    sums, curves = np.zeros((2, len(term), len(models)))
    tops, top_curves, loss = np.zeros((3, len(models)))
    for i, c in enumerate(models.tolist()):  # one at a time: a model needs its own rows only, and its vectors stay in the cache
        own = np.flatnonzero(rows.member[:, c])
        if not len(own):
            continue
        index, value, size = rows.index, rows.value, sizes
        if len(own) < len(rows):
            kept = np.repeat(rows.member[:, c], sizes)
            index, value, size = index[kept], value[kept], sizes[own]
        filled, norm, y = np.flatnonzero(size), rows.norm[own, c], rows.label[own]
        starts = (np.cumsum(size) - size)[filled]

        def dot(w: np.ndarray) -> np.ndarray:
            out = np.zeros(len(own))
            if len(filled):
                out[filled] = np.add.reduceat(w[index] * value, starts)
            return out / norm

        z = dot(weights[:, i]) + bias[i]
        p = 0.5 * (1.0 + np.tanh(0.5 * z))
        spread = p * (1.0 - p)
        pull = p - y if gradient[i] else spread * (dot(direction[:, i]) + tilt[i])
        tops[i], top_curves[i] = pull.sum(), spread.sum()
        if gradient[i]:
            loss[i] = (np.logaddexp(0.0, z) - y * z).sum()
        if len(term):
            sums[:, i] = np.bincount(index, np.repeat(pull / norm, size) * value, term[-1] + 1)[term]
            if gradient[i]:
                curves[:, i] = np.bincount(index, np.repeat(spread / norm ** 2, size) * value ** 2, term[-1] + 1)[term]
    return term, sums, curves, tops, top_curves, loss


class Fitter:
    """Rows of M models, read from ``frame`` by ``read``, and the passes over them."""

    def __init__(self, frame: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Rows]], scale: np.ndarray, parts: int | None = None,
                 single: bool = False):
        """``scale`` (terms x models) multiplies each model's entries; 0 keeps a term out of a model.
        ``parts`` is the number of partitions, where known. ``single`` sends the Hessian's products and the
        curvatures, which only choose the steps, in single precision; losses and gradients stay double."""
        reach_workers(frame.sparkSession)
        self.frame, self.read, self.scale, self.parts = frame, read, scale, parts
        self.kind = "<f4" if single else "<f8"
        self.terms = [np.flatnonzero(scale[:, c]) for c in range(scale.shape[1])]

    def run(self, asked: dict[int, tuple]) -> dict[int, tuple]:
        """One pass. asked: model -> (GRADIENT, x) or (HESSIAN, x, v); x and v hold the model's terms, then the intercept.

        Answers (loss, gradient, curvature) or the product, without the penalty.
        """
        models = np.array(sorted(asked), dtype=np.int64)
        gradient = np.array([asked[c][0] == GRADIENT for c in models.tolist()])
        n_terms = self.scale.shape[0]
        weights, direction = (np.zeros((n_terms, len(models)), order="F") for _ in range(2))  # a model's numbers side by side
        bias, tilt = np.zeros(len(models)), np.zeros(len(models))
        for i, c in enumerate(models.tolist()):
            own, scale = self.terms[c], self.scale[self.terms[c], c]
            weights[own, i], bias[i] = asked[c][1][:-1] * scale, asked[c][1][-1]
            if not gradient[i]:
                direction[own, i], tilt[i] = asked[c][2][:-1] * scale, asked[c][2][-1]
        if gradient.all():
            direction = direction[:0]
        self.pulls = gradient
        arrays = (models, gradient, weights, bias, direction, tilt)
        if sum(a.nbytes for a in arrays) < WITH_THE_TASK:
            total = self._add_up(self.read, Carried(arrays), n_terms, len(models))
        else:
            shared = self.frame.sparkSession.sparkContext.broadcast(arrays)
            try:
                total = self._add_up(self.read, shared, n_terms, len(models))
            finally:
                shared.destroy()
        sums, curves, tops, top_curves, loss = total
        out = {}
        for i, c in enumerate(models.tolist()):
            own, scale = self.terms[c], self.scale[self.terms[c], c]
            pulled = np.append(sums[own, i] * scale, tops[i])
            out[c] = (loss[i], pulled, np.append(curves[own, i] * scale ** 2, top_curves[i])) if gradient[i] else (pulled,)
        return out

    def _add_up(self, read, shared, n_terms: int, width: int) -> tuple[np.ndarray, ...]:
        """Sums over all rows. Where the partial ones are many, slices of the terms are added up by tasks
        of their own, so that the driver gets each sum once."""
        size = max(1, SLICE // width)  # terms of a slice
        pulls, kind = self.pulls, self.kind

        def zero(terms: int) -> list[np.ndarray]:
            return [np.zeros((terms, width)), np.zeros((terms, width)), np.zeros(width), np.zeros(width), np.zeros(width)]

        def packed(part: int, total: list[np.ndarray]) -> pa.RecordBatch:
            met = np.flatnonzero((total[0] != 0).any(axis=1) | (total[1] != 0).any(axis=1))
            sums = total[0][met]
            data = [met.astype("<i4"), sums[:, pulls], sums[:, ~pulls].astype(kind), total[1][met][:, pulls].astype(kind), *total[2:]]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()),
                                               *[pa.array([d.tobytes()], pa.binary()) for d in data]], ["part", *names])

        def add(total: list[np.ndarray], row: list, first: int = 0) -> None:
            met = np.frombuffer(row[0], dtype="<i4").astype(np.int64)[:, None] + first
            for i, data, columns, held in ((0, row[1], pulls, "<f8"), (0, row[2], ~pulls, kind), (1, row[3], pulls, kind)):
                if len(data):
                    total[i][met, np.flatnonzero(columns)] += np.frombuffer(data, dtype=held).reshape(len(met), -1)
            for i in (2, 3, 4):
                total[i] += np.frombuffer(row[2 + i])

        def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = zero(n_terms)
            for batch in batches:
                for stretch in read(batch):
                    for rows in stretch.pieces(width):
                        term, *found = _sums(rows, *shared.value)
                        total[0][term] += found[0]
                        total[1][term] += found[1]
                        for i in (2, 3, 4):
                            total[i] += found[i]
            for part, at in enumerate(range(0, max(n_terms, 1), size)):  # the intercepts' sums stand in the first slice
                tops = total[2:] if not part else [np.zeros(width)] * 3
                yield packed(part, [total[0][at:at + size], total[1][at:at + size], *tops])

        def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.column("part")[i].as_py()
                    if part not in totals:
                        totals[part] = zero(min(size, n_terms - part * size))
                    add(totals[part], [batch.column(n)[i].as_buffer() for n in names])
            for part, total in totals.items():
                yield packed(part, total)

        names = ["met", "sums", "products", "curves", "tops", "top_curves", "loss"]
        ddl = "part int, " + ", ".join(f"{n} binary" for n in names)
        partial = self.frame.mapInArrow(one_pass, ddl)
        if self.parts is None or self.parts * n_terms * width * 16 > DIRECT:
            partial = partial.repartition(min(PARTIALS, math.ceil(n_terms / size) or 1), "part").mapInArrow(gathered, ddl)
        total = zero(n_terms)
        for row in partial.collect():
            add(total, list(row)[1:], row["part"] * size)
        return tuple(total)

    def solve(self, rows_of: list[int], tol: float, max_iter: int, kept: int = 0) -> list[np.ndarray]:
        """Coefficients (terms, then intercept) of every model; ``rows_of`` holds the models' numbers of rows, ``kept``
        is that of ``newton``."""
        steps = {c: newton(len(self.terms[c]), tol * max(rows_of[c], 1), max_iter, kept) for c in range(len(self.terms))}
        asked = {c: next(s) for c, s in steps.items()}
        done: dict[int, np.ndarray] = {}
        while asked:
            answers = self.run(asked)
            for c, answer in answers.items():
                try:
                    asked[c] = steps[c].send(answer)
                except StopIteration as end:
                    done[c] = end.value
                    del asked[c]
        return [done[c] for c in sorted(done)]


def newton(terms: int, tol: float, max_iter: int, kept: int = 0) -> Generator[tuple, tuple, np.ndarray]:
    """Truncated Newton steps for one model: asks for passes, returns the coefficients.

    Stops once no entry of the gradient exceeds ``tol``, or after ``max_iter`` steps. The last
    ``kept`` directions and their products go, in single precision, into the preconditioner of
    later steps (the two-loop recursion of L-BFGS), which then need fewer passes. The steps'
    own numbers stay in double precision.
    """
    met: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=kept)

    def ease(rest: np.ndarray, scale: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
        shares, rest = [], rest.copy()
        for way, product, bend in reversed(pairs):
            shares.append(float(way @ rest) / bend)
            rest -= shares[-1] * product
        rest *= scale
        for (way, product, bend), share in zip(pairs, reversed(shares)):
            rest += (share - float(product @ rest) / bend) * way
        return rest

    penalty = np.append(np.ones(terms), 0.0)
    x = np.zeros(terms + 1)

    def penalised(answer: tuple, at: np.ndarray) -> tuple:
        loss, slope, curve = answer
        return loss + 0.5 * float(penalty @ (at * at)), slope + penalty * at, curve + penalty

    loss, slope, curve = penalised((yield GRADIENT, x), x)
    for _ in range(max_iter):
        size = float(np.abs(slope).max(initial=0.0))
        if size <= tol:
            break
        # conjugate gradients on the Newton system, preconditioned by the curvature's diagonal and what earlier steps met
        scale = 1.0 / np.maximum(curve, 1e-12)
        step, rest, pairs = np.zeros_like(x), -slope, list(met)
        eased = ease(rest, scale, pairs)
        along, product = eased, float(rest @ eased)
        enough = product * min(0.1, math.sqrt(size / max(tol, 1e-300)) * 1e-3 + 1e-3) ** 2
        for _ in range(200):
            (pulled,) = yield HESSIAN, x, along
            pulled = pulled + penalty * along
            bend = float(along @ pulled)
            if bend <= 0.0:
                break
            if kept:
                met.append((along.astype(np.float32), pulled.astype(np.float32), bend))
            far = product / bend
            step, rest = step + far * along, rest - far * pulled
            eased = ease(rest, scale, pairs)
            product, before = float(rest @ eased), product
            if product <= enough:
                break
            along = eased + (product / before) * along
        down = float(slope @ step)
        if down >= 0.0:  # nothing left to gain in double precision
            break
        length = 1.0
        while True:
            tried = x + length * step
            answer = penalised((yield GRADIENT, tried), tried)
            # near the optimum the loss no longer tells: a smaller gradient then does
            if answer[0] <= loss + 1e-4 * length * down or np.abs(answer[1]).max() < 0.5 * size:
                x, (loss, slope, curve) = tried, answer
                break
            length *= 0.5
            if length < 1e-6:
                return x
    return x


def partitioned(rows: DataFrame, n_rows: int, rows_per_partition: int = ROWS_PER_PARTITION,
                pack: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, int]:
    """Rows for repeated passes and their partitions: sized by row count, packed, written to the shared folder, then cached.

    A lost executor costs a re-read instead of the work that made the rows. ``release`` ends it.
    """
    most = PARTITIONS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(most, math.ceil(n_rows / rows_per_partition)))
    return cut_lineage(pack(rows.repartition(parts))).persist(StorageLevel.MEMORY_AND_DISK), parts


def release(frame: DataFrame) -> None:
    frame.unpersist(blocking=True)
    drop_cut(frame)


def _vector_rows(dataset: DataFrame, features_col: str, label_col: str) -> DataFrame:
    return dataset.select(F.col(label_col).cast("double").alias("label"), F.col(features_col).alias("features"))


def certificate(features: DataFrame, weights: np.ndarray, intercept: float, features_col: str = "features",
                label_col: str = "label") -> dict[str, float]:
    """What shows that (weights, intercept) minimises the mean penalised loss: one pass over the rows.

    ``gradient`` is the largest entry of the gradient, ``intercept_gradient`` that of the
    intercept, ``loss`` the mean loss with the penalty, ``zero_loss`` that of the zero model.
    """
    rows = _vector_rows(features, features_col, label_col)
    n = rows.count()
    fitter = Fitter(rows, vectors, np.ones((len(weights), 1)))
    loss, slope, _ = fitter.run({0: (GRADIENT, np.append(weights, intercept))})[0]
    slope = slope + np.append(weights, 0.0)
    return {"rows": n, "gradient": float(np.abs(slope).max()) / max(n, 1), "intercept_gradient": float(abs(slope[-1])) / max(n, 1),
            "loss": (loss + 0.5 * float(weights @ weights)) / max(n, 1), "zero_loss": math.log(2.0)}


class NewtonLogisticRegression(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasTol,
                               DefaultParamsReadable, DefaultParamsWritable):
    """Binary logistic regression with penalty |w|^2 / 2 on the summed loss (C = 1) and a free intercept.

    ``tol`` bounds the gradient of the mean loss, not the gain of a step. The fitted model
    is Spark's own LogisticRegressionModel. Features are ML vectors, labels 0 or 1.
    """

    numFeatures = Param(Params._dummy(), "numFeatures", "size of the vectors; 0: that of the first row", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", maxIter=100, tol=1e-10, numFeatures=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=100, tol=1e-10, numFeatures=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        rows = _vector_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        n = rows.count()
        size = self.getOrDefault(self.numFeatures)
        if not size:
            first = rows.select("features").first()
            size = first["features"].size if first else 0
        frame, parts = partitioned(rows, n, pack=in_stretches)
        try:
            found = Fitter(frame, of_stretches, np.ones((size, 1)), parts).solve([n], self.getTol(), self.getMaxIter())[0]
        finally:
            release(frame)
        return self.model_of(found)

    def model_of(self, found: np.ndarray) -> LogisticRegressionModel:
        """Spark's model with the coefficients and, last, the intercept of ``found``."""
        java = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel", self.uid,
                                         Vectors.dense(found[:-1]), float(found[-1]))
        model = LogisticRegressionModel(java)
        model._resetUid(self.uid)
        return model.setFeaturesCol(self.getFeaturesCol())
