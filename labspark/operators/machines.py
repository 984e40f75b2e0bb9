"""Linear support vector machines on TF-IDF of counted vectors, one per class, over a table of narrow rows.

MLlib's machines hold the vectors in the executors' memory twice, as 64-bit numbers, and read them anew for every class. Here a
row is written once as the places and counts of its vector; the weights of the columns and the norm of a row are factors
of the products. All machines ask for their next loss and gradient together, so one job over the table serves them
all, and a task holds a batch of rows and a few vectors, whatever the table's size.

The search is that of MLlib's LinearSVC (OWL-QN without a penalty, ten steps of history, its line search and stopping
rules), on standardised and centred columns. Machines agree with MLlib's to rounding, but the loss has kinks, and a long
search can part from MLlib's: 2 of 20 did that were compared, with the same predictions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, OneVsRest, OneVsRestModel
from pyspark.ml.feature import IDF, Normalizer
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.tables import written

#: Machines that are fitted in step; more classes are fitted group by group.
IN_STEP = 32
#: Cells of the matrix that a task fills at once (a megabyte stays in a core's cache), and sums of tasks that the driver
#: adds up by itself.
CELLS = 1 << 17
FEW_SUMS = 64
_PACKED = "label double, norm double, at binary, n binary, wide binary"
#: The largest count kept in a byte stands for itself or more, which then is in ``wide``.
_BYTE = 255

Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class _StepError(Exception):
    """The search can't go on with its history, or with none."""


# ---------------------------------------------------------------------------------------
# Rows
# ---------------------------------------------------------------------------------------
def packed(rows: DataFrame, label: str, counts: str, weights: np.ndarray) -> DataFrame:
    """(label, norm, at, n, wide): each vector of counts as places and counts, with the norm of its weighted entries."""
    place = _places(len(weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            out: tuple[list, ...] = ([], [], [], [])
            for indices, values in zip(vectors.field("indices"), vectors.field("values")):
                value = values.values.to_numpy()
                found = indices.values.to_numpy() if indices.is_valid else np.arange(len(value))
                n = value.astype(np.uint32)
                if (n != value).any():
                    raise ValueError("counts must be whole numbers")
                out[0].append(math.sqrt(np.square(value * weights[found]).sum()))
                out[1].append(found.astype(place).tobytes())
                out[2].append(np.minimum(n, _BYTE).astype(np.uint8).tobytes())
                out[3].append(n[n >= _BYTE].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.float64()), *[pa.array(o, pa.binary()) for o in out[1:]]],
                ["label", "norm", "at", "n", "wide"])

    return written(rows.select(F.col(label).cast("double"), counts).mapInArrow(work, _PACKED), "packed")


def _places(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _cells(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes, and where those of each row end."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    numbers = np.frombuffer(data if data is not None else b"", np.uint8)[ends[0]:ends[-1]].view(kind)
    return numbers, (ends - ends[0]) // np.dtype(kind).itemsize


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(label, 1 / norm, matrix of counts) of some rows at a time; the matrix is filled anew each time."""
    most = max(1, CELLS // size)
    cells = np.empty(most * size)
    for batch in batches:
        label, norm = (batch.column(i).to_numpy() for i in (0, 1))
        scale = np.divide(1.0, norm, out=np.zeros(len(norm)), where=norm != 0)
        (at, ends), (n, _), (wide, wide_ends) = (
            _cells(batch.column(i), kind) for i, kind in ((2, _places(size)), (3, np.uint8), (4, np.uint32)))
        for low in range(0, len(label), most):
            high = min(low + most, len(label))
            some = slice(ends[low], ends[high])
            values = n[some].astype(np.float64)
            if wide_ends[low] < wide_ends[high]:
                values[n[some] == _BYTE] = wide[wide_ends[low]:wide_ends[high]]
            where = np.repeat(np.arange(high - low) * size, np.diff(ends[low:high + 1]))
            where += at[some]
            matrix = cells[:(high - low) * size]
            matrix.fill(0.0)
            matrix[where] = values
            yield label[low:high], scale[low:high], matrix.reshape(-1, size)


def _summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None],
            shape: tuple[int, ...]) -> np.ndarray:
    """What ``add(sums, label, scale, matrix)`` adds to an array over all rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape)
        for block in _matrices(batches, size):
            add(sums, *block)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape)
        for batch in batches:
            for part in batch.column(0):
                sums += np.frombuffer(part.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

    parts = rows.mapInArrow(task, "sums binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > FEW_SUMS:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(total, "sums binary")
    sums = np.zeros(shape)
    for part in parts.collect():  # at most FEW_SUMS, or a root of the number of tasks
        sums += np.frombuffer(part["sums"]).reshape(shape)
    return sums


# ---------------------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------------------
def minimum(start: np.ndarray, iterations: int, tolerance: float, memory: int = 10) -> Search:
    """Yields points, is sent (value, gradient) of each, and returns the last point of the search."""
    known: list = [None, None]

    def at(x: np.ndarray) -> Search:
        if known[0] is None or not np.array_equal(known[0], x):
            known[:] = x, (yield x)
        return known[1]

    def steps(x: np.ndarray, gradient: np.ndarray, direction: np.ndarray) -> Callable[[float], np.ndarray]:
        side = np.where(x != 0, np.sign(x), np.sign(-gradient))

        def step(alpha: float) -> np.ndarray:
            moved = x + direction * alpha
            return np.where(np.sign(moved) == side, moved, 0.0)
        return step

    x, history, failed, done = start, [], False, 0
    value, gradient = yield from at(x)
    initial, values = value, [math.inf]
    while True:
        flat = len(values) >= 2 and abs(value - max(values)) <= tolerance * abs(initial)
        if done >= iterations or flat or np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            return x
        try:
            direction = _direction(gradient, history)
            direction = np.where(direction * gradient < 0, direction, 0.0)
            step = steps(x, gradient, direction)
            first = done < 1
            alpha = yield from _length(at, step, direction, value, float(direction @ gradient), 0.1 if first else 0.5,
                                       0.5 / np.linalg.norm(gradient) if first else 1.0)
        except _StepError:
            if failed:
                return x
            failed, history = True, []
            continue
        moved = step(alpha)
        next_value, next_gradient = yield from at(moved)
        history = [(moved - x, next_gradient - gradient), *history][:memory]
        x, value, gradient, done, failed = moved, next_value, next_gradient, done + 1, False
        values = [*values, value][-20:]


def _direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times the inverse Hessian that the last steps tell of, newest first."""
    out, scale = gradient.copy(), 1.0
    if history:
        moved, change = history[0]
        product = moved @ change
        if product < 0 or math.isnan(product):
            raise _StepError
        with np.errstate(all="ignore"):
            scale = product / (change @ change)
    factors = []
    for moved, change in history:
        with np.errstate(all="ignore"):
            product = moved @ change
            factor = (moved @ out) / product
        if math.isnan(factor):
            raise _StepError
        factors.append((factor, product))
        out -= factor * change
    out *= scale
    for (factor, product), (moved, change) in zip(reversed(factors), reversed(history)):
        with np.errstate(all="ignore"):
            out += (factor - (change @ out) / product) * moved
    return -out


def _length(at: Callable[[np.ndarray], Search], step: Callable[[float], np.ndarray], direction: np.ndarray, initial: float,
            slope: float, shrink: float, alpha: float, tries: int = 20) -> Generator[np.ndarray, tuple, float]:
    """The length of a step, by backtracking to the strong Wolfe conditions.

    As in MLlib the first length counts with the value at its start, so it is shrunk unless the slope is nought to
    rounding; what holds there is asked for only then.
    """
    value, steep = initial, None
    for _ in range(tries):
        if value > initial + alpha * slope * 1e-4:
            factor = shrink
        else:
            if steep is None:
                steep = float(direction @ (yield from at(step(alpha)))[1])
            factor = 2.1 if steep < 0.9 * slope else shrink if steep > -0.9 * slope else 1.0
        if factor == 1.0:
            break
        last, alpha = alpha, alpha * factor
        if not 1e-10 <= alpha <= 1e10 and not math.isnan(alpha):
            raise _StepError
        value, gradient = yield from at(step(alpha))
        steep = float(direction @ gradient)
    else:
        return last
    return alpha


# ---------------------------------------------------------------------------------------
# Machines
# ---------------------------------------------------------------------------------------
def coefficients(rows: DataFrame, weights: np.ndarray, classes: int, iterations: int, tolerance: float) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of the machine of each class against the others, for rows from :func:`packed`."""
    size = len(weights)
    first = rows.limit(1).mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([(matrix * weights * scale[:, None])[0].tobytes()])], ["x"])
                         for _, scale, matrix in _matrices(batches, size)), "x binary").first()
    anchor = np.frombuffer(first["x"])  # sums about a row are nought, not nearly, where all rows agree

    def spread(sums: np.ndarray, label: np.ndarray, scale: np.ndarray, matrix: np.ndarray) -> None:
        matrix *= weights
        matrix *= scale[:, None]
        matrix -= anchor
        sums[0, :size] += matrix.sum(0)
        sums[1, :size] += np.einsum("ij,ij->j", matrix, matrix)
        sums[:, size] += len(label)

    sums = _summed(rows, size, spread, (2, size + 1))
    n, about, squares = sums[0, size], sums[0, :size], sums[1, :size]
    deviation = np.sqrt(np.maximum(squares - about * about / n, 0.0) / (n - 1)) if n > 1 else np.zeros(size)
    inverse = np.divide(1.0, deviation, out=np.zeros(size), where=deviation != 0)
    centre = (anchor + about / n) * inverse
    factors = weights * inverse

    def asked(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        """Mean hinge loss and gradient of each class at its point."""
        of = np.array(list(points), np.float64)
        at = np.array(list(points.values()))
        linear, offset = at[:, :size] * factors, at[:, size] - at[:, :size] @ centre

        def add(sums: np.ndarray, label: np.ndarray, scale: np.ndarray, matrix: np.ndarray) -> None:
            side = np.where(label == of[:, None], 1.0, -1.0)
            loss = 1.0 - side * ((linear @ matrix.T) * scale + offset[:, None])
            pull = np.where(loss > 0, -side, 0.0)
            sums[:, :size] += (pull * scale) @ matrix
            sums[:, size] += pull.sum(1)
            sums[:, size + 1] += np.maximum(loss, 0.0).sum(1)

        found = _summed(rows, size, add, (len(points), size + 2))
        return {k: (loss / n, np.append(factors * pulled - pull * centre, pull) / n)
                for k, pulled, pull, loss in zip(points, found[:, :size], found[:, size], found[:, size + 1])}

    ended: dict[int, np.ndarray] = {}
    for low in range(0, classes, IN_STEP):
        searches = {k: minimum(np.zeros(size + 1), iterations, tolerance) for k in range(low, min(low + IN_STEP, classes))}
        points = {k: next(search) for k, search in searches.items()}
        while points:
            answers, points = asked(points), {}
            for k, answer in answers.items():
                try:
                    points[k] = searches[k].send(answer)
                except StopIteration as stop:
                    ended[k] = stop.value
    return [(ended[k][:size] * inverse, float(ended[k][size] - ended[k][:size] @ centre)) for k in range(classes)]


class CountMachines(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """TF-IDF of vectors of counts, scaled to length one, and a linear machine per class: weights, norms and machines as a pipeline."""

    counts = Param(Params._dummy(), "counts", "column of vectors of whole numbers", TypeConverters.toString)
    label = Param(Params._dummy(), "label", "column of class numbers from 0", TypeConverters.toString)
    iterations = Param(Params._dummy(), "iterations", "most steps of a search", TypeConverters.toInt)

    def __init__(self, **values):
        super().__init__()
        self._set(**values)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        counts, label, iterations = map(self.getOrDefault, (self.counts, self.label, self.iterations))
        idf = IDF(inputCol=counts, outputCol="weighted").fit(dataset)
        machine = LinearSVC(maxIter=iterations)
        rest = OneVsRest(classifier=machine, labelCol=label, parallelism=1)
        weights = idf.idf.toArray()
        rows = packed(dataset, label, counts, weights)
        classes = int(rows.agg(F.max("label").alias("last")).first()["last"]) + 1
        models = []
        for linear, intercept in coefficients(rows, weights, classes, iterations, machine.getTol()):
            fitted = JavaParams._new_java_obj(
                "org.apache.spark.ml.classification.LinearSVCModel", machine.uid, DenseVector(linear), intercept)
            models.append(machine._copyValues(LinearSVCModel(fitted)))
        return PipelineModel([idf, Normalizer(inputCol="weighted", outputCol="features"),
                              rest._copyValues(OneVsRestModel(models=models))])
