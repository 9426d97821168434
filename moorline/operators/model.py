"""The linear control: TF-IDF of the body, with or without context similarities, and ridge logistic regression."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from moorline.operators import tfidf
from moorline.session import dropped, written
from moorline.sources.tables import EXAMPLES

C, MAX_ITER, TOLERANCE = 2.0, 200, 1e-5
EXTRA = (*(f"similarity_{c}" for c in ("rule", *EXAMPLES)), "max_positive_similarity", "max_negative_similarity", "similarity_margin")
MODELS = ("comment_only", "rule_examples")


@dataclass
class Control:
    """A fitted control."""

    terms: tfidf.Vocabulary
    model: LogisticRegressionModel
    context: bool

    def predict(self, frame: DataFrame) -> DataFrame:
        """row_id, probability."""
        out = self.model.transform(entries(tfidf.gathered(frame, _columns(self.context)), self.terms, self.context, vector=True))
        return out.select("row_id", vector_to_array("probability")[1].alias("probability"))

    def coefficients(self) -> DataFrame:
        """feature, coefficient: the terms, and the similarities where the model has them."""
        names = [*self.terms.terms, *(EXTRA if self.context else ())]
        return SparkSession.active().createDataFrame([*zip(names, self.model.coefficients.toArray().tolist(), strict=False)], "feature string, coefficient double")  # the last coefficient is the constant's


def _columns(context: bool) -> tuple[str, ...]:
    return tfidf.COLUMNS if context else ("body",)


def entries(docs: DataFrame, terms: tfidf.Vocabulary, context: bool, vector: bool = False) -> DataFrame:
    """row_id, indices and values (with vector: features) of the columns (terms, similarities, and a constant 1 so that the intercept is penalised like the rest), and the labels of gathered documents that have them."""
    own = ["row_id", "labels"] if "labels" in docs.columns else ["row_id"]
    shared, size = docs.sparkSession.sparkContext.broadcast(terms), len(terms.terms)
    width = size + (len(EXTRA) if context else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, different, of in tfidf._parts(batches):
            start, place, w = shared.value.vectors(different)
            body = of[:, 0]
            n = np.where(body >= 0, np.diff(np.append(start, start[-1]))[body], 0)
            first = np.where(body >= 0, start[body], 0)
            take = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            more = np.ones((len(of), width - size + 1))
            if context:
                d = tfidf.dots(start, place, w, of, size)
                pos, neg = d[:, 1:3].max(1), d[:, 3:5].max(1)
                more[:, :-1] = np.column_stack([d, pos, neg, pos - neg])
            ends = np.cumsum(n + more.shape[1])
            index, value = np.empty(ends[-1], np.int32), np.empty(ends[-1])
            last = (ends[:, None] - more.shape[1] + np.arange(more.shape[1])).ravel()
            term = np.ones(ends[-1], bool)
            term[last] = False
            index[term], value[term] = place[take], w[take]
            index[last], value[last] = np.tile(np.arange(size, width + 1), len(of)), more.ravel()
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(index)), pa.ListArray.from_arrays(offsets, pa.array(value))]
            if vector:
                lists = [pa.StructArray.from_arrays([pa.array(np.zeros(len(of), np.int8)), pa.array(np.full(len(of), width + 1, np.int32)), *lists], names=["type", "size", "indices", "values"])]
            columns = [pa.array([r[k] for r in rows], pa.list_(pa.float64()) if k == "labels" else None) for k in own]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=schema.names)

    made = [("features", VectorUDT())] if vector else [("indices", ArrayType(IntegerType())), ("values", ArrayType(DoubleType()))]
    schema = StructType([*(docs.schema[k] for k in own), *(StructField(*x) for x in made)])
    return docs.filter("row_id is not null").select(F.struct(*own).alias("row"), *_columns(context)).mapInArrow(run, schema)


def _sums(data: DataFrame, w: np.ndarray, dense: int, v: np.ndarray | None = None) -> np.ndarray:
    """One pass over the data, summed: the loss, its gradient, the Hessian's diagonal and the block of the last `dense` columns; with v only the Hessian times v."""
    size, shared = len(w), data.sparkSession.sparkContext.broadcast((w, v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v = shared.value
        total = np.zeros(size if v is not None else 1 + 2 * size + dense * dense)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, x = batch.column(0).to_numpy(), batch.column(1)
            i, c = x.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            n = np.diff(x.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            z = np.bincount(row, c * w[i], len(n))
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            if v is not None:
                total += np.bincount(i, c * (p * (1 - p) * np.bincount(row, c * v[i], len(n)))[row], size)
                continue
            total[0] += (np.logaddexp(0, z) - y * z).sum()
            total[1 : size + 1] += np.bincount(i, c * (p - y)[row], size)
            d = p * (1 - p)
            total[size + 1 : 2 * size + 1] += np.bincount(i, c * c * d[row], size)
            last = c[(np.cumsum(n) - dense)[:, None] + np.arange(dense)]
            total[2 * size + 1 :] += ((last * d[:, None]).T @ last).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["s"])

    out = np.zeros(size if v is not None else 1 + 2 * size + dense * dense)
    for batch in data.mapInArrow(run, "s array<double>").toArrow().to_batches():
        for s in batch.column(0):
            out += s.values.to_numpy()
    shared.destroy()
    return out


def optimum(data: DataFrame, size: int, dense: int, penalty: float) -> np.ndarray:
    """The weights of least mean loss plus penalty / 2 times their squares, by Newton steps of conjugate gradients; data: label, indices, values.

    Every row ends with `dense` columns that all rows have; they and the diagonal precondition the steps, so that the
    number of passes hardly grows with the rows. A gradient of TOLERANCE times the first one ends it.
    """
    n = max(1, data.count())
    w = np.zeros(size)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        s = _sums(data, w, dense) / n
        block = s[2 * size + 1 :].reshape(dense, dense) + penalty * np.eye(dense)
        return s[0] + penalty / 2 * (w @ w), s[1 : size + 1] + penalty * w, s[size + 1 : 2 * size + 1] + penalty, np.linalg.inv(block)

    loss, g, diagonal, block = at(w)
    first = np.linalg.norm(g)
    for _ in range(MAX_ITER):
        norm = np.linalg.norm(g)
        if norm <= TOLERANCE * first:
            return w

        def eased(r: np.ndarray, diagonal: np.ndarray = diagonal, block: np.ndarray = block) -> np.ndarray:
            return np.append(r[: size - dense] / diagonal[: size - dense], block @ r[size - dense :])

        step, r = np.zeros(size), -g
        z = eased(r)
        d, rz = z, r @ z
        enough = rz * min(0.1, norm / first) ** 2  # closer as the optimum nears
        for _ in range(MAX_ITER):
            h = _sums(data, w, dense, d) / n + penalty * d
            a = rz / (d @ h)
            step, r = step + a * d, r - a * h
            z = eased(r)
            new = r @ z
            if new <= enough:
                break
            d, rz = z + new / rz * d, new
        t, slope = 1.0, g @ step
        while (found := at(w + t * step))[0] > loss + 1e-4 * t * slope + 1e-12 * abs(loss) and t > 1e-6:
            t /= 2
        w, (loss, g, diagonal, block) = w + t * step, found
    raise RuntimeError("the regression did not converge")


def fit(frame: DataFrame, context: bool = True, most: int = tfidf.FEATURES) -> Control:
    """The control fitted on labelled rows; every cell of the columns in use is a document of the vocabulary."""
    docs = tfidf.gathered(frame, _columns(context), F.col("rule_violation").cast("double"))
    terms = tfidf.Vocabulary(tfidf.terms_of(frame, docs.drop("labels"), _columns(context), most))
    n = frame.count()
    data = written(entries(docs, terms, context).select(F.explode("labels").alias("label"), "indices", "values"), "features")
    dense = 1 + (len(EXTRA) if context else 0)
    w = optimum(data, len(terms.terms) + dense, dense, 1.0 / (C * max(1, n)))
    dropped(data)
    sc = frame.sparkSession.sparkContext
    made = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"control_{uuid.uuid4().hex[:12]}", _py2java(sc, Vectors.dense(w)), 0.0)
    return Control(terms, LogisticRegressionModel(made), context)


def out_of_fold(train: DataFrame, roles: DataFrame, context: bool) -> DataFrame:
    """row_id, rule, rule_violation, probability, fold of every validation row; roles: fold, row_id, role after purging."""
    of = roles.groupBy("row_id").agg(*(F.collect_set(F.when(F.col("role") == r, F.col("fold"))).alias(f"_{r}") for r in ("train", "valid")))
    rows = written(train.select("row_id", "rule", "rule_violation", *(c for c in _columns(context) if c != "rule")).join(of, "row_id"), "rows")  # joined once for all folds
    out = None
    for fold in [r.fold for r in roles.select("fold").distinct().orderBy("fold").collect()]:
        part, valid = (rows.filter(F.array_contains(f"_{r}", F.lit(fold))).drop("_train", "_valid") for r in ("train", "valid"))
        scored = valid.select("row_id", "rule", "rule_violation").join(fit(part, context).predict(valid), "row_id").withColumn("fold", F.lit(fold))
        out = scored if out is None else out.unionByName(scored)
    return out


__all__ = ["Control", "MODELS", "array_to_vector", "entries", "fit", "optimum", "out_of_fold"]
