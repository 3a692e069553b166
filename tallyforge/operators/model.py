"""A ridge regression of user labels on metrics. Spark sums the Gram matrix; the driver solves a system of the features' size."""

from __future__ import annotations

import csv
import io
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry

_SAME = "function IS NULL OR function = unit_function"
NOTICE = "Experimental: this model only reflects the labels it was trained on; it is no general measure of quality."
FOLDS = 5


@dataclass
class Label:
    path: str
    function: str | None
    score: float


@dataclass
class Model:
    scope: str
    features: list[str]
    means: list[float]
    sds: list[float]
    coefficients: list[float]
    intercept: float
    lambda_: float
    n: int
    r_squared: float
    cv_rmse: float | None
    excluded_features: dict[str, str] = field(default_factory=dict)
    notice: str = NOTICE

    def to_json(self) -> str:
        d = asdict(self)
        d["lambda"] = d.pop("lambda_")
        return json.dumps({"notice": d.pop("notice"), **d}, indent=2) + "\n"

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        d["lambda_"] = d.pop("lambda")
        m = Model(**d)
        if not len(m.features) == len(m.means) == len(m.sds) == len(m.coefficients):
            raise ValueError("model: features, means, sds and coefficients differ in length; train the model again")
        return m


def read_labels(text: str) -> list[Label]:
    """path,function,score; an empty function labels the file."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows or rows[0] != ["path", "function", "score"]:
        raise ValueError("labels: the header must be exactly path,function,score")
    out = []
    for k, r in enumerate(rows[1:], 2):
        if not r:
            continue
        if len(r) != 3:
            raise ValueError(f"labels, row {k}: three columns are needed")
        try:
            score = float(r[2])
        except ValueError:
            raise ValueError(f"labels, row {k}: score must be a finite number, not {r[2]!r}") from None
        if not math.isfinite(score):
            raise ValueError(f"labels, row {k}: score must be finite, not {r[2]}")
        out.append(Label(r[0], r[1] or None, score))
    return out


def label_scope(labels: list[Label]) -> str:
    kinds = {x.function is not None for x in labels}
    if len(kinds) > 1:
        raise ValueError("labels: either all rows name a function or none; split them into two files")
    return "function" if kinds == {True} else "file"


def _first_units(units: DataFrame) -> DataFrame:
    """The units of the first result that has their path."""
    first = units.groupBy("path").agg(F.min("result_no").alias("result_no"))
    return units.join(first, ["path", "result_no"]).withColumnRenamed("function", "unit_function")


def label_matches(units: DataFrame, labels: DataFrame) -> DataFrame:
    """row_idx, path, function, n (units that the label meets), in_path (units of its path). labels: row_idx, path, function;
    without a function a label means the unit of the whole file."""
    met = labels.join(_first_units(units), "path", "left").groupBy("row_idx", "path", "function")
    return met.agg(F.count_if(F.expr(f"({_SAME}) AND result_no IS NOT NULL")).alias("n"), F.count("result_no").alias("in_path"))


def join_labels(units: DataFrame, failed: list[str], labels: list[Label]) -> DataFrame:
    """Labels with their unit's metrics, numbered in label order. units: as sinks.output.units gives them.

    The first result that has the path counts. A label must meet exactly one unit.
    """
    spark = units.sparkSession
    table = spark.createDataFrame([(k, x.path, x.function, x.score) for k, x in enumerate(labels)], "row_idx int, path string, function string, score double")
    for r in label_matches(units, table).filter("n <> 1").orderBy("row_idx").limit(1).collect():
        if r.path in failed and not r.in_path:
            raise ValueError(f"labels: {r.path} could not be parsed; remove its label")
        if r.function is None or not r.n:
            what = f"function {r.function} in {r.path}" if r.function and r.in_path else r.path
            raise ValueError(f"labels: {what} is not in the results; analyze it or remove the label")
        raise ValueError(f"labels: {r.path} has several functions named {r.function}; remove the label")
    return table.join(_first_units(units), "path").filter(_SAME)


def _solve(gram: np.ndarray, xy: np.ndarray, lam: float) -> np.ndarray:
    """(gram + lam I) b = xy by elimination with partial pivoting."""
    a = np.concatenate([gram + lam * np.eye(len(gram)), xy[:, None]], axis=1)
    for k in range(len(gram)):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        if abs(a[p, k]) < 1e-12:
            raise ValueError("model: features are linearly dependent; raise lambda or choose fewer features")
        a[[k, p]] = a[[p, k]]
        a[k + 1 :] -= np.outer(a[k + 1 :, k] / a[k, k], a[k])
    out = np.zeros(len(gram))
    for k in range(len(gram) - 1, -1, -1):
        out[k] = (a[k, -1] - a[k, k + 1 : -1] @ out[k + 1 :]) / a[k, k]
    return out


def sums(rows: DataFrame, features: list[str], score: str, fold: Column, centre: list[float]) -> dict[int, np.ndarray]:
    """For each fold the sums of products of (1, features, score): all that fits and their errors need. centre: what is taken
    off each column first, near its mean, so that the sums keep the digits of the spread."""
    v = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(x) for c, x in zip([*features, score], centre, strict=True)]]
    cells = [F.sum(v[i] * v[j]).alias(f"s{i}_{j}") for i in range(len(v)) for j in range(i, len(v))]
    out = {}
    for r in rows.groupBy(fold.alias("fold")).agg(*cells).collect():
        m = np.zeros((len(v), len(v)))
        for i in range(len(v)):
            for j in range(i, len(v)):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r["fold"]] = m
    return out


def ridge(m: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(means, sds, coefficients, intercept) from a matrix of sums: z-scores with population sd, intercept unpenalised."""
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(sd > 0, sd, 1.0)
    y = m[0, -1] / n
    gram = n * cov / np.outer(scale, scale) * np.outer(sd > 0, sd > 0)
    xy = (m[1:-1, -1] - n * mean * y) / scale * (sd > 0)
    return mean, sd, _solve(gram, xy, lam), y


def squared_error(m: np.ndarray, mean: np.ndarray, sd: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    """The sum of squared errors of a model over the rows behind a matrix of sums."""
    w = np.where(sd > 0, coef / np.where(sd > 0, sd, 1), 0)
    c = np.concatenate([[intercept - w @ mean], w, [-1.0]])
    return max(0.0, float(c @ m @ c))


def select_features(rows: DataFrame, candidates: list[str], explicit: list[str] | None, public=lambda c: c) -> tuple[list[str], dict[str, str]]:
    """Usable features, and why the others aren't: missing for some labelled unit, or constant over them."""
    asked = explicit or candidates
    unknown = [c for c in asked if c not in candidates]
    if unknown:
        raise ValueError(f"model: {public(unknown[0])} is no metric of this scope")
    agg = rows.agg(*[x for c in asked for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__k"), (F.min(c) == F.max(c)).alias(f"{c}__same"))]).first()
    good, excluded = [], {}
    for c in asked:
        if agg[f"{c}__k"]:
            excluded[public(c)] = f"missing for {agg[f'{c}__k']} labelled unit(s)"
        elif agg[f"{c}__same"] or agg[f"{c}__same"] is None:
            excluded[public(c)] = "constant over the labelled units"
        else:
            good.append(c)
    if explicit and excluded:
        name, why = next(iter(excluded.items()))
        raise ValueError(f"model: {name} can't be used: {why}")
    if not good:
        raise ValueError("model: no usable feature; label more units")
    return good, excluded


def public_id(column: str) -> str:
    return next((m for m in registry.IDS if registry.column(m) == column), column)


def fit(rows: DataFrame, scope: str, candidates: list[str], features: list[str] | None = None, lam: float = 1.0, score: str = "score", index: str = "row_idx", public=public_id) -> Model:
    """rows: a row for each label, numbered by index, with a column for each candidate."""
    if not lam >= 0:
        raise ValueError("model: lambda must be 0 or more")
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(score), F.max(score)).first()
    if n < 2:
        raise ValueError("model: at least 2 labels are needed")
    if lo == hi:
        raise ValueError("model: all labels are equal; label units that differ")
    used, excluded = select_features(rows, candidates, features, public)
    centre = [float(x) for x in rows.agg(*[F.avg(F.col(c).cast("double")) for c in [*used, score]]).first()]
    folds = sums(rows, used, score, F.col(index) % FOLDS, centre)
    total = sum(folds.values())
    mean, sd, coef, intercept = ridge(total, lam)
    spread = total[-1, -1] - total[0, -1] ** 2 / total[0, 0]
    r2 = 1 - squared_error(total, mean, sd, coef, intercept) / spread
    cv = None
    if n >= FOLDS:
        errors = sum(squared_error(own, *ridge(total - own, lam)) for own in folds.values())
        cv = math.sqrt(errors / n)
    return Model(scope, [public(c) for c in used], (mean + centre[:-1]).tolist(), sd.tolist(), coef.tolist(), float(intercept + centre[-1]), lam, int(n), float(r2), cv, excluded)


def predict(model: Model, units: DataFrame, column=registry.column) -> DataFrame:
    """units with score and unavailable: null and the reason where a feature is null (the first in the model's order)."""
    score, reason = F.lit(model.intercept), F.lit(None).cast("string")
    for f, m, s, c in zip(model.features, model.means, model.sds, model.coefficients, strict=True):
        v = F.col(column(f)).cast("double")
        score = score + ((v - m) / s * c if s > 0 else v * 0)
        reason = F.coalesce(reason, F.when(v.isNull(), F.lit(f"{f} is null")))
    return units.withColumn("score", score).withColumn("unavailable", reason)
