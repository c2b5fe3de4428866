"""Generalized linear models: one Spark aggregate and one small solve for each step."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.frame import RID, Frame, Rows
from quillframe.functions import ieee
from quillframe.ml.arguments import Case, sequence
from quillframe.ml.solver import SOLVERS, generalized_gradient
from quillframe.operators import factor as fac
from quillframe.operators import stats
from quillframe.operators.rows import fold

#: link: (link, inverse, derivative of the inverse, by the linear predictor), as columns.
LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "logit": (lambda m: F.ln(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda e: F.greatest(F.exp(-e) / ((1 + F.exp(-e)) * (1 + F.exp(-e))), F.lit(1e-10))),
    "log": (lambda m: F.ln(m), lambda e: F.exp(e), lambda e: F.exp(e)),
    "inverse": (lambda m: 1 / m, lambda e: 1 / F.when(F.abs(e) < 1e-8, 1e-8).otherwise(e), lambda e: -1 / F.greatest(e * e, F.lit(1e-12))),
}


def _deviance(family: str, y: np.ndarray, m: np.ndarray | float) -> np.ndarray:
    if family == "binomial":
        m = np.clip(m, 1e-12, 1 - 1e-12)
        return -2 * (y * np.log(m) + (1 - y) * np.log(1 - m))
    if family == "poisson":
        m = np.maximum(m, 1e-12)
        return 2 * (np.where(y > 0, y * np.log(y / m), 0.0) - (y - m))
    if family == "gamma":
        m = np.maximum(m, 1e-12)
        return 2 * (-np.log(np.maximum(y, 1e-12) / m) + (y - m) / m)
    return (y - m) * (y - m)


FAMILIES = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse"}


def _variance(family: str, m: Column) -> Column:
    return {"gaussian": F.lit(1.0), "binomial": F.greatest(m * (1 - m), F.lit(1e-10)), "poisson": F.greatest(m, F.lit(1e-10)), "gamma": m * m}[family]


@dataclass
class Validation:
    n: int
    dof: int
    deviance: float
    null_deviance: float
    aic: float
    error: float
    matrices: list[tuple[float, int, int, int, int]] = field(default_factory=list)
    auc: float | None = None
    threshold: float | None = None


@dataclass
class GlmModel:
    response: str
    terms: list[tuple[str, str | None]]  # a column, or one value of a categorical column
    beta: list[float]  # of the terms, then the intercept, in raw units
    family: str
    link: str
    iterations: int
    converged: bool
    case: str | None = None
    validation: Validation | None = None
    folds: list[Validation] = field(default_factory=list)
    lam: float = 0.0
    alpha: float = 0.0

    @property
    def coefficients(self) -> dict[str, float]:
        names = [c if v is None else f"{c}.{v}" for c, v in self.terms]
        return dict(zip([*names, "Intercept"], self.beta, strict=True))

    def columns(self, f: Frame) -> list[Column]:
        """The terms over a frame that has their columns by name."""
        return [ieee.dbl(f.columns[c]) if v is None else (_text(f, c) == v).cast("double") for c, v in self.terms]

    def predict(self, f: Frame) -> Column:
        """The mean of each row; NULL if a predictor is missing."""
        eta = F.lit(self.beta[-1])
        for b, x in zip(self.beta, self.columns(f), strict=False):
            eta = eta + F.lit(b) * x
        return LINKS[self.link][1](eta)

    def classify(self, f: Frame) -> Column:
        """Binomial: 1 if the mean reaches the validated threshold."""
        t = self.validation.threshold if self.validation and self.validation.threshold is not None else 0.5
        return (self.predict(f) >= t).cast("double")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> GlmModel:
        d = json.loads(text)
        v = lambda x: x and Validation(**{**x, "matrices": [tuple(m) for m in x["matrices"]]})
        return GlmModel(**{**d, "terms": [tuple(t) for t in d["terms"]], "validation": v(d["validation"]), "folds": [v(x) for x in d["folds"]]})


def _text(f: Frame, c: str) -> Column:
    d = f.domains.get(c)
    return F.get(F.array(*(F.lit(s) for s in d)), f.columns[c].cast("int")) if d else f.columns[c].cast("string")


def _is_categorical(f: Frame, c: str) -> bool:
    return bool(f.domains.get(c)) or dict(f.df.dtypes)[c] == "string"


def fit(
    f: Frame, response: str, predictors: Sequence[str] | None = None, family: str = "gaussian", link: str | None = None, lam: float = 1e-5, alpha: float = 0.5,
    weight: str | None = None, case: Case | None = None, standardize: bool = True, thresholds: str | Sequence[float] = "0:1:0.01", solver: str = "ADMM",
    beta_eps: float = 1e-4, max_iter: int = 50, folds: int = 0, metric: str = "SUMC", start: np.ndarray | None = None,
) -> GlmModel:
    """Iteratively reweighted least squares with an elastic net; gaussian with the identity link takes one step.

    See fit_many().
    """
    return fit_many(
        f, response, [(lam, alpha)], predictors, family, link, weight, case, standardize, thresholds, solver, beta_eps, max_iter, folds, metric, start
    )[0]


def fit_many(
    f: Frame, response: str, penalties: Sequence[tuple[float, float]], predictors: Sequence[str] | None = None, family: str = "gaussian", link: str | None = None,
    weight: str | None = None, case: Case | None = None, standardize: bool = True, thresholds: str | Sequence[float] = "0:1:0.01", solver: str = "ADMM",
    beta_eps: float = 1e-4, max_iter: int = 50, folds: int = 0, metric: str = "SUMC", start: np.ndarray | None = None,
) -> list[GlmModel]:
    """A model for each pair of lambda and alpha: each pass over the rows takes a step of all that still move.

    Rows that miss any value are left out. A string column is expanded to a 0/1
    term for each value. case turns the response into 0/1. weight, if given,
    is a column that multiplies each row's part.
    """
    from quillframe.operators.summary import default_columns

    if not penalties:
        return []
    link = link or FAMILIES[family]
    if family not in FAMILIES or link not in LINKS:
        raise ValueError("unknown family or link")
    names = list(predictors) if predictors is not None else default_columns(f, response)
    names = [c for c in names if c != response]
    names.sort(key=lambda c: _is_categorical(f, c))  # numeric ones first
    terms: list[tuple[str, str | None]] = []
    for c in names:
        if _is_categorical(f, c):
            terms += [(c, v) for v in (f.domains.get(c) or fac.domain(f.rows.df, f.columns[c]))]
        else:
            terms.append((c, None))
    y = case.apply(f.columns[response], f, response) if case else ieee.dbl(f.columns[response])
    shell = GlmModel(response, terms, [], family, link, 0, False, case.text if case else None)
    xs = shell.columns(f)
    w = ieee.dbl(f.columns[weight]) if weight else F.lit(1.0)
    base = f.rows.df.select(*(x.alias(f"x{k}") for k, x in enumerate(xs)), y.alias("y"), w.alias("w")).na.drop()
    p = len(xs)
    mean, scale = np.zeros(p), np.ones(p)
    if standardize and p:
        s = base.agg(*(g(f"x{k}").alias(f"{n}{k}") for k in range(p) for n, g in (("m", F.avg), ("s", F.stddev_pop)))).first()
        for k, (_, v) in enumerate(terms):
            if v is None and s[f"s{k}"]:
                mean[k], scale[k] = s[f"m{k}"], s[f"s{k}"]
    z = [(F.col(f"x{k}") - F.lit(float(mean[k]))) / F.lit(float(scale[k])) for k in range(p)]
    _, inverse, slope = LINKS[link]
    solve = SOLVERS[solver]
    one_step = family == "gaussian" and link == "identity"
    betas = [start if start is not None else np.zeros(p + 1)] * len(penalties)
    done, steps = [False] * len(penalties), [0] * len(penalties)

    def working(beta: np.ndarray | None) -> tuple[Column, Column]:
        """What a step regresses on, and its weights; None before the first."""
        if beta is None:
            # the usual start: a mean near y itself
            m = {"binomial": (F.col("y") + 0.5) / 2, "poisson": F.col("y") + 0.1, "gamma": F.greatest(F.col("y"), F.lit(1e-6))}.get(family, F.col("y"))
            eta = LINKS[link][0](m)
        else:
            eta = F.lit(float(beta[-1]))
            for b, c in zip(beta, z, strict=False):
                eta = eta + F.lit(float(b)) * c
            m = inverse(eta)
        d = slope(eta)
        return eta + (F.col("y") - m) / d, F.col("w") * d * d / _variance(family, m)

    if not one_step:
        base = base.persist()
    try:
        for step in range(1, (1 if one_step else max_iter) + 1):
            moving = [k for k in range(len(penalties)) if not done[k]]
            if not moving:
                break
            first = step == 1 and start is None
            if one_step:
                found = [stats.moments(base, z, F.col("y"), F.col("w"))] * len(moving)
            elif step == 1:
                found = stats.many_moments(base, z, [working(None if first else start)]) * len(moving)
            else:
                found = stats.many_moments(base, z, [working(betas[k]) for k in moving])
            for k, (n, xx, xy) in zip(moving, found, strict=True):
                if not n:
                    raise ValueError("no row without missing values")
                xx, xy = xx / n, xy / n
                try:
                    new = solve(xx, xy, *penalties[k])
                except np.linalg.LinAlgError:
                    new = generalized_gradient(xx, xy, *penalties[k])
                moved = float(np.abs(new - betas[k]).max()) if not first else math.inf
                betas[k], steps[k] = new, step
                done[k] = moved <= beta_eps or one_step
    finally:
        if not one_step:
            base.unpersist()
    models = []
    for k, (lam, alpha) in enumerate(penalties):
        raw = betas[k][:-1] / scale
        models.append(replace(shell, beta=[*map(float, raw), float(betas[k][-1] - (raw * mean).sum())], iterations=steps[k], converged=done[k], lam=lam, alpha=alpha))
    for m, v in zip(models, validate_many(models, f, thresholds, case, metric), strict=True):
        m.validation = v
        if folds > 1:
            m.folds = cross_validate(
                m, f, folds, case=case, predictors=names, weight=weight, standardize=standardize, thresholds=thresholds, solver=solver, beta_eps=beta_eps, max_iter=max_iter, metric=metric
            )
    return models


def validate(model: GlmModel, f: Frame, thresholds: str | Sequence[float] = "0:1:0.01", case: Case | None = None, metric: str = "SUMC") -> Validation:
    """Deviances, AIC, error, and for binomial models the confusion matrices, area and best threshold, over a frame."""
    return validate_many([model], f, thresholds, case, metric)[0]


def validate_many(models: Sequence[GlmModel], f: Frame, thresholds: str | Sequence[float] = "0:1:0.01", case: Case | None = None, metric: str = "SUMC") -> list[Validation]:
    """validate() for models of one response and family, with two passes over the rows for all."""
    model = models[0]
    case = case or (Case.parse(model.case) if model.case else None)
    y = case.apply(f.columns[model.response], f, model.response) if case else ieee.dbl(f.columns[model.response])
    rows = f.rows.df.select(ieee.valid(y).alias("y"), *(ieee.valid(m.predict(f)).alias(f"m{k}") for k, m in enumerate(models)))
    means = rows.agg(*(F.avg(F.when(F.col(f"m{k}").isNotNull(), F.col("y"))) for k in range(len(models)))).first()
    if any(x is None for x in means):
        raise ValueError("no row without missing values")
    family = model.family
    ts = np.array(sorted(sequence(thresholds) if isinstance(thresholds, str) else thresholds) if family == "binomial" else [], dtype=float)
    size = 5 + 2 * (len(ts) + 1)

    def part(y: np.ndarray, *predicted: np.ndarray) -> np.ndarray:
        out = []
        for m, mean in zip(predicted, means, strict=True):
            on = ~(np.isnan(y) | np.isnan(m))
            a, b = y[on], m[on]
            ll = a * np.log(np.maximum(b, 1e-12)) - b
            out += [[len(a), _deviance(family, a, b).sum(), _deviance(family, a, float(mean)).sum(), ((a - b) ** 2).sum(), ll.sum()], stats.by_threshold(a, b, ts)]
        return np.concatenate(out)

    out = []
    for k, (m, r) in enumerate(zip(models, stats.totals(rows, part, len(models) * size).reshape(len(models), size), strict=True)):
        n, (dev, null, squares, ll) = int(r[0]), map(float, r[1:5])
        rank = sum(b != 0 for b in m.beta[:-1]) + 1
        if family == "gaussian":
            aic = n * (math.log(2 * math.pi * max(dev, 1e-300) / n) + 1) + 2 * (rank + 1)
        elif family == "binomial":
            aic = dev + 2 * rank
        elif family == "poisson":
            aic = -2 * (ll - _log_factorials(rows.filter(F.col(f"m{k}").isNotNull() & F.col("y").isNotNull()))) + 2 * rank
        else:
            aic = math.nan
        v = Validation(n, n - rank, dev, null, aic, squares / n)
        if family == "binomial":
            v.matrices = stats.matrices(r[5:], ts)
            best = stats.best_threshold(v.matrices, metric)
            v.threshold, v.auc, v.error = v.matrices[best][0], stats.auc(v.matrices), stats.METRICS["TOTAL"](*v.matrices[best][1:])
        out.append(v)
    return out


def _log_factorials(rows) -> float:
    """The sum of ln(y!) by Stirling's series, exact below 10."""
    y = F.col("y")
    small = F.ln(F.factorial(F.least(y, F.lit(10.0)).cast("int")).cast("double"))
    large = y * F.ln(y) - y + F.ln(2 * math.pi * y) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y)
    return rows.agg(F.sum(F.when(y <= 10, small).otherwise(large))).first()[0]


def cross_validate(model: GlmModel, f: Frame, k: int, **options) -> list[Validation]:
    """k models, each fitted without every k-th row and validated on those."""
    f = Frame(Rows(f.rows.numbered, f.rows.order), f.columns, f.domains) if RID not in f.rows.df.columns else f
    case, thresholds, metric = options.pop("case"), options.get("thresholds"), options.get("metric")
    out = []
    for i in range(k):
        part = fit(fold(f, k, i), model.response, family=model.family, link=model.link, lam=model.lam, alpha=model.alpha, case=case, **options)
        out.append(validate(part, fold(f, k, i, complement=True), thresholds, case, metric))
    return out


def pooled(folds: Sequence[Validation]) -> list[tuple[float, int, int, int, int]]:
    """Confusion matrices of folds, summed for each threshold."""
    return [(ms[0][0], *(sum(m[j] for m in ms) for j in range(1, 5))) for ms in zip(*(v.matrices for v in folds), strict=True)]


def grid(f: Frame, response: str, lambdas: str | Sequence[float], alphas: str | Sequence[float], **options) -> list[GlmModel]:
    """Models of all pairs, lambda descending; binomial ones ranked by area, class errors and error, others by error."""
    ls = sorted(sequence(lambdas) if isinstance(lambdas, str) else lambdas, reverse=True)
    als = sequence(alphas) if isinstance(alphas, str) else list(alphas)
    models = fit_many(f, response, [(a, b) for a in ls for b in als], **options)

    def rank(m: GlmModel) -> tuple:
        v = m.validation
        if v.auc is None:
            return (v.error,)
        best = v.matrices[stats.best_threshold(v.matrices)]
        return (-v.auc, sum(stats.class_errors(*best[1:])), v.error)

    return sorted(models, key=rank)
