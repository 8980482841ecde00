"""Panel models. Distributed statistics are Spark aggregates or Spark ML; the driver only sees feature-sized results."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.operators.ranking import number_rows, value_ranks
from areapulse.operators.sizing import local_table
from areapulse.params import FOLDS, FOREST, LASSO_ALPHA, PLS_COMPONENTS
from areapulse.session import cut_lineage


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per feature."""

    mean: Mapping[str, float]
    scale: Mapping[str, float]

    def columns(self, features: Sequence[str]) -> dict[str, Column]:
        return {f: (F.col(f) - F.lit(self.mean[f])) / F.lit(self.scale[f]) for f in features}

    def transform(self, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns(self.columns(list(features or self.mean)))


def fit_scaler(df: DataFrame, features: Sequence[str]) -> Scaler:
    """One aggregate over the training rows. A constant feature has scale 1."""
    stats = [e for f in features for e in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    row = df.agg(*stats).first()
    return Scaler({f: row[f"m_{f}"] for f in features}, {f: row[f"s_{f}"] or 1.0 for f in features})


def standardize(train: DataFrame, apply_to: DataFrame, features: Sequence[str]) -> DataFrame:
    """z-scores with statistics of ``train``."""
    return fit_scaler(train, features).transform(apply_to)


def train_test_protocol(df: DataFrame, period: str, train: Sequence[int], test: Sequence[int]) -> DataFrame:
    """``split`` = train / test / both per period; rows of neither are left out."""
    in_train, in_test = F.col(period).isin(list(train)), F.col(period).isin(list(test))
    split = F.when(in_train & in_test, "both").when(in_train, "train").when(in_test, "test")
    return df.withColumn("split", split).where("split is not null")


def fold_assign(df: DataFrame, key: str, k: int = FOLDS, out: str = "fold") -> DataFrame:
    """k contiguous folds in key order; the first n % k folds have one row more."""
    n = df.count()
    numbered = number_rows(df, key, "_id")
    long, rest = n // k + 1, n % k
    cut = long * rest
    head = F.floor(F.col("_id") / F.lit(long))
    tail = F.lit(rest) + F.floor((F.col("_id") - F.lit(cut)) / F.lit(max(n // k, 1)))
    return numbered.withColumn(out, F.when(F.col("_id") < cut, head).otherwise(tail).cast("int")).drop("_id")


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def lasso_fit(df: DataFrame, features: Sequence[str], target: str, alpha: float = LASSO_ALPHA) -> LinearRegressionModel:
    """LASSO on already standardised features."""
    lasso = LinearRegression(
        labelCol=target, elasticNetParam=1.0, regParam=alpha, standardization=False, tol=1e-10, maxIter=10000
    )
    return lasso.fit(_assembled(df, features).select("features", target))


@dataclass(frozen=True)
class LassoPath:
    """Weights of every penalty: they are linear between the knots, which go from the penalty that keeps nothing to 0."""

    features: tuple[str, ...]
    alphas: np.ndarray
    weights: np.ndarray  # a row per knot
    means: np.ndarray  # of the features and the target

    def at(self, alpha: float) -> LinearModel:
        """The model of one penalty."""
        # Knots fall, interpolation wants them rising.
        w = np.array([np.interp(alpha, self.alphas[::-1], column[::-1]) for column in self.weights.T])
        return LinearModel(self.features, tuple(float(x) for x in w), float(self.means[-1] - w @ self.means[:-1]))


def lasso_homotopy(gram: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alphas, weights) of the knots of the LASSO path, from covariances of the features and with the target.

    Between knots the correlations of the active features with the residual stay equal and fall together; a knot is where
    another feature reaches them (it joins) or a weight reaches 0 (it leaves). A feature that is a combination of active ones
    can add nothing and stays out.
    """
    p = len(cross)
    w, left, active = np.zeros(p), cross.astype(float).copy(), []
    barred: set[int] = {j for j in range(p) if gram[j, j] <= 0}
    alpha = max((abs(left[j]) for j in range(p) if j not in barred), default=0.0)
    alphas, rows, joins, gone = [alpha], [w.copy()], None, None
    tiny = 1e-10 * max(alpha, 1e-300)
    while alpha > tiny:
        ready = [j for j in range(p) if j not in active and j not in barred and j != gone and (j == joins or abs(left[j]) >= alpha - tiny)]
        for j in ready:
            inner = gram[np.ix_(active, active)]
            own = gram[j, j] - (gram[j, active] @ np.linalg.solve(inner, gram[active, j]) if active else 0.0)
            if own <= 1e-10 * gram[j, j]:
                barred.add(j)
            else:
                active.append(j)
        if not active:
            break
        move = np.linalg.solve(gram[np.ix_(active, active)], np.sign(left[active]))
        fall = gram[:, active] @ move
        step, leaves, joins = alpha, None, None
        for j in range(p):
            if j in active or j in barred:
                continue
            for t in ((alpha - left[j]) / (1 - fall[j]) if fall[j] != 1 else np.inf, (alpha + left[j]) / (1 + fall[j]) if fall[j] != -1 else np.inf):
                if tiny < t < step:
                    step, joins = t, j
        for k, j in enumerate(active):
            t = -w[j] / move[k] if move[k] else np.inf
            if tiny < t < step:
                step, leaves, joins = t, j, None
        w[active] += step * move
        left -= step * fall
        alpha -= step
        gone = leaves
        if leaves is not None:
            w[leaves] = 0.0
            active.remove(leaves)
        alphas.append(max(alpha, 0.0))
        rows.append(w.copy())
    if alphas[-1] > 0:
        alphas.append(0.0)
        rows.append(w.copy())
    return np.array(alphas), np.array(rows)


def lasso_paths(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> dict[str, LassoPath]:
    """The path of every target on already standardised features, from one pass that sums the cross products of all."""
    columns = [*features, *targets]
    moments = fold_moments(df, columns[:-1], columns[-1])[0]
    mean, cross = moments.centred()
    p, out = len(features), {}
    for i, target in enumerate(targets):
        knots = lasso_homotopy(cross[:p, :p] / moments.n, cross[:p, p + i] / moments.n)
        out[target] = LassoPath(tuple(features), *knots, np.append(mean[:p], mean[p + i]))
    return out


def lasso_select(df: DataFrame, features: Sequence[str], targets: Sequence[str], alpha: float = LASSO_ALPHA) -> dict[str, list[str]]:
    """Features with a non-zero weight per target, all targets from one pass."""
    models = {t: path.at(alpha) for t, path in lasso_paths(df, features, targets).items()}
    return {t: [f for f, w in zip(features, m.weights) if w != 0.0] for t, m in models.items()}


@dataclass(frozen=True)
class LinearModel:
    """Intercept and weights on scaled features; scores any table as one native expression."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    scaler: Scaler | None = None
    extra: Mapping[str, float] = field(default_factory=dict)

    def score(self) -> Column:
        out = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.weights):
            x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
            if self.scaler is not None:
                x = (x - F.lit(self.scaler.mean[f])) / F.lit(self.scaler.scale[f])
            out = out + x * F.lit(float(w))
        return out


def ols_fit(df: DataFrame, features: Sequence[str], target: str) -> LinearModel:
    """Standardise, then ordinary least squares; null features count as 0. Keeps R2 and RMSE of the fit."""
    filled = df.fillna(0, subset=list(features)).dropna(subset=[target])
    scaler = fit_scaler(filled, features)
    rows = _assembled(scaler.transform(filled, features), features).select("features", F.col(target).cast("double").alias(target))
    model = LinearRegression(labelCol=target, solver="normal").fit(rows)
    fit = {"r2": model.summary.r2, "rmse": model.summary.rootMeanSquaredError}
    return LinearModel(tuple(features), tuple(model.coefficients), model.intercept, scaler, fit)


def model_tables(spark: SparkSession, models: Mapping[str, LinearModel], method: str = "linear_regression") -> DataFrame:
    """Weights, intercepts and scaling of every model, long form."""
    rows = [
        (name, f, float(w), method, float(m.intercept), float(m.scaler.mean[f]), float(m.scaler.scale[f]))
        for name, m in models.items()
        for f, w in zip(m.features, m.weights)
    ]
    schema = (
        "dimension string, feature string, weight double, method string, intercept double, "
        "scaler_mean double, scaler_scale double"
    )
    return local_table(spark, rows, schema)


def weights_pivot(tables: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One row per feature, one weight column per dimension, 0 where a feature is unused."""
    return tables.groupBy("feature").pivot("dimension", list(dimensions)).agg(F.first("weight")).fillna(0.0)


def linear_score(df: DataFrame, key: Sequence[str], tables: DataFrame) -> DataFrame:
    """Scores of stored models as (key, dimension, prediction); null features count as 0, absent ones are skipped.

    The stored table has one row per dimension and feature. It is read once and turned into one expression per
    dimension, so scoring is a projection and never shuffles the data.
    """
    models: dict[str, list] = {}
    for r in tables.orderBy("dimension", "feature").collect():
        models.setdefault(r["dimension"], []).append(r)
    cells = []
    for dimension, rows in models.items():
        rows = [r for r in rows if r["feature"] in df.columns and r["weight"] != 0.0]
        if not rows:
            continue
        scaler = Scaler({r["feature"]: r["scaler_mean"] for r in rows}, {r["feature"]: r["scaler_scale"] for r in rows})
        model = LinearModel(tuple(r["feature"] for r in rows), tuple(r["weight"] for r in rows), rows[0]["intercept"], scaler)
        cells.append(F.struct(F.lit(dimension).alias("dimension"), model.score().alias("prediction")))
    return df.select(*key, F.inline(F.array(*cells)))


@dataclass(frozen=True)
class Moments:
    """Row count, sums and cross products of [features..., target]."""

    n: float
    sums: np.ndarray
    cross: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.sums - other.sums, self.cross - other.cross)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.cross + other.cross)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        mean = self.sums / self.n
        return mean, self.cross - self.n * np.outer(mean, mean)


# Most numbers of all fold matrices together; a task and the driver hold so many.
MOST_MOMENTS = 5_000_000


def fold_moments(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None) -> dict[int, Moments]:
    """Moments per fold in one pass.

    Each task turns its Arrow batches into one small matrix per fold; the matrices are summed by Spark. The driver
    gets folds x (p + 2) squared numbers, and more than ``MOST_MOMENTS`` are refused.
    """
    names = [*features, target]
    columns = [F.col(n).cast("double").alias(n) for n in names]
    part = F.lit(0) if fold is None else F.col(fold)
    rows = df.select(part.cast("int").alias("_fold"), *columns).dropna()

    many = f"the folds have more than {MOST_MOMENTS} moments; use fewer folds or features"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch["_fold"].to_numpy()
            matrix = np.column_stack([np.ones(len(batch)), batch[names].to_numpy()])
            for f in np.unique(folds):
                x = matrix[folds == f]
                sums[f] = sums.get(f, 0.0) + x.T @ x
            if len(sums) * (len(names) + 1) ** 2 > MOST_MOMENTS:
                raise ValueError(many)
        for f, m in sums.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"fold": int(f), "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    sums = rows.mapInPandas(partial, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    size = len(names) + 1
    full: dict[int, np.ndarray] = {}
    collected = sums.limit(MOST_MOMENTS + 1).collect()
    if len(collected) > MOST_MOMENTS:
        raise ValueError(many)
    for r in collected:
        full.setdefault(r["fold"], np.zeros((size, size)))[r["i"], r["j"]] = r["v"]
    return {f: Moments(m[0, 0], m[0, 1:], m[1:, 1:]) for f, m in full.items()}


def pls_from_moments(moments: Moments, features: Sequence[str], components: int, scale: bool = True) -> LinearModel:
    """PLS weights from moments alone (one target): NIPALS written on the p x p cross products."""
    mean, c = moments.centred()
    p = len(features)
    deviation = np.sqrt(np.diag(c) / max(moments.n - 1, 1))
    deviation[deviation == 0] = 1.0
    if not scale:
        deviation = np.ones(p + 1)
    c = c / np.outer(deviation, deviation)
    xx, xy = c[:p, :p].copy(), c[:p, p].copy()
    weights, loadings, inner = [], [], []
    for _ in range(min(components, p)):
        norm = np.linalg.norm(xy)
        if norm < 1e-12:
            break
        w = xy / norm
        tt = w @ xx @ w
        if tt < 1e-12:
            break
        load = xx @ w / tt
        q = xy @ w / tt
        weights.append(w)
        loadings.append(load)
        inner.append(q)
        xx = xx - tt * np.outer(load, load)
        xy = xy - tt * q * load
    if weights:
        w, l = np.column_stack(weights), np.column_stack(loadings)
        coefficients = w @ np.linalg.solve(l.T @ w, np.array(inner))
    else:
        coefficients = np.zeros(p)
    coefficients = coefficients * deviation[p] / deviation[:p]
    intercept = mean[p] - mean[:p] @ coefficients
    return LinearModel(tuple(features), tuple(coefficients), float(intercept))


def pls_regression(df: DataFrame, features: Sequence[str], target: str, components: int = PLS_COMPONENTS, scale: bool = True) -> LinearModel:
    """PLS fitted from one pass over the rows."""
    return pls_from_moments(fold_moments(df, features, target)[0], features, components, scale)


def _mse(model: LinearModel, held: Moments) -> float:
    """Mean squared error on held-out rows, from their moments."""
    b = np.array([*model.weights, -1.0])
    square = b @ held.cross @ b + 2 * model.intercept * (b @ held.sums) + held.n * model.intercept**2
    return float(square / held.n)


def pls_select_components(df: DataFrame, features: Sequence[str], target: str, fold: str, most: int = 10) -> DataFrame:
    """Cross-validated MSE per number of components, with the best one marked.

    Training moments are the total minus the fold, so every k and every fold come from the same single pass. A fold
    column with one row per fold is leave-one-out, for as many rows as ``MOST_MOMENTS`` allows.
    """
    moments = fold_moments(df, features, target, fold)
    parts = list(moments.values())
    total = parts[0]
    for m in parts[1:]:
        total = total + m
    most = int(min(most, total.n - 1, len(features)))
    errors = []
    for k in range(1, most + 1):
        scores = [_mse(pls_from_moments(total - held, features, k, scale=False), held) for held in parts]
        errors.append(float(np.mean(scores)))
    best = int(np.argmin(errors)) + 1
    rows = [(k, e, k == best) for k, e in enumerate(errors, start=1)]
    return local_table(df.sparkSession, rows, "components int, mse double, best boolean")


class ForestModel(RandomForestRegressionModel):
    """Forest without the eager tree wrappers.

    The parent lists its parameters by reading every attribute, which wraps each tree in Python and costs more than a
    small fit. A plain property is not read.
    """

    @property
    def trees(self):
        return [t for t in self._call_java("trees")]


class Forest(RandomForestRegressor):
    """Forest estimator that returns ``ForestModel``."""

    def _create_model(self, java_model) -> ForestModel:
        return ForestModel(java_model)


def random_forest(df: DataFrame, features: Sequence[str], target: str, **settings: int) -> RandomForestRegressionModel:
    """Forest on all features of each split."""
    forest = Forest(
        labelCol=target, featuresCol="features", featureSubsetStrategy="all", **{**FOREST, **settings}
    )
    return forest.fit(_assembled(df, features).select("features", target))


def importances(spark: SparkSession, model: RandomForestRegressionModel, features: Sequence[str]) -> DataFrame:
    """Positive importances, rounded to four places, largest first."""
    pairs = sorted(((f, round(float(v), 4)) for f, v in zip(features, model.featureImportances.toArray()) if v > 0), key=lambda p: (-p[1], p[0]))
    return local_table(spark, [(i, f, v) for i, (f, v) in enumerate(pairs, start=1)], "position int, feature string, importance double")


# Fixed values of the published grid.
GRID = {"numTrees": (90, 100, 110), "maxDepth": (3, 4, 5), "minInstancesPerNode": (1, 2, 3)}


def grid_search(df: DataFrame, features: Sequence[str], target: str, fold: str, grid: Mapping[str, Sequence[int]] | None = None, parallelism: int = 8) -> CrossValidatorModel:
    """Forest settings by cross-validated MSE over the folds of a column.

    A fold per row (leave-one-out) is for panels of some hundred rows; larger ones use k folds.
    """
    forest = Forest(labelCol=target, featuresCol="features", featureSubsetStrategy="all", seed=FOREST["seed"])
    builder = ParamGridBuilder()
    for name, values in (grid or GRID).items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    rows = _assembled(df, features).select("features", target, F.col(fold).cast("int").alias(fold))
    folds = rows.agg(F.max(fold)).first()[0] + 1
    search = CrossValidator(
        estimator=forest,
        estimatorParamMaps=builder.build(),
        evaluator=RegressionEvaluator(labelCol=target, metricName="mse"),
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
    )
    return search.fit(rows)


def grid_table(spark: SparkSession, model: CrossValidatorModel) -> DataFrame:
    """Mean error per grid point; the best one marked."""
    best = int(np.argmin(model.avgMetrics))
    rows = []
    for i, (point, error) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics)):
        named = {p.name: int(v) for p, v in point.items()}
        rows.append((named.get("numTrees"), named.get("maxDepth"), named.get("minInstancesPerNode"), float(error), i == best))
    return local_table(spark, rows, "num_trees int, max_depth int, min_leaf int, mse double, best boolean")


@dataclass(frozen=True)
class Stack:
    """Forest and PLS on all rows, combined by a linear model that was fitted on out-of-fold predictions."""

    features: tuple[str, ...]
    forest: RandomForestRegressionModel | None
    pls: LinearModel
    meta: tuple[float, float, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``rf``, ``pls`` and ``stacked``."""
        scored = df
        if self.forest is not None:
            scored = self.forest.transform(_assembled(df, self.features)).withColumnRenamed("prediction", "rf").drop("features")
        else:
            scored = scored.withColumn("rf", F.lit(self.pls.intercept))
        a, b, c = self.meta
        scored = scored.withColumn("pls", self.pls.score())
        return scored.withColumn("stacked", F.lit(a) + F.col("rf") * F.lit(b) + F.col("pls") * F.lit(c))


def stack_regressors(df: DataFrame, features: Sequence[str], target: str, fold: str, components: int = PLS_COMPONENTS, **forest: int) -> Stack:
    """Out-of-fold predictions of both learners -> least squares -> both refitted on all rows.

    The PLS of every fold comes from one pass of fold moments. Without features the mean is predicted.
    """
    features = list(features)
    moments = fold_moments(df, features, target, fold)
    parts = list(moments.items())
    total = parts[0][1]
    for _, m in parts[1:]:
        total = total + m
    if not features:
        mean = LinearModel((), (), float(total.sums[-1] / total.n))
        return Stack((), None, mean, (0.0, 0.0, 1.0))

    def held_out(f: object, held: Moments) -> DataFrame:
        train, rest = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        rf = random_forest(train, features, target, **forest)
        pls = pls_from_moments(total - held, features, components)
        return rf.transform(_assembled(rest, features)).select(
            F.col("prediction").alias("rf"), pls.score().alias("pls"), F.col(target).cast("double").alias("y")
        )

    # The folds are jobs of their own; a forest alone leaves most of a cluster idle between its levels.
    with ThreadPoolExecutor(len(parts)) as pool:
        out_of_fold = reduce(DataFrame.unionByName, pool.map(lambda p: held_out(*p), parts))
    # Three columns: their moments give the least-squares weights in one pass.
    m = fold_moments(out_of_fold, ["rf", "pls"], "y")[0]
    mean, c = m.centred()
    weights = np.linalg.lstsq(c[:2, :2], c[:2, 2], rcond=None)[0]
    meta = (float(mean[2] - mean[:2] @ weights), float(weights[0]), float(weights[1]))
    return Stack(tuple(features), random_forest(df, features, target, **forest), pls_from_moments(total, features, components), meta)


def regression_metrics(df: DataFrame, group: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """R2, MAE, RMSE, mean % error and Pearson per group in one aggregate.

    R2 comes from the group's variance, so the mean of the actual values needs no second pass.
    """
    y, p = F.col(actual), F.col(predicted)
    rows = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.when(y != 0, F.abs((y - p) / y) * 100.0)).alias("mean_pct_error"),
        F.corr(actual, predicted).alias("pearson"),
    )
    return rows.select(
        *group,
        "n",
        (1.0 - F.col("_sse") / F.col("_sst")).alias("r2"),
        "mae",
        F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
        "mean_pct_error",
        "pearson",
    )


def spearman(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Spearman correlation with average ranks on ties, per group.

    Rows without one of the values are left out. Equal pairs are counted first; the ranks of the distinct values and the
    correlation then work on the counts, so a value that occurs very often is one row.
    """
    group = list(group)
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*group, a, b).agg(F.count(F.lit(1)).alias("_n"))
    pairs = cut_lineage(pairs, "value-pairs")
    rows = pairs
    for name in (a, b):
        each = pairs.select(*group, name, "_n")
        ranks = value_ranks(each, name, group, weight="_n")
        same = F.col(name) == F.col("_value")
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_k{i}"))
        ranks = ranks.select(
            *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)],
            F.col(name).alias("_value"),
            (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"_rank_{name}"),
        )
        rows = rows.join(ranks, same).drop("_value", *[f"_k{i}" for i in range(len(group))])
    n, x, y = F.col("_n"), F.col(f"_rank_{a}"), F.col(f"_rank_{b}")
    sums = rows.groupBy(*group).agg(
        *[F.sum(v).alias(k) for k, v in {"_w": n, "_x": n * x, "_y": n * y, "_xx": n * x * x, "_yy": n * y * y, "_xy": n * x * y}.items()]
    )
    cov, vx, vy = (F.col(f"_{p}{q}") * F.col("_w") - F.col(f"_{p}") * F.col(f"_{q}") for p, q in ("xy", "xx", "yy"))
    return sums.select(*group, F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy)).alias("spearman"))


def compare_models(metrics: DataFrame, target: str, model: str, base: Sequence[str], stacked: str) -> DataFrame:
    """Gain of the stack over the better single model, per target. Expects columns r2 and mae."""
    best = F.col(model).isin(list(base))
    return metrics.groupBy(target).agg(
        F.max(F.when(F.col(model) == stacked, F.col("r2"))).alias("r2"),
        F.max(F.when(F.col(model) == stacked, F.col("mae"))).alias("mae"),
        (F.max(F.when(F.col(model) == stacked, F.col("r2"))) - F.max(F.when(best, F.col("r2")))).alias("r2_gain"),
        (F.min(F.when(best, F.col("mae"))) - F.max(F.when(F.col(model) == stacked, F.col("mae")))).alias("mae_gain"),
    )


def _first_component(df: DataFrame, features: Sequence[str]) -> tuple[LinearModel, float]:
    """Loadings of PC1 of standardised features as a linear model, and its share of the variance."""
    rows = df.dropna(subset=list(features))
    scaler = fit_scaler(rows, features)
    model = PCA(k=1, inputCol="features", outputCol="pc").fit(_assembled(scaler.transform(rows, features), features))
    loadings = tuple(float(v) for v in model.pc.toArray()[:, 0])
    return LinearModel(tuple(features), loadings, 0.0, scaler), float(model.explainedVariance[0])


@dataclass(frozen=True)
class LatentIndex:
    """PC1 with the sign rule, and its range over the fitted rows."""

    component: LinearModel
    explained: float
    low: float
    high: float

    def score(self) -> Column:
        span = (self.high - self.low) or 1.0
        return (self.component.score() - F.lit(self.low)) / F.lit(span) * 100.0


def fit_latent_index(df: DataFrame, features: Sequence[str]) -> LatentIndex:
    """Standardise -> PC1 -> flip when the loadings sum is negative -> range for 0..100."""
    component, explained = _first_component(df, features)
    if sum(component.weights) < 0:
        component = LinearModel(component.features, tuple(-w for w in component.weights), 0.0, component.scaler)
    row = df.dropna(subset=list(features)).agg(F.min(component.score()).alias("lo"), F.max(component.score()).alias("hi")).first()
    return LatentIndex(component, explained, row["lo"], row["hi"])


def latent_index(df: DataFrame, features: Sequence[str], out: str = "latent_index") -> DataFrame:
    """0..100 index of the rows without a null feature."""
    return df.dropna(subset=list(features)).withColumn(out, fit_latent_index(df, features).score())


def shifted_component(df: DataFrame, features: Sequence[str], shift: float = 5.0) -> LinearModel:
    """PC1 loadings as weights, with |min| + shift as the intercept, so that every fitted score is positive.

    The component's sign is fixed by a non-negative loadings sum.
    """
    filled = df.fillna(0, subset=list(features))
    component, explained = _first_component(filled, features)
    sign = -1.0 if sum(component.weights) < 0 else 1.0
    weights = tuple(sign * w for w in component.weights)
    base = LinearModel(component.features, weights, 0.0, component.scaler)
    low = filled.agg(F.min(base.score()).alias("lo")).first()["lo"]
    return LinearModel(base.features, weights, abs(low) + shift, base.scaler, {"explained": explained})
