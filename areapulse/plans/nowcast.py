"""Panel to nowcast: scale -> select -> stack -> metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapulse.operators import modelling
from areapulse.operators.sizing import local_table
from areapulse.params import FOLDS, LASSO_ALPHA
from areapulse.session import cut_lineage

MODELS = ("rf", "pls", "stacked")


def nowcast(
    panel: DataFrame,
    area: str,
    period: str,
    row: str,
    features: Sequence[str],
    targets: Sequence[str],
    train: Sequence[int],
    test: Sequence[int],
    alpha: float = LASSO_ALPHA,
    folds: int = FOLDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics, selected features) of every target.

    Scaling, selection and models see the training periods only; ``train`` and ``test`` overlap for an in-sample run.
    ``row`` is a unique number in panel order: the folds are contiguous in it.
    """
    panel = cut_lineage(panel, "panel")
    learn = panel.where(F.col(period).isin(list(train)))
    scaler = modelling.fit_scaler(learn, features)
    learn = cut_lineage(modelling.fold_assign(scaler.transform(learn, features), row, folds), "training-panel")
    held = scaler.transform(panel.where(F.col(period).isin(list(test))), features)
    chosen = modelling.lasso_select(learn, features, targets, alpha)
    predictions = None
    for target in targets:
        stack = modelling.stack_regressors(learn, chosen[target], target, "fold")
        scored = stack.transform(held).select(
            area, period, F.lit(target).alias("target"), F.col(target).cast("double").alias("actual"), *MODELS
        )
        predictions = scored if predictions is None else predictions.unionByName(scored)
    predictions = cut_lineage(predictions, "predictions")
    long = predictions.unpivot([area, period, "target", "actual"], list(MODELS), "model", "predicted")
    metrics = modelling.regression_metrics(long, ["target", "model"], "actual", "predicted")
    rows = [(t, len(fs), ", ".join(fs)) for t, fs in chosen.items()]
    selected = local_table(panel.sparkSession, rows, "target string, n_selected_features int, selected_features string")
    return predictions, metrics, selected
