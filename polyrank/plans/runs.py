"""Whole runs: assemble, validate, train, predict, evaluate."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bootstrap, contracts, selectors, sets, stats
from ..roles import ACCEPTABLE, DEFAULT, Roles
from ..sources.readers import stored
from . import models


@dataclass(frozen=True)
class Config:
    """What a run is: every field has its range, and an unknown one is refused."""

    features: tuple[str, ...]
    loss: str = "ridge_logistic"
    preprocessing: str = "zscore"
    penalty: float = 1.0
    replicates: int = 2000
    max_missing: float = 0.2
    name: str = "model"
    threshold: float = ACCEPTABLE
    reference: str = DEFAULT.score
    folds: tuple[int, ...] | None = None
    group_size: int | None = None

    def __post_init__(self) -> None:
        checks = {
            "features must be there, be names, and differ": self.features and all(isinstance(f, str) and f for f in self.features) and len(set(self.features)) == len(self.features),
            "unknown loss": self.loss in models.LOSSES,
            "unknown preprocessing": self.preprocessing in ("zscore", "within_rank"),
            "penalty must be finite and not below 0": math.isfinite(self.penalty) and self.penalty >= 0,
            "replicates and group_size must be above 0": min(self.replicates, 1 if self.group_size is None else self.group_size) >= 1,
            "max_missing must be from 0 to 1": 0 <= self.max_missing <= 1,
            "threshold must be from 0 to 1": 0 <= self.threshold <= 1,
            "name and reference must be there": bool(self.name and self.reference),
            "folds must differ and be two at least": self.folds is None or len(set(self.folds)) == len(self.folds) >= 2,
        }
        broken = [text for text, ok in checks.items() if not ok]
        if broken:
            raise ValueError("; ".join(broken))

    @classmethod
    def from_dict(cls, d: dict) -> Config:
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(d) - known)
        if unknown or "features" not in d:
            raise ValueError(f"unknown fields: {unknown}" if unknown else "features are missing")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


def validate(df: DataFrame, config: Config, roles: Roles = DEFAULT) -> DataFrame:
    """df, once its contracts hold: columns, unique keys, missing values, both classes in every fold."""
    contracts.require_columns(df, [roles.group, roles.key, roles.score, roles.truth, roles.fold, *config.features])
    contracts.require(contracts.duplicate_keys(df, [roles.group, roles.key]))
    if config.group_size is not None:
        contracts.require(contracts.group_size(df, roles.group, config.group_size))
    if config.folds is not None:
        contracts.require(contracts.fold_integrity(df, roles.group, roles.fold, list(config.folds)))
    bad = contracts.missingness(df, [*config.features], config.max_missing).where("not ok").collect()
    if bad:
        raise contracts.ContractError("too many missing values: " + ", ".join(r["feature"] for r in bad))
    labelled = df.withColumn("_y", F.col(roles.truth) >= roles.threshold)
    if contracts.two_classes(labelled, "_y", [roles.fold]).where("not ok").limit(1).count():
        raise contracts.ContractError("a fold has one class only")
    return df


def evaluate(scored: DataFrame, roles: Roles = DEFAULT, replicates: int = 200, name: str = "probability") -> DataFrame:
    """One row: candidate metrics of the model, selector metrics of model and reference, and the paired intervals."""
    scored = stored(scored.select(*dict.fromkeys([roles.group, *roles.ties, roles.score, roles.truth, name])), "scored")
    cand = stats.candidate_metrics(scored, name, roles.truth, roles.threshold)
    a = selectors.top1(scored, name, roles.group, list(roles.ties))
    b = selectors.top1(scored, roles.score, roles.group, list(roles.ties))
    m = stats.selector_metrics(a, roles.truth).select(F.col("rate_acceptable").alias("model_rate"), F.col("mean_truth").alias("model_mean"))
    r = stats.selector_metrics(b, roles.truth).select(F.col("rate_acceptable").alias("reference_rate"), F.col("mean_truth").alias("reference_mean"))
    pairs = stored(selectors.paired(a, b, roles.truth, roles.group), "paired")
    d = bootstrap.paired_difference(pairs, "a_truth", "b_truth", roles.group, roles.threshold, replicates)
    return cand.crossJoin(m).crossJoin(r).crossJoin(d)


def train(df: DataFrame, config: Config, roles: Roles = DEFAULT) -> tuple[models.Model, DataFrame]:
    """The model of all rows, and every row with its out-of-fold score."""
    d = validate(df, config, roles).withColumn("_y", F.col(roles.truth) >= roles.threshold)
    args = (list(config.features), "_y")
    oof = models.out_of_fold(d, *args, roles.fold, config.loss, config.preprocessing, config.penalty, roles.group)
    return models.fit(d, *args, config.loss, config.preprocessing, config.penalty, roles.group), oof.drop("_y")


def predict(df: DataFrame, model: models.Model, roles: Roles = DEFAULT) -> DataFrame:
    """Scores and selection flags; a truth column is dropped before anything is read."""
    blind = df.drop(roles.truth)
    return selectors.flags(model.score(blind, roles.group), "probability", roles.group, roles.rank, list(roles.ties))


def evaluate_holdout(df: DataFrame, train_levels: DataFrame, holdout_levels: DataFrame, strict: list[str], model: models.Model, roles: Roles = DEFAULT, replicates: int = 200) -> DataFrame:
    """Evaluation of a model on a cohort of its own; raises if the cohorts overlap at a strict level."""
    gate = sets.overlap_gate(sets.overlap_counts(train_levels, holdout_levels, strict), strict).first()
    if not gate["passed"]:
        raise contracts.ContractError(f"cohorts overlap: {gate['strict_overlaps']}")
    return evaluate(model.score(df, roles.group), roles, replicates)


def ablation(df: DataFrame, feature_sets: dict[str, list[str]], roles: Roles = DEFAULT, penalty: float = 1.0) -> DataFrame:
    """(features, auc, ap, brier, rate, mean) of out-of-fold models on different features."""
    d = df.withColumn("_y", F.col(roles.truth) >= roles.threshold)
    out = None
    for name, features in feature_sets.items():
        oof = models.out_of_fold(d, features, "_y", roles.fold, penalty=penalty, group=roles.group)
        c = stats.candidate_metrics(oof, "probability", roles.truth, roles.threshold).select("auc", "ap", "brier")
        s = stats.selector_metrics(selectors.top1(oof, "probability", roles.group, list(roles.ties)), roles.truth).select("rate_acceptable", "mean_truth")
        row = c.crossJoin(s).withColumn("features", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def reproduce(df: DataFrame, holdout: DataFrame, levels: Callable[[DataFrame], DataFrame], strict: list[str], config: Config, roles: Roles = DEFAULT) -> DataFrame:
    """A whole run: train on one cohort, then predict and evaluate another, once the overlap gate has let it pass.

    (stage, metric, value) rows: out-of-fold and holdout metrics of the model and of the reference, and the model's weights.
    """
    roles = replace(roles, threshold=config.threshold, score=config.reference)
    model, oof = train(df, config, roles)
    stages = {"out_of_fold": evaluate(oof, roles, config.replicates), "holdout": evaluate_holdout(holdout, levels(df), levels(holdout), strict, model, roles, config.replicates)}
    out = df.sparkSession.createDataFrame([("model", n, float(w)) for n, w in [("intercept", model.intercept), *zip(config.features, model.weights, strict=True)]], "stage string, metric string, value double")
    for stage, one in stages.items():
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])
        out = out.unionByName(one.select(F.explode(cells).alias("x")).select(F.lit(stage).alias("stage"), "x.metric", "x.value"))
    return out
