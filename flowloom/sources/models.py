"""Saving and loading fitted models with their labels and feature order."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession

from ..operators.training import FlowModel, Scaler


@dataclass
class ModelBundle:
    """What scoring needs: a stage-1 or single model, maybe an attack model."""

    binary: FlowModel
    attack: FlowModel | None = None
    feature_columns: list[str] | None = None

    @property
    def kind(self) -> str:
        return "single_stage" if self.attack is None else "two_stage"


def _write_text(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_model(spark: SparkSession, model: FlowModel, path: str) -> None:
    for i, member in enumerate(model.members):
        member.write().overwrite().save(f"{path}/member-{i}")
    for i, cal in enumerate(model.calibrators):
        cal.write().overwrite().save(f"{path}/calibrator-{i}")
    _write_text(spark, f"{path}/about", {
        "classes": model.classes, "features": model.features, "selected": model.selected,
        "mean": model.scaler.mean, "std": model.scaler.std,
        "members": len(model.members), "calibrators": len(model.calibrators)})


def load_model(spark: SparkSession, path: str) -> FlowModel:
    about = _read_text(spark, f"{path}/about")
    return FlowModel(
        about["classes"], about["features"], about["selected"], Scaler(about["mean"], about["std"]),
        [GBTClassificationModel.load(f"{path}/member-{i}") for i in range(about["members"])],
        [IsotonicRegressionModel.load(f"{path}/calibrator-{i}") for i in range(about["calibrators"])])


def save_models(spark: SparkSession, bundle: ModelBundle, path: str) -> None:
    save_model(spark, bundle.binary, f"{path}/binary")
    if bundle.attack is not None:
        save_model(spark, bundle.attack, f"{path}/attack")
    _write_text(spark, f"{path}/about", {"kind": bundle.kind, "feature_columns": bundle.feature_columns
                                         or bundle.binary.features, "class_names": bundle.binary.classes})


def load_models(spark: SparkSession, path: str) -> ModelBundle:
    """The bundle saved there: two stages if it holds an attack model."""
    about = _read_text(spark, f"{path}/about")
    attack = load_model(spark, f"{path}/attack") if about["kind"] == "two_stage" else None
    return ModelBundle(load_model(spark, f"{path}/binary"), attack, about["feature_columns"])
