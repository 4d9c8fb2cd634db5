"""Page images as features, the field-notes heuristic and classifier, and repair of duplicate plan types."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import FIELD_NOTES, Config
from .review import PLAN_TYPES

#: Fixed value: order of the 24 features.
FEATURES = ["pages", "aspect", "dark", "very_dark", "edges", "lower_right", "top_half", "left_half", *(f"zone_{i}" for i in range(16))]


def resize(gray: np.ndarray, height: int = 256, width: int = 192) -> np.ndarray:
    """M-3: nearest sample."""
    rows, columns = np.linspace(0, gray.shape[0] - 1, height).astype(int), np.linspace(0, gray.shape[1] - 1, width).astype(int)
    return gray[rows][:, columns]


def features(gray: np.ndarray | None, pages: int) -> list[float]:
    """M-4: 24 numbers of a grey first page; zeros but for the page count where there is none. ``aspect`` is that of the resized sample."""
    if gray is None or gray.size == 0:
        return [float(pages)] + [0.0] * 23
    g = resize(np.asarray(gray)).astype(np.int16)
    h, w = g.shape
    dark = g < 185
    dx, dy = np.abs(np.diff(g, axis=1)) > 30, np.abs(np.diff(g, axis=0)) > 30
    values = [float(pages), w / h, dark.mean(), (g < 90).mean(), (dx.mean() + dy.mean()) / 2, dark[int(h * 0.62) :, int(w * 0.55) :].mean(), dark[: h // 2].mean(), dark[:, : w // 2].mean()]
    zones = [dark[h * i // 4 : h * (i + 1) // 4, w * j // 4 : w * (j + 1) // 4].mean() for i in range(4) for j in range(4)]
    return [float(v) for v in values + zones]


def with_features(files: DataFrame, render: Callable[[bytes], tuple[np.ndarray | None, int]], content: str = "content", out: str = "features") -> DataFrame:
    """M-1, M-2, M-4: ``render`` is an adapter from file bytes to (grey first page or None, page count); unreadable files give zeros."""
    schema = T.StructType([f for f in files.schema if f.name not in (content, out)] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for raw in pdf[content]:
                try:
                    gray, pages = render(bytes(raw)) if raw is not None else (None, 0)
                except Exception:  # noqa: BLE001 - an unreadable file is a row of zeros, not a failed job
                    gray, pages = None, 0
                rows.append(features(gray, pages))
            yield pdf.drop(columns=[content]).assign(**{out: rows})[[f.name for f in schema]]

    return files.mapInPandas(run, schema)


def heuristic(f: Column) -> Column:
    """M-5: likelihood of field notes from pages, shape, title block, edges and ink, within [0, .98]."""
    points = [(f[0] >= 2, 0.55), (f[0] >= 4, 0.15), (f[1] < 0.85, 0.10), (f[5] < 0.08, 0.08), ((f[4] >= 0.015) & (f[4] <= 0.13), 0.07), ((f[2] >= 0.005) & (f[2] <= 0.20), 0.05)]
    total = F.lit(0.0)
    for when, weight in points:
        total = total + F.when(when, F.lit(weight)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.98), total))


def classify(rows: DataFrame, accept: float = 0.70, model=None) -> DataFrame:  # type: ignore[no-untyped-def]
    """M-6: ``visual_label`` and ``confidence`` (of the label), from a trained model where one is given, else from the heuristic."""
    if model is None:
        p = heuristic(F.col("features"))
        return rows.withColumns({"visual_label": F.when(p >= accept, "field_notes").otherwise("not_field_notes"), "confidence": F.when(p >= accept, p).otherwise(1 - p)})
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    scored = model.transform(rows.withColumn("vector", array_to_vector("features")))
    label = F.element_at(names, F.col("prediction").cast("int") + 1)
    kept = scored.withColumns({"visual_label": label, "confidence": F.array_max(vector_to_array("probability"))})
    return kept.select(*rows.drop("visual_label", "confidence").columns, "visual_label", "confidence")


def threshold(config: Config) -> float:
    """M-9."""
    value = config.get("visual_field_notes_threshold")
    return 0.70 if value is None else float(value)


def repair_duplicates(docs: DataFrame, least: float, packet: str = "packet_id", order: tuple[str, ...] = ("ordinal", "doc_id")) -> DataFrame:
    """M-10: of plans of one type in a packet those that look like field notes become such, the surest first (ties: the later one), while
    more than one of the type is left. Closed form: all of them do, but where all of a type would, the least sure one stays. Counted by
    an aggregate joined back, so no window holds a whole packet; ``order`` must tell the rows of a packet apart."""
    can = F.col("document_type").isin(*PLAN_TYPES) & (F.col("visual_label") == "field_notes") & (F.col("confidence") >= least)
    rows = docs.withColumns({"_can": F.coalesce(can, F.lit(False)), "_key": F.struct("confidence", *order)})
    live = rows.where(F.col("document_type").isin(*PLAN_TYPES) & F.col(packet).isNotNull())
    counts = live.groupBy(packet, "document_type").agg(F.count("*").alias("_n"), F.count(F.when(F.col("_can"), 1)).alias("_c"), F.min(F.when(F.col("_can"), F.col("_key"))).alias("_least"))
    stays = (F.col("_c") == F.col("_n")) & (F.col("_key") == F.col("_least"))
    changed = F.col("_can") & F.col("_n").isNotNull() & ~F.coalesce(stays, F.lit(False))
    joined = rows.join(counts, [packet, "document_type"], "left")
    return joined.withColumns({"repaired": changed, "document_type": F.when(changed, F.lit(FIELD_NOTES)).otherwise(F.col("document_type"))}).drop("_can", "_key", "_n", "_c", "_least")


def repair(docs: DataFrame, config: Config, order: tuple[str, ...] = ("ordinal", "scan_id"), model=None) -> DataFrame:  # type: ignore[no-untyped-def]
    """M-10 as a step of batch mode: rows with ``visual_label`` and ``confidence`` (of a model), or else with ``features``, get their type
    repaired; without either, or where the settings turn the classifier off, they stay as they are."""
    if not config.get("visual_field_notes_classifier", True):
        return docs
    if {"visual_label", "confidence"} <= set(docs.columns):
        return repair_duplicates(docs, threshold(config), order=order).drop("repaired")
    if "features" not in docs.columns:
        return docs
    return repair_duplicates(classify(docs, model=model), threshold(config), order=order).drop("repaired", "visual_label", "confidence")


def train(rows: DataFrame, trees: int = 400, seed: int = 42, label: str = "label", path: str | None = None):  # type: ignore[no-untyped-def]
    """M-7: random forest with balanced weights; needs two classes and six rows; ten rows and two per class are split 75/25 by hash.

    Returns the fitted pipeline and a report on the held-out part (on all rows where there are too few): rows, classes, accuracy, and
    per class precision, recall and support. ``held_out`` tells which rows took no part in the fit. With ``path`` the model is saved
    there and the cache of models is cleared."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    known = rows.where(F.col(label).isNotNull())
    counts = {r[label]: (r["n"], r["held"]) for r in known.groupBy(label).agg(F.count("*").alias("n"), F.count(F.when(held_out(seed), 1)).alias("held")).limit(1001).collect()}
    total = sum(n for n, _ in counts.values())
    if len(counts) < 2 or total < 6:
        raise ValueError("training needs two classes and six rows")
    weight = F.create_map(*(F.lit(x) for k, (n, _) in counts.items() for x in (k, total / (len(counts) * n))))
    data = known.withColumns({"vector": array_to_vector("features"), "weight": weight[F.col(label)]})
    split = total >= 10 and all(n >= 2 and 0 < held < n for n, held in counts.values())
    fit, held = (data.where(~held_out(seed)), data.where(held_out(seed))) if split else (data, data)
    model = Pipeline(stages=[StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc"), RandomForestClassifier(featuresCol="vector", labelCol="target", weightCol="weight", numTrees=trees, seed=seed)]).fit(fit)
    cells = [(r["target"], r["prediction"], r["count"]) for r in model.transform(held).groupBy("target", "prediction").count().collect()]
    names = model.stages[0].labels
    report = {"rows": total, "classes": sorted(counts), "held_out": split, "accuracy": sum(n for a, b, n in cells if a == b) / max(1, sum(n for *_, n in cells)), "per_class": {}}
    for i, name in enumerate(names):
        hit, said, own = (sum(n for a, b, n in cells if f(a, b)) for f in (lambda a, b: a == b == i, lambda a, b: b == i, lambda a, b: a == i))
        report["per_class"][name] = {"precision": hit / said if said else 0.0, "recall": hit / own if own else 0.0, "support": own}
    if path:
        model.write().overwrite().save(path)
        clear_model_cache()
    return model, report


def held_out(seed: int = 42) -> Column:
    """Whether a row is kept for the report: a quarter of all rows, by the hash of its features."""
    return F.pmod(F.xxhash64(F.col("features").cast("string"), F.lit(seed)), F.lit(4)) == 0


def labelled_folders(spark: SparkSession, root: str, render: Callable[[bytes], tuple[np.ndarray | None, int]]) -> DataFrame:
    """M-7, input: ``label`` and ``features`` of the files in ``root/field_notes`` and ``root/not_field_notes``; a missing folder raises."""
    files = None
    for label in ("field_notes", "not_field_notes"):
        part = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(f"{root}/{label}").select(F.lit(label).alias("label"), "path", "content")
        files = part if files is None else files.unionByName(part)
    return with_features(files, render)


@lru_cache(maxsize=4)
def _cached(path: str, modified: int):  # type: ignore[no-untyped-def]
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def cached_model(path: str):  # type: ignore[no-untyped-def]
    """M-8: model by path and time of change, four at most."""
    changed = max(os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names) if os.path.isdir(path) else os.stat(path).st_mtime_ns
    return _cached(path, changed)


def clear_model_cache() -> None:
    _cached.cache_clear()
