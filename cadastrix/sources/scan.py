"""Sources: folders of files, rendered pages, tokens and the register as a data source with predicate pushdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.window import Window

PAGE = "page_index int, image_width int, image_height int, page_width double, page_height double, dpi double, items array<struct<text:string,score:double,polygon:array<array<double>>,bbox:array<double>>>"


class OcrEngine(Protocol):
    """Adapter of a renderer and recogniser: file bytes to pages (dicts of the PAGE columns). Built lazily, once per worker."""

    def __call__(self, content: bytes, dpi: int) -> list[dict[str, Any]]: ...


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """S-1, O-1: the PDF files of one or more folders (not below them), any case of the suffix: packet_id (folder), ordinal, doc_id, path, name, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return with_order(files)


def with_order(files: DataFrame) -> DataFrame:
    packet = F.regexp_replace("path", "/[^/]*$", "")
    rows = files.select(F.sha2("path", 256).alias("doc_id"), packet.alias("packet_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source_name"), "modificationTime", "length", "content")
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("packet_id").orderBy("source_path")) - 1)


def stream_folder(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """G-1: the same files as a stream, ``per_batch`` new files a micro-batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source_path"), F.element_at(F.split("path", "/"), -1).alias("source_name"), "content")


def token(item: Any) -> dict[str, Any] | None:
    """S-5, S-7 for one entry of a list page: ``[polygon, (text, score)]``; malformed and blank entries are skipped."""
    try:
        polygon, (text, score) = item
        points = [[float(p[0]), float(p[1])] for p in polygon if len(p) >= 2]
        text = str(text).strip()
    except (TypeError, ValueError, IndexError):
        return None
    if not text or not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {"text": text, "score": float(score), "polygon": points, "bbox": [min(xs), min(ys), max(xs), max(ys)]}


def tokens(result: Any) -> list[dict[str, Any]]:
    """S-5: tokens of a page in either shape: a dict of parallel lists (boxes by priority, blank texts kept) or a list of entries."""
    if isinstance(result, dict):
        boxes = next((result[k] for k in ("rec_polys", "rec_boxes", "dt_polys", "boxes") if result.get(k) is not None and len(result[k])), [])
        out = []
        for i, text in enumerate(result.get("rec_texts") or []):
            box = boxes[i] if i < len(boxes) else []
            flat = len(box) == 4 and not hasattr(box[0], "__len__")
            points = [[float(box[a]), float(box[b])] for a, b in ((0, 1), (2, 1), (2, 3), (0, 3))] if flat else [[float(p[0]), float(p[1])] for p in box if len(p) >= 2]
            xs, ys = [p[0] for p in points] or [0.0, 0.0], [p[1] for p in points] or [0.0, 0.0]
            scores = result.get("rec_scores") or []
            out.append({"text": str(text), "score": float(scores[i]) if i < len(scores) else 0.0, "polygon": points, "bbox": [min(xs), min(ys), max(xs), max(ys)]})
        return out
    return [t for t in map(token, result or []) if t is not None]


_engines: dict[str, OcrEngine] = {}


def cached_engine(name: str, build: Callable[[], OcrEngine]) -> OcrEngine:
    """S-10, S-11: one engine a worker and setting (device, language, model), kept between tasks."""
    if name not in _engines:
        _engines.clear()
        _engines[name] = build()
    return _engines[name]


def workers(wanted: int, device: str) -> int:
    """S-9: at least one; a GPU serves one worker only."""
    return 1 if device.startswith("gpu") else max(1, wanted)


def recognise(files: DataFrame, engine: Callable[[], OcrEngine], dpi: int = 300, partitions: int | None = None) -> DataFrame:
    """S-2, S-4, S-9: content to ``ocr_pages`` and ``ocr_text`` (non-empty tokens, one per line). ``engine`` builds the adapter, once per
    worker (S-10); unreadable files give no pages. Order is that of ``ordinal``, never of arrival."""
    from ..operators.layout import document_text

    keep = [f for f in files.schema if f.name != "content"]
    schema = T.StructType([*keep, T.StructField("ocr_pages", T._parse_datatype_string(f"array<struct<{PAGE.replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>"))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for pdf in batches:
            read = read or engine()
            found = []
            for raw in pdf["content"]:
                try:
                    found.append(read(bytes(raw), dpi))
                except Exception:  # noqa: BLE001 - an unreadable file has no pages
                    found.append([])
            yield pdf.drop(columns=["content"]).assign(ocr_pages=found)

    spread = files.repartition(partitions) if partitions else files
    pages = spread.mapInPandas(run, schema)
    return pages.withColumn("ocr_text", document_text(F.col("ocr_pages")))


# ---------------------------------------------------------------- the register over the network


class RegisterSource(DataSource):
    """S-15..S-17: property register as a data source. ``fetch`` (option, ``module:function``) gets the columns, the equality predicates and
    the row limit and returns rows; equality filters are pushed to it. Without any predicate nothing is fetched, as in the service."""

    @classmethod
    def name(cls) -> str:
        return "property_register"

    def schema(self) -> T.StructType:
        from ..operators.register import FIELDS, HIDDEN

        return T.StructType([T.StructField(c, T.StringType()) for c in [*FIELDS.values(), *HIDDEN]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RegisterReader(schema, dict(self.options))


class RegisterReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.options, self.predicates = schema.names, options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            # of two different values asked of one column only the first goes to the service, Spark checks the other
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and self.predicates.get(f.attribute[0], f.value) == f.value:
                self.predicates[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.predicates:
            return
        import importlib

        module, _, function = self.options["fetch"].partition(":")
        rows = getattr(importlib.import_module(module), function)(self.columns, self.predicates, int(self.options.get("limit", "200")))
        for row in rows:
            yield tuple(None if row.get(c) is None else str(row.get(c)) for c in self.columns)


def register_columns(frame: DataFrame) -> list[Column]:
    """S-16: the 27 columns the engine reads, so that a scan is pruned to them."""
    from ..operators.register import FIELDS, HIDDEN

    return [F.col(c) for c in ["register_id", *FIELDS.values(), *HIDDEN] if c in frame.columns]
