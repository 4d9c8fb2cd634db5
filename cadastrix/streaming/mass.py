"""Mass mode as a stream: every document on its own, published once, micro-batch by micro-batch; progress as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, layout, register, review
from ..plans.config import Config
from ..session import checkpoint as cut
from ..sources.store import VersionedStore


def process(docs: DataFrame, known: DataFrame, config: Config, project_code: str = "Project", fuzzy: bool = True, key: str = "doc_id", lines: str | None = None) -> DataFrame:
    """J-7 and R-1 for scanned documents (``ocr_text``, ``source_name``); where they have ``ocr_pages`` (or ``lines`` names a column of layout
    lines), addresses are sought there first. ``known`` is the register from ``with_address``."""
    rows = docs if lines else layout.with_address_lines(docs, config, "_lines")
    found = cut(extract.extract_metadata(rows, config, project_code, fuzzy=fuzzy, lines=lines or "_lines").drop("_lines"))
    enriched = register.enrich_mass(found, known, config.county, project_code, key) if config.get("sdat_lookup", True) else found
    return review.sync(enriched)


ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def _adaptive(spark: SparkSession, value: str) -> Iterator[None]:
    """A stream switches adaptive execution off in its session; the work on one batch keeps no state and runs as any other job."""
    old = spark.conf.get(ADAPTIVE)
    spark.conf.set(ADAPTIVE, value)
    try:
        yield
    finally:
        spark.conf.set(ADAPTIVE, old)


def start(stream: DataFrame, known: DataFrame, config: Config, publish: Callable[[DataFrame, int], None], checkpoint: str, project_code: str = "Project", fuzzy: bool = True, store: VersionedStore | None = None) -> StreamingQuery:
    """G-1: ``foreachBatch`` over the stream; ``publish`` has to be idempotent by id, as a batch may come again after a failure. Documents
    that ``store`` holds already are not processed again; the pages of the others are dropped once their lines are read."""
    adaptive = known.sparkSession.conf.get(ADAPTIVE)

    def each(batch: DataFrame, number: int) -> None:
        with _adaptive(batch.sparkSession, adaptive):
            new = store.unknown(batch) if store else batch
            rows = layout.with_address_lines(new, config, "_lines").drop("ocr_pages")
            publish(process(rows, known, config, project_code, fuzzy, lines="_lines"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_to(store: VersionedStore) -> Callable[[DataFrame, int], None]:
    return lambda batch, number: store.append(batch.drop("ocr_pages"), number) and None


@dataclass
class Progress:
    """G-3..G-5, D14: messages with elapsed seconds and stage timings; ``snapshot`` is detached; ``rows`` feed the ranking."""

    run_id: str = "run"
    started: float = field(default_factory=time.time)
    messages: list[dict] = field(default_factory=list)
    timings: dict[str, float] = field(default_factory=dict)
    active: bool = True
    failed: bool = False

    def reset(self) -> None:
        self.started, self.messages, self.timings, self.active, self.failed = time.time(), [], {}, True, False

    def add(self, message: str) -> None:
        if message and message.strip():
            self.messages.append({"elapsed": round(time.time() - self.started, 2), "message": message.strip()})

    def set_timing(self, stage: str, seconds: float) -> None:
        self.timings[stage] = round(seconds, 3)

    def add_timing(self, stage: str, seconds: float) -> None:
        self.timings[stage] = round(self.timings.get(stage, 0.0) + seconds, 3)

    def finish(self, failed: bool = False) -> None:
        self.active, self.failed = False, failed

    def snapshot(self) -> dict:
        return {"active": self.active, "failed": self.failed, "messages": [dict(m) for m in self.messages], "timings": dict(self.timings)}

    @contextmanager
    def timed(self, stage: str) -> Iterator[None]:
        began = time.time()
        try:
            yield
        finally:
            self.add_timing(stage, time.time() - began)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.run_id, k, v) for k, v in self.timings.items()], "run_id string, stage string, seconds double")
