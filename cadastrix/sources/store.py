"""The review table as parts with a pointer, and the jobs that file documents."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review


class SharedFiles:
    """Small files of a folder on any file system that Spark can write to (local, HDFS, object stores), through its own drivers."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm = spark._jvm
        self.base = base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):  # type: ignore[no-untyped-def]
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def uri(self, name: str) -> str:
        return f"{self.base}/{name}"

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A whole new content, first under a name of its own, then by rename over the old one."""
        temporary = f".{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(temporary), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.fs.getConf())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(self._path(temporary), self._path(name), options)


class VersionedStore:
    """G-7, G-8, K-10: rows lie in parts, a pointer names the parts that count and is swapped by rename; one writer, any number of readers.

    ``base`` is a folder on a file system that driver and executors share. An append writes the new rows only; after ``compact_after``
    parts they are written as one. A batch that comes again under its number, or ids that are there already, add nothing.
    """

    def __init__(self, spark: SparkSession, base: str, key: str = "doc_id", compact_after: int = 50):
        self.spark, self.key, self.compact_after = spark, key, compact_after
        self.files = SharedFiles(spark, base)

    def _pointer(self) -> dict:
        text = self.files.read("CURRENT")
        return json.loads(text) if text else {"version": 0, "parts": [], "batches": [], "settings": {}}

    def _swap(self, pointer: dict) -> None:
        self.files.write("CURRENT", json.dumps(pointer, indent=2))

    def _write(self, docs: DataFrame, version: int) -> str:
        path = self.files.uri(f"v{version:08d}-{uuid.uuid4().hex[:8]}")
        docs.write.parquet(path)
        return path

    def read(self) -> DataFrame | None:
        parts = self._pointer()["parts"]
        return self.spark.read.option("mergeSchema", len(parts) > 1).parquet(*parts) if parts else None

    def replace(self, docs: DataFrame) -> int:
        """G-3: a whole new queue."""
        old = self._pointer()
        version = old["version"] + 1
        self._swap(old | {"version": version, "parts": [self._write(docs, version)]})
        return version

    def unknown(self, docs: DataFrame) -> DataFrame:
        """The rows whose id is new; only the ids of the parts are read."""
        old = self.read()
        return docs if old is None else docs.join(old.select(self.key), self.key, "left_anti")

    def append(self, docs: DataFrame, batch: int | None = None) -> int:
        """G-2, U-4: rows whose id is new, as a part of their own; of repeated ids one counts. Only the ids of the old parts are read."""
        pointer = self._pointer()
        if batch is not None and batch in pointer["batches"]:
            return pointer["version"]
        fresh = self.unknown(docs.dropDuplicates([self.key]))
        version = pointer["version"] + 1
        part = self._write(fresh, version)
        done = [*pointer["batches"], batch][-1000:] if batch is not None else pointer["batches"]
        self._swap(pointer | {"version": version, "parts": [*pointer["parts"], part], "batches": done})
        return self.compact() if len(pointer["parts"]) >= self.compact_after else version

    def compact(self) -> int:
        rows = self.read()
        return self._pointer()["version"] if rows is None else self.replace(rows)

    def upsert(self, docs: DataFrame) -> int:
        """G-8: rows replaced by id; an id that is not there raises ``KeyError``."""
        old = self.read()
        if old is None or docs.join(old.select(self.key), self.key, "left_anti").limit(1).count():
            raise KeyError("no such document")
        return self.replace(old.join(docs.select(self.key), self.key, "left_anti").unionByName(docs, allowMissingColumns=True))

    def remove(self, ids: DataFrame) -> int:
        """U-3."""
        old = self.read()
        if old is None:
            raise KeyError("no such document")
        return self.replace(old.join(ids.select(self.key), self.key, "left_anti"))

    def clear(self) -> None:
        old = self._pointer()
        self._swap(old | {"version": old["version"] + 1, "parts": [], "batches": []})

    def settings(self, **changes: object) -> dict:
        """G-8, G-9: overlay of the settings; a blank output folder is refused, a new one is made."""
        if "output_folder" in changes:
            if not str(changes["output_folder"] or "").strip():
                raise ValueError("an output folder is needed")
            changes["output_folder"] = os.path.abspath(str(changes["output_folder"]).strip())
            os.makedirs(str(changes["output_folder"]), exist_ok=True)
        old = self._pointer()
        self._swap(old | {"settings": old["settings"] | changes})
        return self._pointer()["settings"]


CLAIMS = ".claims"
Writer = Callable[[str, dict], None]


def _free_name(target: str, n: int) -> str:
    stem, suffix = os.path.splitext(target)
    return target if n == 1 else f"{stem} ({n}){suffix}"


def file_one(row: dict, output: str, writer: Writer | None = None) -> str:
    """One document of a plan filed; its path. Nothing that is there is ever overwritten.

    The copy is completed under a claim of the document's id (metadata included), then linked to the first free name, which fails where
    the name is taken. The claim then holds the path, so a repeated task finds its own work by id and does nothing. The folder must
    allow hard links.
    """
    source = str(row["source_path"]).removeprefix("file:")
    if row["mode"] == "in_place":
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        if writer:
            temporary = f"{source}.{uuid.uuid4().hex}.tmp"
            shutil.copy2(source, temporary)
            try:
                writer(temporary, row)
                os.replace(temporary, source)
            finally:
                if os.path.exists(temporary):
                    os.remove(temporary)
        return source
    claims = os.path.join(output, CLAIMS)
    os.makedirs(claims, exist_ok=True)
    claim = os.path.join(claims, hashlib.sha256(str(row["doc_id"]).encode()).hexdigest())
    if os.path.exists(f"{claim}.filed"):
        with open(f"{claim}.filed", encoding="utf-8") as f:
            return f.read()
    if not os.path.exists(claim):
        temporary = f"{claim}.{uuid.uuid4().hex}"
        shutil.copy2(source, temporary)  # raises where the source is gone
        if writer:
            writer(temporary, row)
        os.replace(temporary, claim)
    target = os.path.join(output, row["dest"])
    os.makedirs(os.path.dirname(target), exist_ok=True)
    for n in range(1, review.MOST_CLAIMS + 1):
        free = _free_name(target, n)
        try:
            os.link(claim, free)
            break
        except FileExistsError:
            if os.path.samefile(claim, free):
                break
    else:
        raise FileExistsError(f"no free name left for {target}")
    temporary = f"{claim}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(free)
    os.replace(temporary, f"{claim}.filed")
    os.remove(claim)
    return free


def execute_filing(plan: DataFrame, output: str, writer: Writer | None = None) -> DataFrame:
    """K-1, K-5, K-6: files of a plan (doc_id, source_path, dest, mode, optional ocr_text) written under ``output`` by the executors.

    ``writer`` is an adapter that writes a row's metadata (``review.pdf_metadata``) into a file; its failure leaves the file without
    metadata, not unfiled. Returns doc_id, filed_path, error ('' when filed). Sources are removed in mode ``move``, after success only.
    """

    def careful(path: str, row: dict) -> None:
        try:
            writer(path, row)  # type: ignore[misc]
        except Exception as error:  # noqa: BLE001 - metadata is wanted, the file is needed
            print(f"no metadata in {path}: {error}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    target = file_one(r, output, careful if writer else None)
                    if r.get("ocr_text"):
                        with open(os.path.splitext(target)[0] + ".txt", "w", encoding="utf-8") as f:
                            f.write(r["ocr_text"])
                    source = str(r["source_path"]).removeprefix("file:")
                    if r["mode"] == "move" and os.path.exists(source):
                        os.remove(source)
                    rows.append((r["doc_id"], target, ""))
                except OSError as error:
                    rows.append((r["doc_id"], "", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["doc_id", "filed_path", "error"])

    return plan.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, filed_path string, error string")


def taken_names(spark: SparkSession, output: str) -> DataFrame:
    """``dest`` (folder/file) of the PDF files that the output folder holds."""
    base = output if "://" in output or output.startswith("file:") else f"file://{os.path.abspath(output)}"
    os.makedirs(base.removeprefix("file://"), exist_ok=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(base)
    return files.select(F.regexp_replace("path", r"^.*/([^/]+/[^/]+)$", "$1").alias("dest"))


def file_documents(store: VersionedStore, output: str, whole_packets: bool = True, copy: bool = False, in_place: bool = False, save_text: bool = False, writer: Writer | None = None, only: DataFrame | None = None, filed_at: str = "") -> DataFrame:
    """K-9: the queue (or the documents of ``only``, by id) filed: names, plan, execution, audit, then the queue.

    Whole packets share the folder of their first document and get an audit row each; their print-outs are disposed of once all
    documents of the packet are filed (K-8), never in place. Filed documents leave the queue; a document that fails stays with its
    packet's print-outs. Single filing (``only``) keeps each document's own folder and writes no audit. No document to file raises.
    Returns doc_id, filed_path, error.
    """
    queue = store.read()
    wanted = None if queue is None else queue if only is None else queue.join(only.select(store.key).distinct(), store.key, "left_semi")
    if wanted is None or wanted.where(~F.col("is_lookup")).limit(1).count() == 0:
        raise ValueError("no permanent documents to file")
    named = review.with_packet_folder(wanted) if whole_packets and only is None else wanted
    plan = review.filing_plan(review.pdf_metadata(named, filed_at), copy=copy, in_place=in_place, existing=None if in_place else taken_names(store.spark, output))
    plan = plan.withColumn("doc_id", F.col(store.key).cast("string")).withColumn("ocr_text", F.col("ocr_text") if save_text else F.lit(""))
    path = store.files.uri(f"filed-{uuid.uuid4().hex[:8]}")
    execute_filing(plan, output, writer).write.parquet(path)  # written once: filing must not run again for each reader
    done = store.spark.read.parquet(path)
    filed = done.where("error = ''")
    left = queue.withColumn("_id", F.col(store.key).cast("string"))
    gone = filed.select(F.col("doc_id").alias("_id"))
    if whole_packets and only is None:
        failed = left.join(done.where("error <> ''").select(F.col("doc_id").alias("_id")), "_id", "left_semi").select("packet_id").distinct()
        clear = left.where("is_lookup").join(failed, "packet_id", "left_anti")
        if not in_place:
            audit = named.withColumn("doc_id", F.col(store.key).cast("string")).join(filed, "doc_id").withColumn("file_name", F.element_at(F.split("filed_path", "/"), -1))
            append_audit(review.audit_rows(audit, filed_at).drop("packet_id"), f"{output}/filing_audit")
            clear.select("source_path").foreachPartition(_dispose)
        gone = gone.unionByName(clear.select("_id"))
    store.replace(left.join(gone, "_id", "left_anti").drop("_id"))
    return done


def _dispose(rows: Iterator) -> None:
    """K-8."""
    for r in rows:
        path = str(r["source_path"]).removeprefix("file:")
        if os.path.exists(path):
            os.remove(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """K-7: audit rows appended as CSV parts without header (a header per part would repeat it); ``read_audit`` names the columns."""
    rows.write.mode("append").csv(path, header=False, escape='"')


AUDIT = "lot_number string, address string, location_filed string, time_filed string, project_code string, section string, file_count long, files_filed string"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).csv(path, header=False, escape='"')
