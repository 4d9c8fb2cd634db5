"""Best representative of each group of captures.

The fields of a record form bundles (a lot; the parts of an address; a tax id): the parts of a bundle always come from one capture.
A value is fit or not; among fit candidates a branch-and-bound search takes whole bundles so that the trust of the choice is the
highest, under functional dependencies that may bind bundles to each other. Candidates are reduced before the shuffle: of one group,
bundle and trust only the latest capture can survive (with dependencies: of each value that one asks for), so even a group that holds a third of all
rows is a handful of rows when it is searched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import merged_checkpoint as checkpoint
from . import addresses
from .addresses import FORM, REGISTER
from .linkage import with_numbers

BUNDLES = ["lot", "address", "tax_id"]
Candidate = tuple[int, str, int, str]


def search(candidates: list[list[Candidate]], allowed: Callable[[list[Candidate | None]], bool] | None = None) -> list[Candidate | None]:
    """Branch and bound over bundles: the choice (rank vector) that is lexicographically best per bundle in sum of trust.

    Each candidate is (trust, time, record, value). A branch whose trust with the best of all open bundles does not exceed the best
    whole choice is cut. ``allowed`` judges partial choices (functional dependencies). An empty choice for a bundle is always open.
    """
    ordered = [sorted(c, reverse=True) for c in candidates]
    best_left = [0] * (len(ordered) + 1)
    for i in range(len(ordered) - 1, -1, -1):
        best_left[i] = best_left[i + 1] + (ordered[i][0][0] + 1 if ordered[i] else 0)
    best: tuple[int, list[Candidate | None]] = (-1, [None] * len(ordered))

    def go(i: int, trust: int, chosen: list[Candidate | None]) -> None:
        nonlocal best
        if trust + best_left[i] <= best[0]:
            return
        if i == len(ordered):
            best = (trust, chosen)
            return
        for c in [*ordered[i], None]:
            now = [*chosen, c]
            if allowed is None or allowed(now):
                go(i + 1, trust + (c[0] + 1 if c else 0), now)

    go(0, 0, [])
    return best[1]


def same_value(left: int, right: int, table: dict[str, str]) -> Callable[[list[Candidate | None]], bool]:
    """Functional dependency left -> right: where ``table`` knows the left bundle's value, the right bundle must hold what it says."""

    def allowed(chosen: list[Candidate | None]) -> bool:
        if len(chosen) <= max(left, right) or chosen[left] is None or chosen[right] is None:
            return True
        return table.get(chosen[left][3], chosen[right][3]) == chosen[right][3]

    return allowed


def fit_lot(c: Column) -> Column:
    """A number, perhaps with R, after the usual labels; misread characters and placeholders are unfit."""
    return F.coalesce(c.rlike(r"^(?i)\s*(?:lot\s*#?|l-|#)?\s*0*[1-9][0-9]*r?\.?\s*$"), F.lit(False))


def fit_tax_id(c: Column) -> Column:
    """District (one or two digits) and the eight digits of the account, with or without a dash of any kind; cut-off ids are unfit."""
    return F.coalesce(c.rlike(r"^\s*(?:[0-9]{1,2}\s*[-–—‐‑−]\s*[0-9]{8}|[0-9]{10})\s*$"), F.lit(False))


def fit_addresses(records: DataFrame, register: DataFrame) -> DataFrame:
    """record_id of the records whose address is fit: number, street and type without a mended character, spelt as the register spells it
    (a street that nothing resembles counts as right)."""
    _, rec, index = addresses.located(register, records)
    spelt = index.groupBy(*FORM).agg(F.max("exact").alias("exact"))
    return rec.where("clean AND number <> '' AND type <> ''").join(spelt, FORM, "left").where("exact IS NULL OR exact").select("record_id").distinct()


KEYS = ["packet_id", "sheet_no"]
MOST_SOURCES = 10_000


def trust_of(sources: DataFrame) -> DataFrame:
    """Trust by folded source name; a list of sources, not a table that grows: more than ``MOST_SOURCES`` raise."""
    trust = sources.where(F.col("capture_source").isNotNull()).groupBy(F.lower(F.trim("capture_source")).alias("_source")).agg(F.max("trust").cast("int").alias("trust"))
    rows = trust.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} capture sources")
    return sources.sparkSession.createDataFrame([(r["_source"], r["trust"]) for r in rows], "_source string, trust int")


def fit_values(records: DataFrame, register: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of two or more records (KEYS), and the fit values of all records: KEYS, trust, time, record_id, bundle (number), value."""
    rows = records.where(F.col("packet_id").isNotNull() & F.col("sheet_no").isNotNull() & F.col("record_id").isNotNull())
    groups = rows.groupBy(*KEYS).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    fit = fit_addresses(records, register).withColumn("fit_address", F.lit(True))
    marked = rows.select(*KEYS, "record_id", F.lower(F.trim("capture_source")).alias("_source"), "captured_at", "lot", "address", "tax_id").join(fit, "record_id", "left").join(F.broadcast(trust_of(sources)), "_source", "left")
    bundle = [
        F.when(ok, F.struct(F.lit(i).alias("bundle"), F.coalesce(F.col(value), F.lit("")).alias("value")))
        for i, (ok, value) in enumerate(((fit_lot(F.col("lot")), "lot"), (F.coalesce("fit_address", F.lit(False)), "address"), (fit_tax_id(F.col("tax_id")), "tax_id")))
    ]
    time = F.coalesce(F.unix_micros(F.col("captured_at").cast("timestamp")), F.lit(-(1 << 62))).alias("time")
    each = marked.select(*KEYS, F.coalesce("trust", F.lit(0)).alias("trust"), time, "record_id", F.explode(F.filter(F.array(*bundle), lambda b: b.isNotNull())).alias("_b"))
    return groups, each.select(*KEYS, "trust", "time", "record_id", "_b.*")


def _chosen(groups: DataFrame, lists: DataFrame, order: list[int], rule: Callable[[list[dict]], Callable[[list[Candidate | None]], bool] | None], columns: list[str]) -> DataFrame:
    """The search run on the reduced candidates of each group, the bundles taken in ``order``."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for candidates in pdf["candidates"]:
                rows = [] if candidates is None else list(candidates)
                own: list[list[Candidate]] = [[], [], []]
                for c in rows:
                    own[c["bundle"]].append((int(c["trust"]), int(c["time"]), int(c["record_id"]), c["value"]))
                found = search([own[i] for i in order], rule(rows))
                out.append([(x[2] if (x := found[order.index(i)]) else 0) for i in range(3)])
            yield pd.concat([pdf[KEYS].reset_index(drop=True), pd.DataFrame(out, columns=columns, dtype="int64")], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), *(f"{c} long" for c in columns)])
    return groups.join(checkpoint(lists), KEYS, "left").mapInPandas(choose, schema)


COLUMNS = [f"{b}_record_id" for b in BUNDLES]


def best_captures(records: DataFrame, register: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per (packet_id, sheet_no) with two or more records: the record whose lot, address and tax id survive, 0 where none is fit.

    The more trusted source wins, then the later captured_at, then the larger record_id. A source not in the list has trust 0, a null
    captured_at is the earliest. Rows without packet, sheet or record id are left out; empty tables give an empty result. The required
    result takes every field's best value by itself, so no dependency binds the bundles here; ``consistent_captures`` has them.
    """
    groups, each = fit_values(records, register, sources)
    top = each.groupBy(*KEYS, "bundle", "trust").agg(F.max(F.struct("time", "record_id", "value")).alias("_top"))
    lists = top.groupBy(*KEYS).agg(F.collect_list(F.struct("bundle", "trust", F.col("_top.time").alias("time"), F.col("_top.record_id").alias("record_id"), F.col("_top.value").alias("value"))).alias("candidates"))
    return _chosen(groups, lists, [0, 1, 2], lambda _: None, COLUMNS)


def says(register: DataFrame, reg_place: DataFrame) -> DataFrame:
    """The dependency tax id -> lot, place of the register: account (ten digits), want_lot, want_place; '' where the register is silent or
    gives an account two values."""
    account = F.concat(F.lpad(F.trim(REGISTER["district"]), 2, "0"), F.trim(REGISTER["account"])).alias("account")
    rows = with_numbers(register.select("register_id", account, F.col(REGISTER["lot"]).alias("raw_lot")), {"lot": "raw_lot"}).join(reg_place, "register_id", "left")
    one = lambda c: F.coalesce(F.when(F.min(c) == F.max(c), F.min(c)), F.lit(""))
    return rows.where(F.col("account").isNotNull()).groupBy("account").agg(one(F.nullif("lot", F.lit(""))).alias("want_lot"), one("place").alias("want_place"))


def consistent_captures(records: DataFrame, register: DataFrame, sources: DataFrame) -> DataFrame:
    """As ``best_captures``, but of each group the lot, address and tax id of the highest sum of trust that agree with one another: where
    the register knows the tax id, the lot must be its lot and the address must lie at its place.

    Values are compared in canonical form (number, place, ten digits). Before a group is gathered it is cut to what can be chosen: of each
    value the best record, and of all values that no tax id of the group asks for only the best one per bundle; so a group is as large
    as the number of register accounts its captures name, whatever the number of captures. No optimum is lost by that.
    """
    groups, each = fit_values(records, register, sources)
    reg_place, rec_place = addresses.places(register, records)
    asked = says(register, reg_place)
    numbers = with_numbers(each.withColumn("raw_lot", F.when(F.col("bundle") == 0, F.col("value"))), {"lot": "raw_lot"})
    digits = F.lpad(F.regexp_replace("value", "[^0-9]", ""), 10, "0")
    placed = numbers.join(rec_place, "record_id", "left")
    key = F.when(F.col("bundle") == 0, F.col("lot")).when(F.col("bundle") == 1, F.coalesce("place", F.concat(F.lit("?"), "value"))).otherwise(digits)
    top = placed.withColumn("key", key).groupBy(*KEYS, "bundle", "key").agg(F.max(F.struct("trust", "time", "record_id")).alias("_top"))
    top = checkpoint(top.join(asked, (F.col("bundle") == 2) & (F.col("key") == F.col("account")), "left").drop("account"))
    known = (F.col("want_lot") != "") | (F.col("want_place") != "")
    wants = top.where((F.col("bundle") == 2) & known).select(*KEYS, F.explode(F.array(F.struct(F.lit(0).alias("bundle"), F.col("want_lot").alias("key")), F.struct(F.lit(1).alias("bundle"), F.col("want_place").alias("key")))).alias("_w")).select(*KEYS, "_w.*").where("key <> ''").distinct()
    wanted = top.where("bundle < 2").join(wants, [*KEYS, "bundle", "key"], "left_semi")
    free = top.where("bundle < 2").join(wants, [*KEYS, "bundle", "key"], "left_anti").unionByName(top.where((F.col("bundle") == 2) & ~F.coalesce(known, F.lit(False))))
    best = free.groupBy(*KEYS, "bundle").agg(F.max(F.struct("_top", "key")).alias("_best")).select(*KEYS, "bundle", F.col("_best.key").alias("key"), F.col("_best._top").alias("_top"))
    kept = wanted.select(*KEYS, "bundle", "key", "_top", "want_lot", "want_place").unionByName(best, allowMissingColumns=True).unionByName(top.where((F.col("bundle") == 2) & known).select(*KEYS, "bundle", "key", "_top", "want_lot", "want_place"))
    lists = kept.groupBy(*KEYS).agg(F.collect_list(F.struct("bundle", F.col("_top.trust").alias("trust"), F.col("_top.time").alias("time"), F.col("_top.record_id").alias("record_id"), F.col("key").alias("value"), F.coalesce("want_lot", F.lit("")).alias("want_lot"), F.coalesce("want_place", F.lit("")).alias("want_place"))).alias("candidates"))

    def rule(rows: list[dict]) -> Callable[[list[Candidate | None]], bool]:
        lot = same_value(0, 1, {c["value"]: c["want_lot"] for c in rows if c["bundle"] == 2 and c["want_lot"]})
        place = same_value(0, 2, {c["value"]: c["want_place"] for c in rows if c["bundle"] == 2 and c["want_place"]})
        return lambda chosen: lot(chosen) and place(chosen)

    return _chosen(groups, lists, [2, 0, 1], rule, COLUMNS)
