"""Mixing sources to target shares by pivotal dependent rounding.

Sizes are tokens of a public tokenizer. Every distinct text of a source gets the same expected number of copies; its whole part
is taken, the fraction is rounded. Rounding pairs two texts and moves token mass from one to the other, in a random direction
whose odds keep both expectations, until one of them is whole; the mass of the pair stays the same. Each bucket of texts leaves
at most one open fraction; these residuals meet again bucket by bucket in a reduction tree until one per source is left, which
is drawn. The share reached so differs from the target by less than one text per source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint
from .bpe import with_token_count

BUCKET_ROWS = 20_000
FAN_IN = 256
MOST_SOURCES = 10_000
EPS = 1e-12


def pivotal(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Round probabilities so that ``sum(p * size)`` stays the same and no expectation changes; with ``last`` the one open fraction is drawn."""
    p = p.astype(float).copy()
    draws = rng.random(len(p) + 1)
    open_at = -1
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = round(p[i])
            continue
        if open_at < 0:
            open_at = i
            continue
        j = open_at
        up = min((1 - p[i]) * size[i], p[j] * size[j])
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if draws[i] * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for k in (i, j):
            if p[k] <= EPS or p[k] >= 1 - EPS:
                p[k] = round(p[k])
        open_at = next((k for k in (i, j) if EPS < p[k] < 1 - EPS), -1)
    if last and open_at >= 0:
        p[open_at] = float(draws[-1] < p[open_at])
    return p


def distinct_texts(docs: DataFrame, targets: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per distinct text of a target source: doc_id (the smallest), source, tokens. Texts without tokens are left out.

    A text that several sources hold counts once, with the source of its smallest doc_id, so no text exceeds its limit.
    """
    wanted = targets.select("source").where(F.col("source").isNotNull()).distinct()
    rows = docs.select("doc_id", "source", F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    counted = with_token_count(rows.join(wanted, "source", "left_semi"), folder=folder).where(F.col("tokens") > 0)
    keyed = counted.select(F.sha2("text", 256).alias("_text"), F.struct("doc_id", "source", "tokens").alias("_first"))
    return keyed.groupBy("_text").agg(F.min("_first").alias("_first")).select("_first.*")


def plan_copies(totals: list[dict], total_tokens: float | None = None) -> dict[str, dict]:
    """Expected copies per text of each source.

    Without ``total_tokens`` the mix is the largest in which every source that holds texts keeps its share under its limit of
    repeats; the share of a source without texts is spread over the others in proportion. With a larger ``total_tokens`` limited
    sources stop at their limit and the rest takes up what they lack.
    """
    live = [t for t in totals if t["tokens"] > 0 and t["share"] > 0 and t["repeats"] > 0]
    if not live:
        return {}
    whole = sum(t["share"] for t in live)
    most = {t["source"]: t["repeats"] * t["tokens"] for t in live}
    share = {t["source"]: t["share"] / whole for t in live}
    total = min(most[s] / share[s] for s in share) if total_tokens is None else min(total_tokens, sum(most.values()))
    mass, free, left = {}, set(share), total
    while free:
        scale = left / sum(share[s] for s in free)
        full = {s for s in free if share[s] * scale >= most[s] * (1 - 1e-12)}
        if not full:
            mass |= {s: share[s] * scale for s in free}
            break
        mass |= {s: most[s] for s in full}
        left -= sum(most[s] for s in full)
        free -= full
    tokens = {t["source"]: t["tokens"] for t in live}
    return {s: {"copies": min(m / tokens[s], most[s] / tokens[s]), "tokens": m} for s, m in mass.items()}


def _round_level(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    names = ["doc_id", "source", "tokens", "whole", "p", "bucket"]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        source, bucket = str(pdf["source"].iloc[0]), int(pdf["bucket"].iloc[0])
        rng = np.random.default_rng([seed, level, bucket, *source.encode()])
        return pdf[names].assign(p=pivotal(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(dtype=float), rng, last))

    schema = "doc_id long, source string, tokens long, whole long, p double, bucket long"
    return rows.select(names).groupBy("source", "bucket").applyInPandas(settle, schema)


def mix_sources(docs: DataFrame, targets: DataFrame, text: str = "text", total_tokens: float | None = None, seed: int = 7, folder: str | None = None) -> DataFrame:
    """Texts of the mix: doc_id, source, tokens, copies (at least 1, at most the ``max_repeats`` of the source).

    ``targets`` has source, target_share, max_repeats; rows with a null or non-positive value take no part, of several rows of a
    source the one with the largest share counts. Documents without source, with a source without target, or with an empty or
    null text are left out. An empty table gives an empty mix. The result depends on the rows and the seed only.
    """
    texts = checkpoint(distinct_texts(docs, targets, text, folder))
    sums = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    limits = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    rows = limits.join(sums, "source", "left").select("source", "t.*", "tokens", "n").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with a target")
    plan = plan_copies([{"source": r.source, "share": r.target_share or 0, "repeats": r.max_repeats or 0, "tokens": r.tokens or 0} for r in rows], total_tokens)
    spark = docs.sparkSession
    counts = {r.source: r.n or 0 for r in rows}
    shape = [(s, float(x["copies"]), max(1, math.ceil(counts[s] / BUCKET_ROWS))) for s, x in sorted(plan.items())]
    planned = spark.createDataFrame(shape, "source string, expected double, buckets long")
    whole = F.floor(F.col("expected") + 1e-9)
    level = texts.join(F.broadcast(planned), "source").select(
        "doc_id", "source", "tokens", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("expected") - whole).alias("p"), F.pmod(F.xxhash64("doc_id"), F.col("buckets")).alias("bucket")
    )
    settled: list[DataFrame] = []
    buckets, step = max((b for _, _, b in shape), default=1), 0
    while True:
        last = buckets <= 1
        done = _round_level(level, step, last, seed)
        if last:
            settled.append(done)
            break
        done = checkpoint(done)
        is_open = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        settled.append(done.where(~is_open))
        level = done.where(is_open).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        buckets, step = math.ceil(buckets / FAN_IN), step + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.round("p").cast("long")).alias("copies")
    return out.select("doc_id", "source", "tokens", copies).where(F.col("copies") > 0)


def mix_shares(docs: DataFrame, targets: DataFrame, text: str = "text", total_tokens: float | None = None, seed: int = 7, folder: str | None = None) -> DataFrame:
    """Report per target source: target and reached share, tokens, texts used and the most copies of one text (0 where it lacks texts)."""
    mix = mix_sources(docs, targets, text, total_tokens, seed, folder)
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("mix_tokens").alias("_total"))
    limits = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t"))
    zero = {"mix_tokens": 0, "texts": 0, "most_copies": 0, "_total": 0}
    rows = limits.select("source", "t.*").join(F.broadcast(used), "source", "left").join(F.broadcast(total), F.lit(True), "left").na.fill(zero)
    share = F.when(F.col("_total") > 0, F.col("mix_tokens") / F.col("_total")).otherwise(F.lit(0.0))
    return rows.withColumn("actual_share", share).drop("_total")
