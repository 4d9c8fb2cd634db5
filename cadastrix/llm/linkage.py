"""Records and register rows of one property, matched without a common key.

Records, their attributes (street, house number, lot, map, parcel) and tokens (the bigrams of a street's name, the other values) form a
graph; random walks over it train skip-gram vectors of the tokens. A street's name has the weighted sum of its bigrams as vector; signs
against random hyperplanes, in several tables, put like names into one bucket, so misspelt names meet the register's; candidates are
reranked exactly (edits, type, town, ZIP). Lot, map and parcel together are a second view, hashed by the reading of its tokens. Cosine
and agreement of the fields become a confidence that is calibrated on records whose tax id is known. Names and views are compared once
per distinct value, so a place that a third of all records name is one row here.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import brief_checkpoint
from ..session import merged_checkpoint as checkpoint
from ..session import short_plan_texts
from . import addresses
from .addresses import FORM, REGISTER, SPELLING

SIZE = 64
#: Tables and bits of the hashing of names (open: near names must meet) and of the readings of lot, map and parcel (tight).
NAME_TABLES, NAME_BITS = 40, 8
TABLES, BITS = 3, 24
#: Rows of one graph that is walked and trained on at once (all rows are in one).
BLOCK = 20_000
EPOCHS = 2
#: Farthest that one batch moves a vector.
STEP = 0.1
SHARED = 64
ACCEPT = 0.6
SEED = 17


def _fold(c: Column) -> Column:
    """Digits of a number in which letters were read for digits."""
    return F.regexp_replace(F.translate(F.upper(c), "OIL|!SBZGQ", "0111158260"), "[^0-9]", "")


#: Labels before a number and the one letter that may end it.
LABELS = {"lot": (r"^\s*(?:LOT\b|L-|L\s)\s*[#.:]*", "R"), "map": (r"^\s*(?:TAX )?MAP\s*", "ABCD"), "parcel": (r"^\s*P(?:ARCEL)?[\s.]*", "")}


def with_numbers(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns lot, map and parcel in canonical form from the raw columns given: label and leading zeros dropped, misread digits mended,
    one ending letter kept; '' where missing or a placeholder. Done in steps, so that no expression is repeated."""
    for name, raw in columns.items():
        label, tail = LABELS[name]
        bare = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(F.col(raw), F.lit(""))), label, ""), "[^A-Z0-9|!]", "")
        rows = rows.withColumn("_bare", bare).withColumn("_end", F.regexp_extract("_bare", f"(?<=.)([{tail}])$", 1) if tail else F.lit(""))
        rows = rows.withColumn("_core", F.ltrim(_fold(F.expr("substring(_bare, 1, length(_bare) - length(_end))")), F.lit("0")))
        rows = rows.withColumn(name, F.when((F.col("_core") == "") | F.col("_bare").contains("UNKNOWN"), F.lit("")).otherwise(F.concat("_core", "_end"))).drop("_bare", "_end", "_core")
    return rows


def _triple(lot: str, map_: str, parcel: str) -> Column:
    return F.when((F.col(lot) != "") & (F.col(map_) != "") & (F.col(parcel) != ""), F.concat_ws("|", lot, map_, parcel))


# ---------------------------------------------------------------- token vectors


def start_vector(token: str) -> np.ndarray:
    """Unit vector drawn by the token's own hash: the same on every machine, and where the training of every graph begins."""
    v = np.random.default_rng(zlib.crc32(token.encode("utf-8", "replace"))).normal(size=SIZE)
    return (v / np.linalg.norm(v)).astype(np.float32)


Record = list[list[str]]


def walks(records: list[Record], per_record: int = 2, hops: int = 6, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Token names, and random walks record - attribute - token - record ... as rows of node numbers (tokens first, then records). A record
    is a list of attributes, an attribute a list of tokens; records without tokens start no walk."""
    names = sorted({t for record in records for tokens in record for t in tokens})
    at = {n: i for i, n in enumerate(names)}
    own = [[[at[t] for t in tokens] for tokens in record if tokens] for record in records]
    owners: list[list[int]] = [[] for _ in names]
    for i, record in enumerate(own):
        for t in {t for tokens in record for t in tokens}:
            owners[t].append(i)
    rng = np.random.default_rng(seed)
    starts = [i for i, record in enumerate(own) if record]
    out = np.empty((len(starts) * per_record, 2 * hops), np.int32)
    luck = rng.random((len(out), 3 * hops))
    for row in range(len(out)):
        i = starts[row // per_record]
        for h in range(hops):
            tokens = own[i][int(luck[row, 3 * h] * len(own[i]))]
            token = tokens[int(luck[row, 3 * h + 1] * len(tokens))]
            out[row, 2 * h], out[row, 2 * h + 1] = len(names) + i, token
            i = owners[token][int(luck[row, 3 * h + 2] * len(owners[token]))]
    return names, out


def _subtract(table: np.ndarray, rows: np.ndarray, change: np.ndarray) -> None:
    """Changes taken from rows that may be named more than once. A row moves by ``STEP`` at most: the sum over all walks of a batch that
    pass one common token would else grow without end."""
    order = np.argsort(rows, kind="stable")
    own, begin = np.unique(rows[order], return_index=True)
    whole = np.add.reduceat(change[order], begin, axis=0)
    table[own] -= whole * np.minimum(1, STEP / (np.linalg.norm(whole, axis=1, keepdims=True) + 1e-9))


def train_vectors(records: list[Record], epochs: int = EPOCHS, window: int = 2, negatives: int = 4, rate: float = 0.03, seed: int = SEED) -> dict[str, np.ndarray]:
    """Skip-gram vectors with negative sampling over the walks; only tokens are returned, the vectors of records are dropped."""
    names, rows = walks(records, seed=seed)
    if not names:
        return {}
    rng = np.random.default_rng(seed)
    nodes = len(names) + len(records)
    inner = rng.normal(0, 1 / np.sqrt(SIZE), (nodes, SIZE)).astype(np.float32)
    inner[: len(names)] = [start_vector(n) for n in names]
    outer = np.zeros_like(inner)
    often = np.bincount(rows.ravel(), minlength=nodes) ** 0.75
    pick = np.cumsum(often / often.sum())
    width = rows.shape[1]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            some = rows[part]
            a = np.concatenate([some[:, i] for i in range(width) for j in range(max(0, i - window), min(width, i + window + 1)) if i != j])
            b = np.concatenate([some[:, j] for i in range(width) for j in range(max(0, i - window), min(width, i + window + 1)) if i != j])
            # negatives are drawn once per batch, so their scores are one matrix product; each counts as its share of ``negatives``
            other = np.searchsorted(pick, rng.random(SHARED)).clip(max=nodes - 1)
            v, u, far = inner[a], outer[b], outer[other]
            near_gap = ((1 / (1 + np.exp(-(v * u).sum(axis=1))) - 1) * rate).astype(np.float32)
            far_gap = (rate * negatives / SHARED / (1 + np.exp(-(v @ far.T)))).astype(np.float32)
            _subtract(inner, a, near_gap[:, None] * u + far_gap @ far)
            _subtract(outer, b, near_gap[:, None] * v)
            _subtract(outer, other, far_gap.T @ v)
    return {n: inner[i] / (np.linalg.norm(inner[i]) + 1e-9) for i, n in enumerate(names)}


def view_vector(tokens: list[str], vectors: dict[str, np.ndarray], weight: dict[str, float] | None = None) -> np.ndarray:
    v = sum((vectors[t] if t in vectors else start_vector(t)) * (weight or {}).get(t, 1.0) for t in tokens)
    return v / (np.linalg.norm(v) + 1e-9)


def hyperplanes(count: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(SIZE, count)).astype(np.float32)


def bucket_codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables) of bucket numbers."""
    signs = (x @ hyperplanes(tables * bits) > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2)


def token_sums(rows: pd.DataFrame) -> dict[str, tuple[int, np.ndarray]]:
    """Vectors trained on the graph of these rows, each with the number of rows that have its token; house numbers only guide the walks."""
    graph = [[[f"g:{g}" for g in addresses.grams(r.name_)] if r.name_ else [], *([f"{k}:{v}"] if v else [] for k, v in zip("nlmp", (r.number, r.lot, r.map, r.parcel), strict=True))] for r in rows.rename(columns={"name": "name_"}).itertuples()]
    often = Counter(t for record in graph for t in {t for tokens in record for t in tokens})
    return {t: (often[t], v) for t, v in train_vectors(graph).items() if not t.startswith("n:")}


def trained_vectors(register: DataFrame, records: DataFrame) -> tuple[list[str], np.ndarray]:
    """Trained vectors of the tokens of all rows of both tables, as tokens and a float16 matrix.

    The rows are dealt out by the hash of their id; every ``BLOCK`` of them is a graph of its own with the same start vectors, and a
    token's vectors of all graphs are averaged by how many rows have it there. What comes back are bigrams and short numbers.
    """
    columns, block = ["number", "name", "lot", "map", "parcel"], BLOCK
    rows = reduce(lambda a, b: a.unionByName(b), (r.select(F.xxhash64(key).alias("_hash"), F.col(key).alias("_id"), *columns) for r, key in ((register, "register_id"), (records, "record_id"))))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
            while held and (sum(map(len, held)) >= block or b is None):
                part = pd.concat(held)
                found = token_sums(part[columns].iloc[:block].fillna(""))
                held = [part.iloc[block:]] if len(part) > block else []
                yield pd.DataFrame({"token": list(found), "n": [n for n, _ in found.values()], "vector": [v.astype(np.float32).tobytes() for _, v in found.values()]})

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for t, n, v in zip(b["token"], b["n"], b["vector"], strict=True):
                sums[t] = sums.get(t, 0.0) + n * np.frombuffer(v, np.float32).astype(np.float64)
        matrix = np.stack([s / (np.linalg.norm(s) + 1e-9) for s in sums.values()]).astype(np.float16) if sums else np.zeros((0, SIZE), np.float16)
        yield pd.DataFrame({"tokens": ["\n".join(sums)], "matrix": [matrix.tobytes()]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with short_plan_texts(rows.sparkSession):
        each = rows.repartition(parts, "_id").sortWithinPartitions("_hash", "_id", *columns).mapInPandas(train, "token string, n long, vector binary")
        got = each.repartition(parts, "token").sortWithinPartitions("token", "n", "vector").mapInPandas(average, "tokens string, matrix binary").collect()
    matrices = [(r["tokens"].split("\n"), np.frombuffer(bytes(r["matrix"]), np.float16).reshape(-1, SIZE)) for r in got if r["tokens"]]
    whole = sorted(((t, v) for tokens, matrix in matrices for t, v in zip(tokens, matrix, strict=True)), key=lambda x: x[0])
    return [t for t, _ in whole], np.stack([v for _, v in whole]) if whole else np.zeros((0, SIZE), np.float16)


_kept: dict[int, dict[str, np.ndarray]] = {}


def _unpacked(shared: tuple[list[str], np.ndarray]) -> dict[str, np.ndarray]:
    key = zlib.crc32(shared[1].tobytes())
    if key not in _kept:
        _kept.clear()
        _kept[key] = dict(zip(shared[0], shared[1].astype(np.float32), strict=True))
    return _kept[key]


# ---------------------------------------------------------------- names: buckets and reranking


def like_names(names: DataFrame, streets: DataFrame, idf: dict[str, float], vectors: tuple[list[str], np.ndarray]) -> DataFrame:
    """Pairs (direction, name, other, d, cosine) of a written name and a register street's name that share a bucket and are within the
    edits allowed; both inputs have (direction, name), each name once."""
    shared = names.sparkSession.sparkContext.broadcast(vectors)
    weight = {f"g:{g}": w for g, w in idf.items()}

    def matrix(values: pd.Series) -> np.ndarray:
        known = _unpacked(shared.value)
        return np.stack([view_vector([f"g:{g}" for g in addresses.grams(v)], known, weight) for v in values]) if len(values) else np.zeros((0, SIZE))

    @F.pandas_udf("array<int>")
    def codes(values: pd.Series) -> pd.Series:
        return pd.Series(list(bucket_codes(matrix(values), NAME_TABLES, NAME_BITS).astype(np.int32)))

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((matrix(a) * matrix(b)).sum(axis=1))

    left = names.select(*SPELLING, F.posexplode(codes("name")).alias("table", "code"))
    right = streets.select("direction", F.col("name").alias("other"), F.posexplode(codes("name")).alias("table", "code"))
    near = (F.abs(F.length("name") - F.length("other")) <= 2) & (F.levenshtein("name", "other", 4) >= 0)
    met = left.join(right, ["direction", "table", "code"]).where(near).select(*SPELLING, "other").distinct()
    reranked = met.withColumn("d", addresses.verify(idf)("name", "other")).where("d >= 0")
    return reranked.withColumn("cosine", cosine("name", "other"))


def placed(reg: DataFrame, rec: DataFrame, reg_rows: DataFrame, rec_rows: DataFrame) -> tuple[DataFrame, DataFrame, tuple[list[str], np.ndarray]]:
    """(register_id, place), (record_id, place, cosine) and the trained vectors, from the parsed addresses and the canonical numbers.

    The register's streets come from its own forms; the records' names find theirs through the buckets. A record is placed where the
    register has a house on the street that fits it with fewest edits; an address that fits houses on several streets is no evidence.
    Every few joins are written: planning many at once takes more of the driver's heap than all tables there are.
    """
    forms = addresses.forms_of(reg)
    names = brief_checkpoint(forms.select(*SPELLING).distinct())
    idf = addresses.gram_weights(names)
    index = addresses.name_index(names, idf)
    full, own_pairs = addresses.full_streets(forms, index)
    each = addresses.fit_forms(forms, full, own_pairs)
    left = brief_checkpoint(forms.join(each.select(*FORM).distinct(), FORM, "left_anti"))
    partial, partial_pairs = addresses.partial_streets(left, index)
    rest = brief_checkpoint(addresses._fitting(left, partial_pairs, partial).withColumn("d", F.col("d") + addresses.PARTIAL))
    reg_place = addresses.register_places(reg, each.unionByName(rest))
    first = reg.groupBy("register_id").agg(F.min(F.struct("field", "number", "name")).alias("_a")).select("register_id", "_a.number", "_a.name")
    vectors = trained_vectors(reg_rows.join(first, "register_id", "left"), rec_rows.join(rec.select("record_id", "number", "name"), "record_id", "left"))
    written = rec.select(*FORM).distinct()
    spelt = brief_checkpoint(written.select(*SPELLING).distinct())
    standing = full.where("right_name IS NULL").select(*SPELLING).unionByName(partial.select(*SPELLING)).distinct()
    met = like_names(spelt, standing, idf, vectors)
    itself = spelt.join(names, SPELLING, "left_semi").select(*SPELLING, F.col("name").alias("other"), F.lit(0).alias("d"), F.lit(1.0).alias("cosine"))
    pairs = brief_checkpoint(met.unionByName(itself).groupBy(*SPELLING, "other").agg(F.min("d").alias("d"), F.max("cosine").alias("cosine")))
    found = addresses.fit_forms(written, full, pairs, partial, pairs).join(pairs.groupBy(*SPELLING).agg(F.max_by("cosine", -F.col("d")).alias("cosine")), SPELLING)
    found = brief_checkpoint(found)
    maybe = rec.where("number <> ''").join(found, FORM).select("record_id", addresses.house(), "cosine")
    there = maybe.join(reg_place.select("place").distinct(), "place")
    one = there.groupBy("record_id").agg(F.min("place").alias("place"), F.max("place").alias("_other"), F.max("cosine").alias("place_cosine")).where("place = _other").drop("_other")
    return reg_place, brief_checkpoint(one), vectors


# ---------------------------------------------------------------- lot, map and parcel together


def reading(token: Column) -> Column:
    """A token as it may have been read: the last letter B of a map may be a misread 8. Other misread digits are mended before."""
    return F.when(token.startswith("m:"), F.regexp_replace(token, "(?<=.)B$", "8")).otherwise(token)


def _triples(rows: DataFrame) -> DataFrame:
    part = F.split("triple", r"\|")
    tokens = F.array(*(F.concat(F.lit(f"{x}:"), part[i]) for i, x in enumerate("lmp")))
    return rows.where("triple IS NOT NULL").select(F.col("triple").alias("key"), tokens.alias("tokens")).dropDuplicates(["key"])


def same_views(records: DataFrame, register: DataFrame, vectors: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """Triples of one bucket that rerank as the same: record_key, register_key, cosine. A triple is hashed by the reading of its tokens, so
    a misread one meets its partner in every table; in the rerank every token must have one reading on both sides."""
    shared = records.sparkSession.sparkContext.broadcast(vectors or ([], np.zeros((0, SIZE), np.float16)))

    def matrix(values: pd.Series) -> np.ndarray:
        known = _unpacked(shared.value)
        return np.stack([view_vector(list(t), known) for t in values]) if len(values) else np.zeros((0, SIZE))

    @F.pandas_udf("array<long>")
    def codes(tokens: pd.Series) -> pd.Series:
        return pd.Series(list(bucket_codes(matrix(tokens), TABLES, BITS)))

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((matrix(a) * matrix(b)).sum(axis=1))

    def bucketed(rows: DataFrame, side: str) -> DataFrame:
        return _triples(rows).select(F.col("key").alias(f"{side}_key"), F.col("tokens").alias(f"{side}_tokens"), F.posexplode(codes(F.transform("tokens", reading))).alias("table", "code"))

    near = bucketed(records, "record").join(bucketed(register, "register"), ["table", "code"])
    alike = F.forall(F.arrays_zip("record_tokens", "register_tokens"), lambda t: reading(t["record_tokens"]) == reading(t["register_tokens"]))
    pairs = near.where(alike).dropDuplicates(["record_key", "register_key"])
    return pairs.select("record_key", "register_key", cosine("record_tokens", "register_tokens").alias("cosine"))


# ---------------------------------------------------------------- evidence and confidence


EVIDENCE = ["by_address", "by_triple", "address_lot", "address_no_lot", "address_other_lot", "alone_other_lot"]
# Weights used where no labelled record is there to calibrate on.
DEFAULT = [2.5, 4.0, 3.0, -3.5, -6.0, -1.0, -0.5]


def calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, ridge: float = 0.5) -> list[float]:
    """Logistic weights (last: bias) by Newton steps over rows that stand for ``n`` pairs each; the default weights where labels are lacking."""
    n = np.ones(len(y)) if n is None else n
    if n.sum() < 50 or y.min() == y.max():
        return list(DEFAULT)
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + ridge * w
        w -= np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), grad)
    return [float(v) for v in w]


def match_records(register: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs of a record and a register row with evidence for one property: register_id, record_id, confidence, cosine, tax_known.

    Evidence is a like-named place (with the lot, where rows of several accounts lie there), or lot, map and parcel together. Rows without
    id are left out; fields may be null, blank, placeholders or misread; repeated rows count once; empty tables give no pairs.
    """
    reg_addresses = checkpoint(addresses.register_addresses(register))
    rec_addresses = checkpoint(addresses.split_towns(checkpoint(addresses.record_addresses(records)), reg_addresses))
    account = F.concat(F.lpad(F.trim(REGISTER["district"]), 2, "0"), F.trim(REGISTER["account"])).alias("account")
    reg = register.where(F.col("register_id").isNotNull()).select("register_id", account, *(F.col(REGISTER[k]).alias(f"raw_{k}") for k in LABELS)).dropDuplicates(["register_id"])
    reg = checkpoint(with_numbers(reg, {k: f"raw_{k}" for k in LABELS}).withColumn("triple", _triple("lot", "map", "parcel")).drop(*(f"raw_{k}" for k in LABELS)))
    tax = F.coalesce("tax_id", F.lit(""))
    rec = records.where(F.col("record_id").isNotNull()).select("record_id", (F.trim(tax) != "").alias("tax_known"), _fold(tax).alias("tax"), F.col("lot").alias("raw_lot"), F.col("tax_map").alias("raw_map"), F.col("parcel").alias("raw_parcel"))
    rec = with_numbers(rec.dropDuplicates(["record_id"]), {k: f"raw_{k}" for k in LABELS}).withColumn("triple", _triple("lot", "map", "parcel"))
    rec = checkpoint(rec.drop(*(f"raw_{k}" for k in LABELS)))
    reg_place, rec_place, vectors = placed(reg_addresses, rec_addresses, reg, rec)
    reg = reg.join(reg_place, "register_id", "left")
    crowd = reg.where("place IS NOT NULL").groupBy("place").agg((F.min("account") != F.max("account")).alias("several"))
    reg = checkpoint(reg.join(crowd, "place", "left").withColumn("several", F.coalesce("several", F.lit(False))))
    rec = checkpoint(rec.join(rec_place, "record_id", "left"))
    same = checkpoint(same_views(rec, reg, vectors))
    right = reg.select("register_id", "account", "lot", "several", "place", "triple")
    left = rec.select("record_id", "tax_known", "tax", F.col("lot").alias("record_lot"), "place", "place_cosine", F.col("triple").alias("record_key"))

    def expand(view: str) -> DataFrame:
        if view == "address":
            both = left.where("place IS NOT NULL").join(right.drop("triple"), "place").withColumn("cosine", F.col("place_cosine"))
        else:
            keyed = left.where("record_key IS NOT NULL").drop("place").join(same, "record_key")
            both = keyed.join(right.drop("place").withColumnRenamed("triple", "register_key"), "register_key")
        return both.select("record_id", "register_id", "tax_known", "tax", "account", "record_lot", "lot", "several", F.lit(view).alias("view"), "cosine")

    each = expand("address").unionByName(expand("triple"))
    first = [F.first(c).alias(c) for c in ("tax_known", "tax", "account", "record_lot", "lot", "several")]
    by = [F.max(F.when(F.col("view") == v, F.col("cosine"))).alias(f"by_{v}") for v in ("address", "triple")]
    pairs = each.groupBy("record_id", "register_id").agg(*first, *by)
    at, lot, crowd_ = F.col("by_address").isNotNull(), F.col("record_lot"), F.col("several")
    flags = {
        "address_lot": at & crowd_ & (lot == F.col("lot")), "address_no_lot": at & crowd_ & ((lot == "") | (F.col("lot") == "")) & (lot != F.col("lot")),
        "address_other_lot": at & crowd_ & (lot != "") & (F.col("lot") != "") & (lot != F.col("lot")), "alone_other_lot": at & ~crowd_ & (lot != "") & (F.col("lot") != "") & (lot != F.col("lot")),
    }
    pairs = checkpoint(pairs.withColumns({k: v.cast("double") for k, v in flags.items()} | {f"by_{v}": F.coalesce(f"by_{v}", F.lit(0.0)) for v in ("address", "triple")}))
    # every pair with a known tax id is counted; cosines by their thousandths, so a few rows come back
    same_tax = (F.col("tax") == F.col("account")).cast("int").alias("y")
    flags_of = [F.round(c, 3).alias(c) for c in EVIDENCE]
    with short_plan_texts(pairs.sparkSession):
        known = pairs.where("tax_known AND length(tax) = 10").groupBy(*flags_of, same_tax).agg(F.count("*").alias("n")).where("y IS NOT NULL").collect()
    w = calibrate(np.array([[r[c] for c in EVIDENCE] for r in known]), np.array([float(r.y) for r in known]), np.array([float(r.n) for r in known])) if known else list(DEFAULT)
    z = reduce(lambda a, b: a + b, (F.col(c) * float(k) for c, k in zip(EVIDENCE, w, strict=False)), F.lit(float(w[-1])))
    whole = (F.col("by_triple") > 0) | (at_place() & (~crowd_ | (F.col("address_lot") == 1)))
    return pairs.select("register_id", "record_id", (1 / (1 + F.exp(-z))).alias("confidence"), F.greatest("by_address", "by_triple").alias("cosine"), "tax_known", whole.alias("evidence"))


def at_place() -> Column:
    return F.col("by_address") > 0


def found(register: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs (register_id, record_id) of records without tax id whose evidence is whole and whose confidence reaches ``ACCEPT``."""
    return match_records(register, records).where((~F.col("tax_known")) & F.col("evidence") & (F.col("confidence") >= ACCEPT)).select("register_id", "record_id")
