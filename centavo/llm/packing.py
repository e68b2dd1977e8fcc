"""Packing by cutting-stock column generation.

A document's ids (and an end id) are cut into full sequences and one rest. Rests are counted by length class (GRAIN
tokens); a linear program over patterns of classes covers these counts with the fewest sequences, a knapsack dynamic
program prices new patterns, patterns are rounded down and what is left is filled first-fit decreasing. Only the
histogram (CAPACITY / GRAIN counts) is on the driver. Documents are ranked within their class in two levels (salted
ranks plus offsets, so a class that holds most documents is spread), and a rank says pattern, copy and place.

Null and empty texts: the end id alone. Null ids and repeated rows are packed like any other row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, table
from .tokens import BYTE_BPE, encode_added, encoding

CAPACITY, GRAIN, END_ID = 2048, 8, 1
#: Pieces that one salt of a length class should hold, and salts at least.
SALT_ROWS, LEAST_SALTS = 100_000, 32
#: Simplex steps at most: more would only bring the bound nearer; any number gives a full packing.
MOST_STEPS = 400
#: The program stops within this share of the bound that total length sets.
GAP = 0.00001


def cut(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = BYTE_BPE, capacity: int = CAPACITY, with_ids: bool = False, added: bool = False) -> DataFrame:
    """A row a piece: full pieces first, then the rest; row numbers a task's documents, so that equal ones can be told apart. with_ids adds the ids themselves; added encodes the strings of added tokens as these tokens."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("row", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encode_added(vocabulary) if added else encoding(vocabulary).encode_ordinary, 0
        for batch in small_batches(batches, "text", 8 << 20):
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array(encode(text.as_py() or "") + [END_ID], "<u4")
                row += 1
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    for column, value in zip(out, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids), row, part), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(out, fields, strict=True)], schema=pa.schema(fields))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, ddl)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the items (counts by class) of most value within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = np.searchsorted(sizes, c, side="right")
        if n:
            worth = values[:n] + best[c - sizes[:n]]
            k = int(worth.argmax())
            if worth[k] > best[c - 1]:
                best[c], pick[c] = worth[k], k
                continue
        best[c], pick[c] = best[c - 1], -2
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
        else:
            c -= 1
    return best[capacity], counts


def first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First-fit decreasing in fractions: each pattern is used until one of its classes is used up, so the patterns are a triangular basis."""
    m, left = len(sizes), demand.copy()
    basis, x = np.diag((capacity // sizes).astype(float)), np.zeros(m)
    while (left > 0).any():
        pattern, room = np.zeros(m), capacity
        for k in np.flatnonzero(left > 0)[::-1]:
            pattern[k] = room // sizes[k]
            room -= int(pattern[k]) * int(sizes[k])
        held = np.flatnonzero(pattern)
        times = left[held] / pattern[held]
        k = held[times.argmin()]
        basis[:, k], x[k] = pattern, times.min()
        left -= x[k] * pattern
        left[left < 1e-9] = 0
        left[k] = 0
    return basis, x


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts by class) and how often each is used; together they cover the demand exactly."""
    m = len(sizes)
    if not m:
        return []
    eased = demand + 1e-3 * np.random.default_rng(0).random(m)  # breaks ties between patterns that leave the basis
    basis, x = first_basis(sizes, eased, capacity)
    inverse = np.linalg.inv(basis)
    material = sizes / capacity  # duals of the bound that no packing beats: steady centre for pricing
    bound = float(material @ demand)
    for step in range(MOST_STEPS):
        if step % 40 == 39:  # rounding errors of the updates
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ eased, 0)
        duals = inverse.sum(axis=0)
        if x.sum() <= bound * (1 + GAP):
            break
        for share in (0.9, 0.5, 0.0):
            _, column = best_pattern(share * material + (1 - share) * np.maximum(duals, 0), sizes, capacity)
            if duals @ column > 1 + 1e-7:
                break
        else:
            break
        way = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(x, way, out=ratio, where=way > 1e-5 * np.abs(way).max())
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * way, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
    used, left = [], demand.astype(np.int64).copy()
    for j in np.argsort(-x):
        pattern = basis[:, j].astype(np.int64)
        held = pattern > 0
        times = min(int(np.floor(x[j] + 1e-7)), int((left[held] // pattern[held]).min()))
        if times > 0:
            used.append((pattern, times))
            left -= pattern * times
    while left.any():  # first-fit decreasing over what rounding left
        pattern, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        used.append((pattern, times))
        left -= pattern * times
    return used


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset to the (staged) pieces of cut()."""
    spark = pieces.sparkSession
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    rest = rest.withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    counts = {r["bin"]: r["n"] for r in rest.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    sizes = np.array(sorted(counts), np.int64)
    used = solve(sizes, np.array([counts[s] for s in sizes.tolist()], float), capacity // grain)
    slots, at, sequence = [], dict.fromkeys(sizes.tolist(), 0), 0
    for pattern, times in used:
        for size, n in zip(sizes.tolist(), pattern.tolist(), strict=True):
            if n:
                slots.append((size, at[size], at[size] + n * times, n, sequence))
                at[size] += n * times
        sequence += times
    places = F.broadcast(spark.createDataFrame(slots, "bin int, lo long, hi long, per_copy long, base long"))
    salts = max(LEAST_SALTS, -(-sum(counts.values()) // SALT_ROWS))
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32", "row"), F.lit(salts)).cast("int"))
    before = rest.groupBy("bin", "salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("salt")) - F.col("n")).drop("n")
    ranked = rest.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "ids_crc32", "row"))).join(before, ["bin", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("before", "salt")
    placed = ranked.join(places, "bin").where("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("per_copy")))
    held = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(held), F.lit(0).cast("long")))
    whole = full.withColumn("sequence_id", F.lit(sequence).cast("long") + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(*pieces.columns, "sequence_id", "offset").unionByName(whole).drop("row")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, added: bool = False) -> DataFrame:
    return pack(stage(cut(docs, id_column, text_column, with_ids=with_ids, added=added), "pieces"))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the pieces of pack_documents(with_ids=True) in their places, padded to the capacity. A sequence holds at most capacity pieces."""
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return ordered.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size(ids))).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), added=True)
