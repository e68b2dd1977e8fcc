"""Mixing sources to target weights by the cube method of balanced sampling.

Sources in code-point order (null last) weigh WEIGHTS, repeating, and share SHARE of all words; a target stops at MOST times its source's words and the
excess goes to the others by weight, until none is above. A document is taken floor(r) times, r = target / words of the source, and once more with
probability r - floor(r), its inclusion probability. Documents without words are never taken.

Flight: units of a source are dealt by a hash over blocks of about BLOCK. In a block, sorted by size, three neighbours at a time move their
probabilities along the null space of the two constraints (words, documents) until one of the three is 0 or 1; drawn so that
no probability changes in expectation. The LARGEST units of a block and a ladder of LADDER others, each about half as long as the one before,
do not fly: they and what is left of the flight (2 units) go to the next level, until a source has one block. Landing: its last units, 15 at most, are
rounded together so that its words and documents miss their totals least. With sizes from large to small among them, words come
within a few of a target whatever the source's size.

A unit is a row: rows equal in source, id and text are counted and numbered, not sorted, and a billion of them are dealt like others. All draws come
from hashes of ids, texts and levels: reruns agree whatever the partitioning. Null text: no words. Null id: a unit like others. No documents: an empty table.
Extra columns are not read. The number of sources may grow with the data: they are ranked in pieces, and their targets need one small aggregate
a round of resharing.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, numbered, stage, table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, LARGEST, LADDER, RUN = 20_000, 7, 6, 10_000
#: Words that a document too many or too few counts for in the landing.
A_DOCUMENT = 5
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def targets(sizes: DataFrame, held: Stages, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: (source, size), one row a source. Returns (sid, source, source_size, target)."""
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    ranked, _ = numbered(sizes.withColumn("all", F.lit(0)).withColumn("last", F.col("source").isNull()), ["all"], ["last", "source"], "rank", held)
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights)).cast("int"))
    rows = held(ranked.select((F.col("rank") - 1).alias("sid"), "source", "size", weight.cast("long").alias("weight")), "sources")
    unit, full = None, 0.0
    while True:  # words a weight; it only rises, and so do the sources at their stop
        at_stop = F.lit(False) if unit is None else F.col("weight") * unit >= F.col("size") * most
        rest, stopped = rows.agg(F.sum(F.when(~at_stop, F.col("weight"))), F.sum(F.when(at_stop, F.col("size")))).first()
        now = (total * share - most * (stopped or 0)) / rest if rest else full
        if unit is not None and now <= unit:
            break
        unit = now
    target = F.least(F.col("weight") * F.lit(float(unit)), (F.col("size") * most).cast("double"))
    return rows.select("sid", "source", F.col("size").alias("source_size"), target.alias("target"))


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The 0/1 choice of a few units whose words and number are nearest to what their probabilities promise."""
    pick = (np.arange(1 << len(size))[:, None] >> np.arange(len(size))) & 1
    off = np.abs(pick @ size - p @ size) + A_DOCUMENT * np.abs(pick.sum(axis=1) - p.sum())
    return pick[off.argmin()]


def held_back(size: np.ndarray) -> np.ndarray:
    """Which units (sorted by size) wait for the landing: the largest, then one of half the size, one of a quarter and so on."""
    n = len(size)
    out = np.arange(max(0, n - LARGEST), n)
    below = n - LARGEST
    for i in range(LADDER):
        below = min(below - 1, int(np.searchsorted(size, size[max(0, n - LARGEST)] / 2 ** (i + 1))))
        if below < 0:
            break
        out = np.append(out, below)
    return out


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p (units sorted by size) within the null space of (size, 1) until, but for those held back, at most 2 units are neither 0 nor 1."""
    p, free = p.copy(), np.ones(len(p), bool)
    free[held_back(size)] = False
    while True:
        p = np.where(p > 1 - EPS, 1.0, np.where(p < EPS, 0.0, p))
        live = np.flatnonzero(free & (p > 0) & (p < 1))
        if len(live) < 3:
            return p
        first = int(rng.integers(0, min(3, len(live) - 2)))  # else the same neighbours could meet again
        three = live[first : first + (len(live) - first) // 3 * 3].reshape(-1, 3)
        s = size[three]
        u = np.stack([s[:, 1] - s[:, 2], s[:, 2] - s[:, 0], s[:, 0] - s[:, 1]], axis=1)
        u[(u == 0).all(axis=1)] = (1.0, -1.0, 0.0)  # equal sizes: the null space is a plane
        u /= np.abs(u).max(axis=1)[:, None]
        q = p[three]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min(axis=1)
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min(axis=1)
        ahead = rng.random(len(q)) * (up + down) < down
        p[three] = np.clip(q + u * np.where(ahead, up, -down)[:, None], 0, 1)


def _fly_block(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["size", "draw", "at"], kind="stable", ignore_index=True)
    row = part.iloc[0]
    rng = np.random.default_rng([int(row["sid"]), int(row["block"]), int(row["level"])])
    size, p = part["size"].to_numpy(np.float64), part["p"].to_numpy(np.float64)
    out = fly(size, p, rng)
    if row["blocks"] == 1:
        some = np.flatnonzero((out > 0) & (out < 1))
        out[some] = land(size[some], out[some])
    return part.assign(p=out)[["sid", "unit", "at", "size", "draw", "p"]]


def sample(units: DataFrame, held: Stages) -> DataFrame:
    """units: (sid, unit, at, size, draw, p), p the inclusion probability. Returns (unit, at) of the units that are taken."""
    taken, level, kind = [], 0, "sid long, unit long, at long, size long, draw long, p double"
    while True:
        counts = units.groupBy("sid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = units.join(counts, "sid").withColumn("block", F.pmod(F.xxhash64("draw", "at", F.lit(level)), F.col("blocks")).cast("int")).withColumn("level", F.lit(level))
        dealt = dealt.repartition("sid", "block")  # else all blocks of a source would stay where its count was joined
        units = held(dealt.groupBy("sid", "block").applyInPandas(_fly_block, kind), "flown")
        taken.append(units.where("p = 1").select("unit", "at"))
        units = units.where("p > 0 and p < 1")
        level += 1
        if units.isEmpty():
            return functools.reduce(DataFrame.unionByName, taken)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_column: str = "doc_id") -> DataFrame:
    """A row a document: (doc_id, text_sha256, source, size, source_size, target, copies, taken); equal rows share their copies as evenly as can be."""
    spark = docs.sparkSession
    with Stages(spark) as held:
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("source").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.unhex(F.sha2(text, 256)).alias("sign"))
        groups = held(rows.groupBy("source", "doc_id", "size", "sign").agg(F.count("*").alias("n")).withColumn("unit", F.monotonically_increasing_id()), "groups")
        plan = held(targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")), held, weights, share, most), "targets")
        share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        of = plan.select("sid", F.col("source").alias("from"), "source_size", "target", F.floor(share_of).alias("whole"), (share_of - F.floor(share_of)).alias("p"))
        groups = held(groups.join(of, F.col("source").eqNullSafe(F.col("from"))).drop("from"), "weighed")
        drawn = groups.where((F.col("size") > 0) & (F.col("p") > EPS) & (F.col("p") < 1 - EPS)).select("sid", "unit", "size", "p", "n", F.xxhash64("doc_id", "sign").alias("draw"))
        runs = drawn.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).repartition("unit", "run")
        units = runs.withColumn("at", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))).select("sid", "unit", "at", "size", "draw", "p")
        more = sample(units, held).groupBy("unit").agg(F.count("*").alias("more"))
        nearly = F.when((F.col("p") >= 1 - EPS) & (F.col("size") > 0), F.col("n")).otherwise(0)
        each = groups.join(more, "unit", "left").withColumn("more", F.coalesce("more", nearly).cast("long"))
        kinds = F.array(F.struct(F.col("whole").alias("copies"), (F.col("n") - F.col("more")).alias("m")), F.struct((F.col("whole") + 1).alias("copies"), F.col("more").alias("m")))
        each = each.select("*", F.explode(kinds).alias("kind")).where("kind.m > 0").select("doc_id", "source", "size", "sign", "source_size", "target", F.when(F.col("size") > 0, F.col("kind.copies")).otherwise(0).cast("long").alias("copies"), F.col("kind.m").alias("m"))
        each = each.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / RUN)))).repartition("doc_id", "copies", "run")
        each = each.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col("m") - F.col("run") * RUN))))
        return stage(each.select("doc_id", F.lower(F.hex("sign")).alias("text_sha256"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")), "mixed")


def mixture(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as mix() takes it, with all its columns. Documents equal in id, source and text are one kind."""
    keys = ["doc_id", "source", "text_sha256"]
    times = mixed.groupBy(*keys).agg(F.sum("copies").alias("__times")).where("__times > 0")
    times = times.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("text_sha256").alias("__t"), "__times")
    once = docs.withColumn("__sign", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["doc_id", "source", "__sign"])
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__sign") == F.col("__t"))
    runs = once.join(times, same).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / RUN))))
    return runs.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col("__times") - F.col("__run") * RUN)))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
