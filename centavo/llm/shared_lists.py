"""Hard-negative mining over lists that a cluster of anchors shares, with certified termination.

Anchors are clustered by direction (centroids from at most SAMPLE anchors). For each cluster all candidates are sorted once by the angular upper
bound norm * cos(max(angle to the centroid - the cluster's radius, 0)): times an anchor's norm, no score of the anchor with this or any
later candidate exceeds it. Every anchor walks its cluster's list, twice: first for its positives (the best of its
own label), then, for each positive, for the best of other labels whose scores lie in the window. An anchor leaves the walk when the bound of the
next candidate is below what could still change its answer. So results are exact; the order only decides how far a walk goes.

A list lies in segments of SEGMENT candidates, ranked by ranges of the bound. Rounds take 1, 2, 4, ... segments, each met in a task of its own by blocks of
about MEMBERS of the anchors still walking; a task's answers are the best few of each anchor, and
rounds grow as the logarithm of the list. Lists are narrow; vectors join a round's segments only. The number of lists is bounded (MOST_CLUSTERS).

Components become floor(SCALE * x); scores are exact integer inner products. Rows with a null id or label, a null vector or a null or non-finite component take no part, nor do
rows whose floored squares sum up to 2**53 or more (their scores are not exact). Vectors of different lengths have no score: each length is mined by itself. Zero vectors score 0. Repeated ids
are rows of their own (each an anchor, each a candidate of the other). An empty vector has no result. Ties go by id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, numbered, stage, table

SAMPLE, ROUNDS, MOST_CLUSTERS, A_CLUSTER = 8192, 8, 64, 48
SEGMENT, MEMBERS, AT_ONCE = 4096, 1024, 64
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
SLACK = 1e-9
RESULT = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, rid long, id long, score long"


def vectors(rows: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(rid, id, label, width, norm, q: the floored components as 32-bit integers) of the rows that take part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            flat, ends = batch.column("x").flatten().to_numpy(), np.r_[0, np.cumsum(width)]
            with np.errstate(over="ignore"):
                floored = np.floor(flat * SCALE)
                squares = np.array([np.dot(v, v) for v in (floored[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]) if len(width) else np.empty(0)
            fine = squares < 2.0**53
            packed = [floored[a:b].astype("<i4").tobytes() for a, b, f in zip(ends[:-1], ends[1:], fine, strict=True) if f]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(pa.array(fine)) for c in ("rid", "id", "label", "width")], pa.array(np.sqrt(squares[fine])), pa.array(packed, pa.binary())], names=["rid", "id", "label", "width", "norm", "q"])

    x = F.col(vector_column).cast("array<double>")
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), x.alias("x"))
    rows = rows.where("id is not null and label is not null and x is not null").where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    return rows.withColumn("width", F.size("x")).mapInArrow(pack, "rid long, id long, label long, width int, norm double, q binary")


def matrix(column: object, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), width).astype(np.float64)


def directions(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1)[:, None]
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def centroids(anchors: DataFrame, n: int, width: int) -> np.ndarray:
    """Directions of the clusters, by spherical k-means over a bounded sample of anchors."""
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = 2 * SAMPLE / max(n, 1)
    some = anchors.where(drawn < int(share * (1 << 30))) if share < 1 else anchors
    x = directions(matrix([r["q"] for r in some.where("norm > 0").orderBy(drawn, "id", "rid").limit(SAMPLE).select("q").collect()], width))
    if not len(x):
        return np.zeros((1, width))
    k = int(np.clip(n // A_CLUSTER, 1, min(MOST_CLUSTERS, len(x))))
    centre = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near, total = (x @ centre.T).argmax(axis=1), np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(np.linalg.norm(total, axis=1)[:, None] > 0, directions(total), centre)
    return centre


def top(score: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest scores that fit, the first columns on ties: row and column indices."""
    held = np.where(fits, score, -np.inf)
    if held.shape[1] > k:
        least = np.partition(held, -k, axis=1)[:, -k]
        fits = fits & (held >= least[:, None])
    row, col = np.nonzero(fits)
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _answers(list_: pd.DataFrame, members: pd.DataFrame, width: int, wanted: str) -> pd.DataFrame:
    """What the members of a block (a row an anchor, or an anchor and positive) find in one segment."""
    out = []
    if len(list_) and len(members):
        list_ = list_.sort_values(["id", "rid"], ignore_index=True)
        items, label, rid = matrix(list_["q"], width), list_["label"].to_numpy(), list_["rid"].to_numpy()
        for at in range(0, len(members), AT_ONCE):
            some = members.iloc[at : at + AT_ONCE]
            score = matrix(some["q"], width) @ items.T
            own = label[None, :] == some["label"].to_numpy()[:, None]
            if wanted == "positives":
                row, col = top(score, own & (rid[None, :] != some["anchor"].to_numpy()[:, None]), POSITIVES)
            else:
                base = some["positive_score"].to_numpy(np.float64)[:, None]
                row, col = top(score, ~own & (100 * score >= LOW * base) & (100 * score <= HIGH * base), NEGATIVES)
            found = some.iloc[row][["anchor", "anchor_id", "positive", "positive_id", "positive_score"]].reset_index(drop=True)
            out.append(found.assign(rid=rid[col], id=list_["id"].to_numpy()[col], score=score[row, col].astype(np.int64)))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in RESULT.split(", ")])


def _walk(walkers: DataFrame, lists: DataFrame, items: DataFrame, width: int, wanted: str, held: Stages) -> DataFrame:
    """walkers: (cluster, block, anchor, anchor_id, label, norm, q, positive, positive_id, positive_score). Returns the best found, by the columns of RESULT and rank."""
    keys, most = (["anchor"], POSITIVES) if wanted == "positives" else (["anchor", "positive"], NEGATIVES)
    best, start, size = None, 0, 1
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "rid")
    live = walkers
    while True:
        here = lists.where((F.col("segment") >= start) & (F.col("segment") < start + size))
        blocks = live.select("cluster", "block").distinct()
        left = here.join(blocks, "cluster").join(items.select("rid", "id", "label", "q"), "rid").select("cluster", "block", "segment", "rid", "id", "label", "q").toDF("cluster", "block", "segment", "rid", "id", "label", "q")
        right = live.join(here.select("cluster", "segment").distinct(), "cluster").select(*live.columns, "segment").toDF(*live.columns, "segment")
        pair = ["cluster", "block", "segment"]
        left, right = left.repartition(*pair), right.repartition(*pair)  # else a cluster could stay in the task of its join
        found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(lambda a, b: _answers(a, b, width, wanted), RESULT)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = held(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most), "best")
        start, size = start + size, size * 2
        ahead = lists.where(F.col("segment") == start).groupBy("cluster").agg(F.max("bound").alias("ahead"))
        known = best.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        bound = F.col("ahead") * F.col("norm") + SLACK * (1 + F.abs(F.col("ahead") * F.col("norm")))
        open_ = F.coalesce(F.col("n"), F.lit(0)) < most
        more = open_ if wanted == "positives" else open_ & (100 * bound >= LOW * F.col("positive_score"))
        live = held(live.join(ahead, "cluster").join(known, keys, "left").where(more | (~open_ & (bound >= F.col("least")))).drop("ahead", "n", "least"), "live")
        if live.isEmpty():
            return best


def _mine(good: DataFrame, width: int, anchor: object, held: Stages) -> DataFrame:
    spark = good.sparkSession
    anchors = held(good.where(anchor), "anchors")
    n = anchors.count()
    centre = centroids(anchors, n, width)

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cos = directions(matrix(batch.column("q").to_pylist(), width)) @ centre.T
                kinds = [pa.array(np.arccos(np.clip(c, -1, 1))) for c in cos.T]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(np.stack([k.to_numpy() for k in kinds], axis=1).tolist(), pa.list_(pa.float64()))], names=["rid", "angles"])

    near = lambda rows: rows.select("rid", "q").mapInArrow(angles, "rid long, angles array<double>")
    placed = near(anchors).select("rid", (F.array_position("angles", F.array_min("angles")) - 1).cast("int").alias("cluster"), F.array_min("angles").alias("off"))
    placed = held(anchors.join(placed, "rid"), "placed")
    stats = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("norm") > 0, F.col("off"))), F.lit(0.0)).alias("radius")).collect()  # one row a list
    shape = {r["cluster"]: (int(-(-r["n"] // MEMBERS)), float(r["radius"])) for r in stats}
    used = spark.createDataFrame([(c, *x) for c, x in shape.items()], "cluster int, blocks int, radius double")
    walkers = placed.join(F.broadcast(used), "cluster").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    none = F.lit(0).cast("long")
    walkers = held(walkers.select("cluster", "block", F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"), "label", "norm", "q", none.alias("positive"), none.alias("positive_id"), none.alias("positive_score")), "walkers")
    every = good.join(near(good), "rid").select("rid", "norm", F.posexplode("angles").alias("cluster", "angle")).join(F.broadcast(used.select("cluster", "radius")), "cluster")
    bound = F.col("norm") * F.cos(F.greatest(F.col("angle") - F.col("radius") - 1e-7, F.lit(0.0)))
    ranked, _ = numbered(every.select("cluster", "rid", bound.alias("bound"), (-bound).alias("low")), ["cluster"], ["low", "rid"], "place", held)
    lists = ranked.select("cluster", "rid", "bound", F.floor((F.col("place") - 1) / SEGMENT).alias("segment"))
    positives = _walk(walkers, lists, good, width, "positives", held)
    asked = positives.where("score >= 0").select("anchor", F.col("rid").alias("p"), F.col("id").alias("p_id"), F.col("score").alias("p_score"))  # below 0 the window is empty
    asked = held(walkers.drop("positive", "positive_id", "positive_score").join(asked, "anchor").withColumnsRenamed({"p": "positive", "p_id": "positive_id", "p_score": "positive_score"}), "asked")
    return stage(_walk(asked, lists, good, width, "negatives", held).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def mine(rows: DataFrame, anchor: object, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchor: a condition on id."""
    spark = rows.sparkSession
    with Stages(spark) as held:
        good = held(vectors(rows, id_column, vector_column, label_column), "vectors")
        widths = sorted(r["width"] for r in good.where(anchor).select("width").distinct().where("width > 0").collect())
        found = [_mine(good.where(F.col("width") == w), w, anchor, held) for w in widths]
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return functools.reduce(DataFrame.unionByName, found, empty) if not found else functools.reduce(DataFrame.unionByName, found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("id") % 100 == 0)


#: Every anchor with every row: for small tables, as a check.
ORACLE = f"""
with g as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(cast(embedding as double[]), lambda x: cast(floor({SCALE} * x) as bigint)) as q
 from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0 and len(embedding) > 0),
s as (select a.rid as a, a.vec_id as anchor_id, b.rid as b, b.vec_id, a.label = b.label as own, cast(list_dot_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score from g a join g b on a.rid <> b.rid and len(a.q) = len(b.q) where a.vec_id % 100 = 0),
p as (select * from s where own qualify row_number() over (partition by a order by score desc, vec_id, b) <= {POSITIVES}),
n as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.vec_id, s.b) as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
 from p join s on s.a = p.a and not s.own and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
