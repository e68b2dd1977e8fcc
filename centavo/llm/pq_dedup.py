"""Embedding near-duplicates by product quantisation.

Vectors that lie within half the link angle of a leader form a ball: any two of its members are linked, so a large group of
near copies is counted without its pairs. Balls are formed in bounded blocks of the coarse lists. Ball leaders are indexed:
coarse inverted lists, the residual coded in SUBSPACES codes of CODES words. Every leader is compared with every list that can
hold a partner: lists are left out by exact bounds alone (distances from the list's centroid, the plane between two
centroids, the radii of the balls). Lists are dealt in blocks of about SEARCH_ROWS leaders, and two blocks meet once: blocks are written once, and the task in which
they meet reads them, so that no vector is copied or shuffled for a meeting, however many there are. In a block, asymmetric
distances from per-query tables discard what cannot be near even given the stored coding error, and the
true cosine in double precision decides. Two balls whose angle and radii settle all their members' pairs are
linked or dropped as wholes, and such links leave a block as counts and as a spanning forest, not as pairs; the rest are compared member by
member, in blocks too: a ball (at most about BLOCK_ROWS rows) against about COMPARE_ROWS members of the balls that it is open with.

Centroids and codebooks are fitted on at most SAMPLE vectors; all rows are indexed. Links are exactly the pairs with a cosine of at least LINK (recall 1):
where the bounds exclude no list (vectors without clusters), all leaders meet, in time that grows with the square of their number.

Null, zero and non-finite vectors link with nothing. Vectors of different lengths have no cosine: each length is searched by itself, with a model of
its own. Null ids pass through without a component. Repeated ids are vectors of their own. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, delete, new_path, stage, table
from .graph import components

LINK, SUBSPACES, CODES = 0.9, 8, 64
SAMPLE, MOST_LISTS, ROUNDS = 16384, 1024, 8
BLOCK_ROWS, SEARCH_ROWS, QUERY_BLOCKS, COMPARE_ROWS = 2048, 4096, 4, 8192
ANGLE = float(np.arccos(LINK))
EPS, SLACK = 1e-9, 1e-6
#: Rounding of single-precision sums of table entries; queries that share tables at a time.
SINGLE, TABLE_QUERIES = 1e-5, 64


def unit(column: pa.Array) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1)[:, None]


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centre)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[size > 0] = total[size > 0] / size[size > 0][:, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centre.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def fit(vectors: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Coarse centroids and residual codebooks from a bounded sample."""
    drawn = F.pmod(F.xxhash64("rid"), F.lit(1 << 30))
    share = 2 * SAMPLE / n  # tasks send what may be in the sample, not a sample each
    some = vectors.where(drawn < int(share * (1 << 30))) if share < 1 else vectors
    rows = some.orderBy(drawn, "rid").limit(SAMPLE).select("x").collect()
    x, rng = np.array([r["x"] for r in rows], np.float64), np.random.default_rng(5)
    x /= np.linalg.norm(x, axis=1)[:, None]
    coarse = kmeans(x, int(np.clip(round(n**0.5), 4, MOST_LISTS)), rng)
    rest = x - coarse[nearest(x, coarse)]
    return {"coarse": coarse, "books": [kmeans(part, CODES, rng) for part in np.array_split(rest, min(SUBSPACES, x.shape[1]), axis=1)]}


def encode(x: np.ndarray, lists: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the residuals and the norm of what they leave out."""
    rest = x - model["coarse"][lists]
    parts = np.array_split(rest, len(model["books"]), axis=1)
    codes = np.stack([nearest(p, b) for p, b in zip(parts, model["books"], strict=True)], axis=1)
    left = sum(((p - b[c]) ** 2).sum(axis=1) for p, b, c in zip(parts, model["books"], codes.T, strict=True))
    return codes, np.sqrt(left)


def balls(block: pd.DataFrame) -> pd.DataFrame:
    """Leaders of one bounded block and their members' angles."""
    block = block.sort_values("rid", kind="stable")
    x = unit(block["x"])
    free, leader, angle = np.ones(len(x), bool), np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(len(x)):
        if free[i]:
            members = np.flatnonzero(free)
            cos = np.clip(x[members] @ x[i], -1, 1)
            close = (cos >= np.cos(ANGLE / 2 - 1e-6)) | (members == i)
            members = members[close]
            leader[members], angle[members], free[members] = i, np.arccos(cos[close]), False
            angle[i] = 0
    rid = block["rid"].to_numpy()
    return pd.DataFrame({"rid": rid, "vec_id": block["vec_id"].to_numpy(), "list": block["list"].to_numpy(), "ball": rid[leader], "angle": angle, "x": block["x"].to_numpy()})


def join_trees(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots of a forest (root[root] is root) after the edges i, j joined its trees."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def reachable(x: np.ndarray, own: np.ndarray, radius: np.ndarray, coarse: np.ndarray, gaps: np.ndarray, stats: dict[str, np.ndarray]) -> np.ndarray:
    """Which lists can hold a leader whose ball has a link with the ball of x (of list own): no list with one is left out."""
    square = np.maximum(1 + (coarse * coarse).sum(axis=1) - 2 * x @ coarse.T, 0)
    far = np.sqrt(square)
    least = np.maximum(far - stats["most"], stats["least"] - far)
    gap = gaps[own]
    plane = np.divide(square - square[np.arange(len(x)), own][:, None], 2 * gap, out=np.zeros_like(square), where=gap > SLACK)
    chord = 2 * np.sin(np.minimum(ANGLE + radius[:, None] + stats["radius"], np.pi) / 2)
    return (np.maximum(least, plane) <= chord + SLACK) & (stats["size"] > 0)


def search(model: dict) -> object:
    """Step: a block of indexed leaders against queries. Rows: (0, ball, null, links of each member), (1, id, id: an edge of a component), (2, ball, ball, their angle in micro-radians: to compare by members)."""

    def run(key: tuple, indexed: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [np.empty((0, 4), np.int64)]
        if len(indexed) and len(queries):
            x, q = unit(indexed["x"]), unit(queries["x"])
            lists, n = indexed["list"].to_numpy(), len(x)
            codes, error = encode(x, lists, model)
            near = model["coarse"][lists] + np.concatenate([b[c] for b, c in zip(model["books"], codes.T, strict=True)], axis=1)
            norm = (near * near).sum(axis=1)
            side = lambda name: (indexed[name].to_numpy(), queries[name].to_numpy())
            (ids, other), (radius, reach), (size, others), (named, known) = side("ball"), side("radius"), side("size"), side("named")
            here = queries["own"].to_numpy() == int(key[0])
            links, theirs, root = np.zeros(n, np.int64), np.zeros(len(q), np.int64), np.arange(n + len(q))
            coarse, books = model["coarse"].astype(np.float32), [b.astype(np.float32) for b in model["books"]]
            held = np.empty((n, TABLE_QUERIES), np.float32)
            for at in range(0, len(q), TABLE_QUERIES):
                part, r = q[at : at + TABLE_QUERIES], reach[at : at + TABLE_QUERIES, None]
                # Tables by code and query: a leader's codes pick whole rows, for all queries at once. Leaders run down, queries across.
                flat = part.T.astype(np.float32)
                dot, buffer = np.take(coarse @ flat, lists, axis=0), held[:, : len(part)]
                for p, book, code in zip(np.array_split(flat, len(books)), books, codes.T, strict=True):
                    dot += np.take(book @ p, code, axis=0, out=buffer if buffer.flags.c_contiguous else None, mode="clip")
                widest = r.max()  # the bound of the widest ball of the queries; the true one decides below
                chord = 2 * (np.sin((ANGLE + widest) / 2) * np.cos(radius / 2) + np.cos((ANGLE + widest) / 2) * np.sin(radius / 2))
                least_dot = (1 + norm - (np.where(ANGLE + widest + radius >= np.pi, 2, chord) + error + SLACK) ** 2) / 2 - SINGLE
                close = dot >= least_dot[:, None]
                mine = here[at : at + TABLE_QUERIES]
                if mine.any():
                    close &= ~mine | (other[at : at + TABLE_QUERIES] < ids[:, None])
                j, i = np.nonzero(close)
                if not len(i):
                    continue
                some = np.flatnonzero(close.any(axis=1))
                cos = np.zeros((len(part), n))
                cos[:, some] = part @ x[some].T
                keep = cos[i, j] >= np.cos(ANGLE + r[i, 0] + radius[j]) - EPS
                i, j = i[keep], j[keep]
                cos = cos[i, j]
                edge = np.flatnonzero(np.abs(cos - LINK) < EPS)  # the same sum for either order
                cos[edge] = np.einsum("ij,ij->i", part[i[edge]], x[j[edge]])
                angle, both = np.arccos(np.clip(cos, -1, 1)), r[i, 0] + radius[j]
                i = i + at
                single = (others[i] == 1) & (size[j] == 1)
                whole = np.where(single, cos >= LINK, angle + both < ANGLE - 1e-6)
                undecided = ~single & ~whole & (angle - both <= ANGLE + 1e-6)
                out.append(np.stack([np.full(undecided.sum(), 2), other[i[undecided]], ids[j[undecided]], (angle[undecided] * 1e6).astype(np.int64)], axis=1))
                i, j = i[whole], j[whole]
                np.add.at(links, j, others[i])
                np.add.at(theirs, i, size[j])
                keep = named[j] & known[i]
                root = join_trees(root, j[keep], n + i[keep])
            least = np.concatenate(side("least"))
            tied = np.flatnonzero(root != np.arange(len(root)))
            out.append(np.stack([np.ones(len(tied), np.int64), least[tied], least[root[tied]], np.zeros(len(tied), np.int64)], axis=1))
            for balls_, count in ((ids, links), (other, theirs)):
                out.append(np.stack([np.zeros((count > 0).sum(), np.int64), balls_[count > 0], np.zeros((count > 0).sum(), np.int64), count[count > 0]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["kind", "a", "b", "n"])

    return run


def read_block(root: str, block: int) -> pd.DataFrame:
    """The leaders of a block that was written in a folder of its own."""
    store, at = fs.FileSystem.from_uri(root)
    files = [f.path for f in store.get_file_info(fs.FileSelector(f"{at}/own={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
    parts = []
    for path in files:
        with store.open_input_file(path) as source:
            parts.append(pq.ParquetFile(source).read().to_pandas())
    return pd.concat(parts, ignore_index=True).assign(own=block) if parts else pd.DataFrame()


def meetings(root: str, model: dict) -> object:
    """Step: rows (block, from) to what search() finds between a block and those leaders of the blocks of from that ask it. A task holds one block and QUERY_BLOCKS others at a time."""
    kinds = pa.schema([(c, pa.int64()) for c in ("kind", "a", "b", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet, last, others = search(model), None, None
        for batch in batches:
            for block, group in zip(batch.column("block").to_pylist(), batch.column("from").to_pylist(), strict=True):
                if group != last:
                    parts = [x for i in range(QUERY_BLOCKS) if len(x := read_block(root, group * QUERY_BLOCKS + i))]
                    last, others = group, pd.concat(parts, ignore_index=True)
                    bits = np.unpackbits(np.stack([np.frombuffer(a, np.uint8) for a in others["asks"]]), axis=1)
                found = meet((block, group), read_block(root, block), others[bits[:, block] == 1].reset_index(drop=True))
                yield from pa.Table.from_pandas(found, kinds, preserve_index=False).to_batches()

    return run


def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Cogrouped step: a ball's members against members of balls. Rows: (0, row id, null, its links), (1, ball, ball: linked)."""
    out = [np.empty((0, 4), np.int64)]
    if len(left) and len(right):
        x, y = unit(left["x"]), unit(right["x"])
        balls_, mine, theirs = right["b"].to_numpy(), np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for at in range(0, len(x), 256):
            cos = x[at : at + 256] @ y.T
            i, j = np.nonzero(np.abs(cos - LINK) < EPS)
            cos[i, j] = np.einsum("ij,ij->i", x[at + i], y[j])  # the same sum for either order
            near = cos >= LINK
            mine[at : at + 256] += near.sum(axis=1)
            theirs += near.sum(axis=0)
        for ids, count in ((left["rid"].to_numpy(), mine), (right["rid"].to_numpy(), theirs)):
            some = count > 0
            out.append(np.stack([np.zeros(some.sum(), np.int64), ids[some], np.zeros(some.sum(), np.int64), count[some]], axis=1))
        linked = np.unique(balls_[theirs > 0])
        out.append(np.stack([np.ones(len(linked), np.int64), np.full(len(linked), int(key[0])), linked, np.zeros(len(linked), np.int64)], axis=1))
    return pd.DataFrame(np.concatenate(out), columns=["kind", "a", "b", "n"])


def near_duplicates(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) a vector, of all vectors."""
    rows = stage(rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x")), "vectors")
    fine = F.coalesce(F.size("x") > 0, F.lit(False)) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    good = rows.where(fine)
    out = rows.select("rid", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    widths = sorted((r["w"], r["count"]) for r in good.groupBy(F.size("x").alias("w")).count().collect() if r["count"] > 1)
    if widths:
        largest = F.get(F.transform(F.array(F.array_max(F.transform("x", F.abs))), lambda m: F.transform("x", lambda v: v / m)), F.lit(0))  # bound once a vector
        known = [_links(good.where(F.size("x") == w).select("rid", "vec_id", largest.alias("x")), n) for w, n in widths]
        out = rows.select("rid", "vec_id").join(functools.reduce(DataFrame.unionByName, known), "rid", "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.select("vec_id", "n_links", "component_id")


def _links(good: DataFrame, n: int) -> DataFrame:
    """(rid, n_links, component) of n vectors of one length."""
    spark = good.sparkSession
    model = fit(good, n)
    n_lists = len(model["coarse"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest(unit(batch.column("x").to_pylist()), model["coarse"])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rid", "vec_id", "x")], pa.array(near, pa.int32())], names=["rid", "vec_id", "x", "list"])

    placed = stage(good.mapInArrow(place, "rid long, vec_id long, x array<double>, list int"), "placed")

    def salts(df: DataFrame, size: int) -> DataFrame:
        """(list, n): in how many blocks of about that size a list is dealt; one row a list, MOST_LISTS at most."""
        return F.broadcast(df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias("n")))

    def dealt(df: DataFrame, by: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(by, "list").withColumn(name, F.pmod(F.xxhash64(key), F.col("n")).cast("int")).drop("n")

    members = stage(dealt(placed, salts(placed, BLOCK_ROWS), "rid", "salt").groupBy("list", "salt").applyInPandas(balls, "rid long, vec_id long, list int, ball long, angle double, x array<double>"), "members")
    sizes = members.groupBy("ball").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("vec_id").alias("least"))
    leaders = members.where("rid = ball").select("ball", "list", "x").join(sizes, "ball")

    def offset(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                off = np.linalg.norm(unit(batch.column("x").to_pylist()) - model["coarse"][batch.column("list").to_numpy()], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(off)], names=[*batch.schema.names, "off"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaders.schema.fields)
    leaders = stage(leaders.mapInArrow(offset, kinds + ", off double"), "leaders")
    stats = {"size": np.zeros(n_lists, np.int64), **{k: np.zeros(n_lists) for k in ("radius", "least", "most")}}
    for r in leaders.groupBy("list").agg(F.count("*").alias("n"), F.max("radius"), F.min("off"), F.max("off")).collect():
        for name, value in zip(stats, r[1:], strict=True):
            stats[name][r["list"]] = value

    # Lists side by side along their main direction fill blocks; a list that is larger than a block gets several.
    mean = model["coarse"] - model["coarse"].mean(axis=0)
    blocks, last, room = {}, -1, 0
    for which in np.argsort(mean @ np.linalg.svd(mean, full_matrices=False)[2][0], kind="stable").tolist():
        size = int(stats["size"][which])
        parts = -(-size // SEARCH_ROWS)
        if parts == 1:
            if size > room:
                last, room = last + 1, SEARCH_ROWS
            blocks[which], room = (last, 1), room - size
        elif parts:
            blocks[which], last, room = (last + 1, parts), last + parts, 0
    held_in = np.zeros((n_lists, last + 1), np.float32)
    for which, (first, parts) in blocks.items():
        held_in[which, first : first + parts] = 1
    at = F.broadcast(spark.createDataFrame([(which, *x) for which, x in blocks.items()], "list int, first int, parts int"))
    ready = leaders.join(at, "list").select("list", "ball", "radius", "size", F.coalesce("least", F.lit(0)).alias("least"), F.col("least").isNotNull().alias("named"), "x", (F.col("first") + F.pmod(F.xxhash64("ball"), F.col("parts"))).cast("int").alias("own"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = np.stack([np.linalg.norm(model["coarse"] - c, axis=1) for c in model["coarse"]])
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 1024):
                batch = whole_batch.slice(start, 1024)
                own = batch.column("own").to_numpy()
                lists = reachable(unit(batch.column("x").to_pylist()), batch.column("list").to_numpy(), batch.column("radius").to_numpy(), model["coarse"], gaps, stats)
                bits = np.packbits((lists.astype(np.float32) @ held_in > 0) & (np.arange(last + 1) >= own[:, None]), axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary())], names=[*batch.schema.names, "asks"])

    # Which blocks each leader asks, a bit a block, goes with the leader; a block is written once, in a folder of its own.
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields)
    root = new_path(spark, "blocks")
    ready.repartition("own").mapInArrow(probe, kinds + ", asks binary").write.option("compression", "zstd").partitionBy("own").parquet(root)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("own").to_numpy()
                asked = np.unpackbits(np.stack([np.frombuffer(a, np.uint8) for a in batch.column("asks").to_pylist()]), axis=1)
                for group in np.unique(own // QUERY_BLOCKS):
                    block = np.flatnonzero(asked[own // QUERY_BLOCKS == group].any(axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(np.full(len(block), group), pa.int32())], names=["block", "from"])

    asks = stage(spark.read.schema("asks binary, own int").parquet(root).mapInArrow(pairs, "block int, from int").distinct(), "asks")
    tasks = min((last + 1) * (last // QUERY_BLOCKS + 1), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism))
    dealt_pairs = asks.repartition(tasks, "block", "from").sortWithinPartitions("from", "block")
    found = stage(dealt_pairs.mapInArrow(meetings(root, model), "kind long, a long, b long, n long"), "found")
    delete(spark, root)
    with Stages(spark) as held:
        size = leaders.select(F.col("ball").alias("b"), "size")
        open_ = found.where("kind = 2").select("a", "b", (F.col("n") / 1e6).alias("apart"))
        chunks = open_.join(size, "b").groupBy("a").agg(F.ceil(F.sum("size") / COMPARE_ROWS).cast("int").alias("chunks"))
        open_ = held(open_.join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")).drop("chunks"), "open")
        left = open_.select("a", "chunk").distinct().join(members.select(F.col("ball").alias("a"), "rid", "x"), "a")
        right = open_.join(leaders.select(F.col("ball").alias("a"), "radius"), "a").join(members.select(F.col("ball").alias("b"), "rid", "angle", "x"), "b")
        right = right.where(F.col("apart") - F.col("angle") - F.col("radius") <= ANGLE + 4e-6).select("a", "chunk", "b", "rid", "x").toDF("a", "chunk", "b", "rid", "x")
        between = stage(left.groupBy("a", "chunk").cogroup(right.groupBy("a", "chunk")).applyInPandas(compare, "kind long, a long, b long, n long"), "member-links")
        least = lambda c: leaders.select(F.col("ball").alias(c), F.col("least").alias(f"l{c}"))
        tied = between.where("kind = 1").select("a", "b").join(least("a"), "a").join(least("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        edges = found.where("kind = 1").select("a", "b").unionByName(tied).where("a is not null and b is not null")
        comps = held.keep(components(edges, held))
    by_ball = found.where("kind = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("far"))
    by_row = between.where("kind = 0").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("some"))
    by_leader = leaders.select("ball", "size", "least").join(by_ball, "ball", "left").join(comps, F.col("least") == F.col("id"), "left").select("ball", "size", "far", F.coalesce("component", "least").alias("component"))
    return members.select("rid", "ball").join(by_leader, "ball").join(by_row, "rid", "left").select("rid", (F.col("size") - 1 + F.coalesce("far", F.lit(0)) + F.coalesce("some", F.lit(0))).alias("n_links"), "component")


#: All pairs and reachable ids: for small tables, as a check.
ORACLE = f"""
with recursive g as (select vec_id, cast(embedding as double[]) as x from embeddings),
v as (select vec_id, x from g where len(x) > 0 and len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0 and list_max(list_transform(x, lambda e: abs(e))) > 0),
l as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= {LINK}),
r as (select vec_id as id, vec_id as reached from g union select r.id, l.v from r join l on l.u = r.reached),
m as (select id, min(reached) as component_id from r group by 1)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from g join m on m.id = vec_id left join (select u, count(*) as n from l group by 1) k on k.u = vec_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
