"""Conversation prefix trie, rolled up by centroid decomposition.

Every distinct sequence of first turns (role, text) is a node. A turn is known by the SHA-256 of role and text and leaves its text behind at
once; a prefix is known by the exclusive or of its turns' hashes, each salted by its place: 128 bits, which blocks of BLOCK turns sum in two
levels, so that no task sees a whole long conversation. The ancestor of a node at any depth is one look-up: the prefix of its smallest
member at that depth.

Sums over subtrees come from a centroid decomposition of the forest of parent edges (the textless root is left out and added at the end). A
component above COMPONENT nodes is split in the cluster: the deepest node that holds half of it is found by counting descendants at eight depths
at a time, it is cut out, what hangs on it become components of their own, and the totals of these are added to the
nodes from the centroid up to the component's top. Smaller components go on in the same way inside tasks, packed to about COMPONENT nodes.
Every level halves the components, so a chain of n turns costs log n levels and not n.

Turns go by number, nulls first, ties by the SHA-256 of role and text; null role or text: empty. Rows without a conversation id belong to none and are left
out. Repeated rows are turns like others. No conversation: no node, not even the root. Other columns are not read. The hash over a node's ids is sequential by its
definition: ids of one node stream in order through one task, which holds a batch and the hash's state.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, numbered, stage, table

BLOCK, COMPONENT, TRIED = 4096, 50_000, 8
KEY = ["k1", "k2"]


def places(turns: DataFrame, held: Stages) -> tuple[DataFrame, DataFrame]:
    """(conv, place from 1, sign, chars, piece) of every turn, and the pieces of numbered()."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sign = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), sign.alias("sign"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie"))
    return numbered(rows.where("conv is not null"), ["conv"], ["turn", "sign", "tie"], "place", held)


def grafted(placed: DataFrame, pieces: DataFrame, held: Stages, hosts: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: the first h turns of conversation c - c % hosts, then c's own after its first h; h is crc32(c) % most.

    Returns (conv, place, sign, chars, last) and (conv, n), n turns a conversation. A host lends at most most - 1 turns to fewer than 2 * hosts others."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    convs = pieces.groupBy("conv").agg(F.max("total").alias("own")).withColumn("h", h).withColumn("host", F.col("conv") - F.col("conv") % hosts)
    lent = convs.join(convs.select(F.col("conv").alias("host"), F.col("own").alias("there")), "host", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0))))
    lent = held(lent.select("conv", "host", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "lent")
    kept = placed.join(pieces.select("conv", "piece").join(lent, "conv"), ["conv", "piece"]).where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("given"))
    first = placed.where((F.col("place") < most) & (F.col("conv") % hosts == 0)).select(F.col("conv").alias("host"), "place", "sign", "chars")
    begun = lent.where("given > 0").join(first, "host").where("place <= given")
    cols = ["conv", "place", "sign", "chars", (F.col("place") == F.col("n")).alias("last")]
    return kept.select(*cols).unionByName(begun.select(*cols)), lent.select("conv", "n")


def prefixes(turns: DataFrame, held: Stages) -> DataFrame:
    """(conv, place, chars, last; k1, k2: the prefix up to here, p1, p2: the one before, t1, t2: the first turn's)."""
    rows = turns.select("conv", "place", "chars", "last", F.floor((F.col("place") - 1) / BLOCK).alias("block"), *[F.xxhash64(F.lit(i), "place", "sign").alias(f"a{i}") for i in (1, 2)])
    rows = held(rows, "salted")
    blocks = rows.groupBy("conv", "block").agg(*[F.bit_xor(f"a{i}").alias(f"b{i}") for i in (1, 2)], *[F.max(F.when(F.col("place") == 1, F.col(f"a{i}"))).alias(f"t{i}") for i in (1, 2)])
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(f"b{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)], *[F.max(f"t{i}").over(whole).alias(f"t{i}") for i in (1, 2)])
    to_here = Window.partitionBy("conv", "block").orderBy("place")
    rows = rows.select("*", *[F.bit_xor(f"a{i}").over(to_here).alias(f"x{i}") for i in (1, 2)]).join(blocks, ["conv", "block"])
    key = lambda i: F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}"))
    return held(rows.select("conv", "place", "chars", "last", *[key(i).alias(f"k{i}") for i in (1, 2)], *[key(i).bitwiseXOR(F.col(f"a{i}")).alias(f"p{i}") for i in (1, 2)], "t1", "t2"), "prefixes")


def _sum_in_components(up: list[int], sums: list[list[int]]) -> None:
    """Subtree sums of a forest, in place. up: each node's parent, which comes before it, or -1; sums: lists of the nodes' own values."""
    own, up, todo = [list(s) for s in sums], list(up), range(len(up))
    while todo:
        size, top = dict.fromkeys(todo, 1), {}
        for v in reversed(todo):
            if up[v] >= 0:
                size[up[v]] += size[v]
        centre: dict[int, int] = {}
        for v in todo:  # parents first, so that the deepest node with half of its component comes last
            top[v] = top[up[v]] if up[v] >= 0 else v
            if 2 * size[v] >= size[top[v]]:
                centre[top[v]] = v
        above = {c: up[c] for c in centre.values()}
        hung: dict[int, int] = {}  # tops of the components below a centroid
        below: dict[int, int] = {}
        for v in todo:
            if up[v] in above:
                hung[v], up[v] = up[v], -1
                below[v] = v
            elif up[v] in below:
                below[v] = below[up[v]]
        for c in above:
            up[c] = -1
        for value, total in zip(own, sums, strict=True):
            held: dict[int, int] = {}
            for v, t in below.items():
                held[t] = held.get(t, 0) + value[v]
            part = dict.fromkeys(above, 0)
            for t, c in hung.items():
                part[c] += held[t]
            for c, x in part.items():
                total[c] += x
                x, v = x + value[c], above[c]
                while v >= 0:
                    total[v] += x
                    v = up[v]
        todo = [v for v in todo if v not in above]


def roll_up_here(part: pd.DataFrame) -> pd.DataFrame:
    """One task's components: (k1, k2, leaves, saved) over subtrees within them."""
    part = part.sort_values("depth", kind="stable")
    keys, group = list(zip(part["k1"], part["k2"], strict=True)), list(zip(part["c1"], part["c2"], strict=True))
    at = {k: i for i, k in enumerate(keys)}
    up = [at.get(p, -1) for p in zip(part["p1"], part["p2"], strict=True)]
    up = [p if p >= 0 and group[p] == group[i] else -1 for i, p in enumerate(up)]
    sums = [part["leaves"].tolist(), part["saved"].tolist()]
    _sum_in_components(up, sums)
    return pd.DataFrame({"k1": part["k1"].to_numpy(), "k2": part["k2"].to_numpy(), "leaves": np.array(sums[0], np.int64), "saved": np.array(sums[1], np.int64)})


def _centroids(live: DataFrame, big: DataFrame, paths: DataFrame, held: Stages) -> DataFrame:
    """(c1, c2, at, z1, z2): of each component the deepest node that holds at least half of it, and its depth."""
    state = big.select("c1", "c2", "n", "lo", "hi", F.col("c1").alias("z1"), F.col("c2").alias("z2"))
    while not state.where("hi - lo > 1").isEmpty():
        tried = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(TRIED)), lambda i: F.col("lo") + F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) * i / (TRIED + 1)))))
        state = state.withColumn("tried", F.when(F.col("hi") - F.col("lo") > 1, F.filter(tried, lambda x: x < F.col("hi"))).otherwise(F.array().cast("array<bigint>")))
        asked = live.join(state.select("c1", "c2", "n", F.explode("tried").alias("place")), ["c1", "c2"]).where("depth >= place").select("c1", "c2", "n", "place", "conv")
        found = asked.join(paths, ["conv", "place"]).groupBy("c1", "c2", "n", "place", *KEY).count().where("2 * count >= n")
        best = found.groupBy("c1", "c2").agg(F.max(F.struct("place", *KEY)).alias("best"))
        state = state.join(best, ["c1", "c2"], "left").select("c1", "c2", "n", F.coalesce("best.place", "lo").alias("lo"), "hi", F.coalesce("best.k1", "z1").alias("z1"), F.coalesce("best.k2", "z2").alias("z2"), "tried")
        state = held(state.withColumn("hi", F.coalesce(F.array_min(F.filter("tried", lambda x: x > F.col("lo"))), "hi")).drop("tried"), "search")
    return state.select("c1", "c2", F.col("lo").alias("at"), "z1", "z2")


def roll_up(forest: DataFrame, paths: DataFrame, held: Stages, most: int = COMPONENT) -> DataFrame:
    """(k1, k2, leaves, saved) summed over subtrees. forest: (k1, k2, p1, p2, c1, c2: component, by its top's key; conv, depth, leaves, saved); paths: (conv, place, k1, k2)."""
    ready, added, live = [], [], forest
    while True:
        sizes = live.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("depth").alias("lo"), (F.max("depth") + 1).alias("hi"))
        big = held(sizes.where(F.col("n") > most), "large")
        if big.isEmpty():
            ready.append(live)
            break
        ready.append(live.join(big, ["c1", "c2"], "left_anti"))
        live = live.join(big.select("c1", "c2"), ["c1", "c2"])
        centre = held(_centroids(live, big, paths, held), "centroids")
        rows = live.join(centre, ["c1", "c2"])
        for ahead in (0, 1):  # the ancestors at the centroid's depth and at the next
            there = paths.select("conv", (F.col("place") - ahead).alias("at"), F.col("k1").alias(f"q{ahead}"), F.col("k2").alias(f"r{ahead}"))
            rows = rows.join(there, ["conv", "at"], "left")
        under = (F.col("depth") >= F.col("at")) & (F.col("q0") == F.col("z1")) & (F.col("r0") == F.col("z2"))
        rows = held(rows.withColumn("under", F.coalesce(under, F.lit(False))), "cut")
        middle = F.col("depth") == F.col("at")
        below = rows.where(F.col("under") & ~middle).groupBy("c1", "c2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        core = rows.where(F.col("under") & middle).select("c1", "c2", "at", "conv", *KEY, F.col("leaves").alias("l"), F.col("saved").alias("s"))
        core = core.join(below, ["c1", "c2"], "left").na.fill(0, ["leaves", "saved"])
        way = core.join(big.select("c1", "c2", "lo"), ["c1", "c2"]).select("conv", "at", "lo", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"))
        way = way.join(paths, "conv").where("place >= lo and place < at").select(*KEY, "leaves", "saved")
        added.append(held(core.select(*KEY, "leaves", "saved").unionByName(way), "added"))
        new = [F.when(F.col("under") & middle, F.col(k)).when(F.col("under"), F.col(q)).otherwise(F.col(c)).alias(c) for k, q, c in (("k1", "q1", "c1"), ("k2", "r1", "c2"))]
        live = held(rows.select(*KEY, "p1", "p2", *new, "conv", "depth", "leaves", "saved"), "parts")
    rows = functools.reduce(DataFrame.unionByName, [x.select(*KEY, "p1", "p2", "c1", "c2", "depth", "leaves", "saved") for x in ready])
    bins = max(1, -(-forest.count() // most))
    here = rows.withColumn("bin", F.pmod(F.xxhash64("c1", "c2"), F.lit(bins))).groupBy("bin").applyInPandas(lambda part: roll_up_here(part), "k1 long, k2 long, leaves long, saved long")
    return functools.reduce(DataFrame.unionByName, [here, *added]).groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv) to (k1, k2, SHA-256 of the ids joined by commas)."""
    key, state, out = None, None, []
    done = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])
    for batch in batches:
        k1, k2, ids = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv"))
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(ids) else []
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            now, text = (int(k1[a]), int(k2[a])), ",".join(map(str, ids[a:b].tolist()))
            if now != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield done()
        out = []
    if key:
        out.append((*key, state.hexdigest()))
        yield done()


def trie(turns: DataFrame, convs: DataFrame, most: int = COMPONENT) -> DataFrame:
    """turns: (conv, place from 1 without gaps, sign, chars, last); convs: (conv, n turns). Returns the nodes, by the columns of the module's contract."""
    spark = turns.sparkSession
    with Stages(spark) as held:
        paths = prefixes(turns, held)
        first = lambda *names: [F.max(c).alias(c) for c in names]
        nodes = paths.groupBy(*KEY).agg(F.max("place").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *first("chars", "p1", "p2", "t1", "t2"))
        nodes = held(nodes, "nodes")
        children = nodes.groupBy("p1", "p2").agg(F.count("*").alias("n_children")).toDF(*KEY, "n_children")
        nodes = held(nodes.join(children, KEY, "left").na.fill(0, ["n_children"]), "forest")
        forest = nodes.select(*KEY, "p1", "p2", F.col("t1").alias("c1"), F.col("t2").alias("c2"), "conv", "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        sums = held(roll_up(forest, paths.select("conv", "place", *KEY), held, most), "sums")
        ends = paths.where("last").select(*KEY, "conv").unionByName(convs.where("n = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv"))
        ends = ends.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(hash_ids, "k1 long, k2 long, ends_sha256 string")
        least, n_convs = convs.agg(F.min("conv"), F.count("*")).first()
        tops = forest.where("depth = 1").select(*KEY).join(sums, KEY).agg(F.count("*"), F.sum("leaves"), F.sum("saved")).first()
        root = spark.createDataFrame([(0, 0, least, 0, None, n_convs, tops[0], tops[1] or 1, tops[2] or 0)] if n_convs else [], "k1 long, k2 long, conv long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
        above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
        rest = nodes.where("depth > 1").join(above, ["p1", "p2"]).unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long")))
        rest = rest.join(sums, KEY).select(*KEY, "conv", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        out = rest.unionByName(root).join(ends, KEY, "left").select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
        return stage(out, "trie")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Stages(spark) as held:
        placed, pieces = places(table(spark, sf_dir, "conversations"), held)
        return trie(*grafted(placed, pieces, held))


def _crc32(text: str) -> str:
    """crc32 of an ASCII text in SQL, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), {step}), 4294967295)"


ORACLE = f"""
with o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, ''))) as n,
 coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, count(*) as own, {_crc32("cast(conv_id as varchar)")} % 6 as h, conv_id - conv_id % 100 as host from o group by 1),
g as (select c.*, least(h, coalesce(k.n, 0)) as given from c left join (select conv_id, count(*) as n from o group by 1) k on k.conv_id = c.host),
r as (select g.conv_id, o.n as d, o.role, o.text from g join o on o.conv_id = g.host and o.n <= g.given
 union all select g.conv_id, o.n - h + given, o.role, o.text from g join o on o.conv_id = g.conv_id and o.n > h),
e as (select conv_id, max(d) as n from r group by 1),
k as (select conv_id, d, text, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' order by d) over (partition by conv_id order by d)) as k from r
 union all select conv_id, 0, '', '' from c),
v as (select k, any_value(d) as depth, min(k.conv_id) as conv_id, count(*) as n_convs, any_value(length(text)) as chars, coalesce(string_agg(case when d = coalesce(e.n, 0) then cast(k.conv_id as varchar) end, ',' order by k.conv_id), '') as ends
 from k left join e on e.conv_id = k.conv_id group by k),
p as (select v.*, u.k as pk, w.conv_id as parent_conv_id from v left join k u on u.conv_id = v.conv_id and u.d = v.depth - 1 left join v w on w.k = u.k),
n as (select pk as k, count(*) as n_children from p where pk is not null group by 1),
s as (select a.k, sum(case when n.k is null then 1 else 0 end) as n_leaves, sum((v.n_convs - 1) * v.chars) as saved_tokens from v join k a on a.conv_id = v.conv_id and a.d <= v.depth left join n on n.k = v.k group by 1)
select conv_id, cast(depth as bigint) as depth, parent_conv_id, n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(ends) as ends_sha256
from p left join n on n.k = p.k join s on s.k = p.k"""
