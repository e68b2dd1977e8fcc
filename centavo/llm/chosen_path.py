"""MinHash near-duplicates by a chosen-path set similarity join.

Every text becomes its set of distinct shingles and a sketch of N_HASHES minwise values (16 bits each, and 4 bits each to
estimate with). Equal sets collapse to one class (smallest id). Each of TREES independent trees branches a class by minwise
tokens that the node's own hash selects: one token, and a second at one node in four (1.25 in expectation, the inverse of the
similarity, so a similar pair is expected to share a branch at every level). Root nodes of at most SMALL classes are compared
exhaustively; larger ones yield pairs with two pivots (linear). Best estimates are confirmed first, which makes a large group of
near copies one component.

Pairs of one component need no comparison any more. A larger node is finished as soon as at most SMALL of its members lie
outside its largest component: these meet all others of the node, in blocks of BLOCK rows, and the members of the component never
meet one another. An outsider hands on its best partner in the component alone; if that pair fails and others are possible, the
outsider meets all members of the component on full sets, in blocks of CHUNK by MEMBERS, up to its first link: near misses of a large group
never become a table of pairs. Only nodes of many components branch on, each level by another token. What is left after DEPTH levels is compared
across components exhaustively, in blocks, without a cap: branching at 1.25 is critical for a pair at 80 %, which
more trees lose with every level. There too a member hands on its best partner alone; members that have more form groups (those of one
node belong together), which are compared on full sets, once for all trees, in blocks of CHUNK by CHUNK.

Links are confirmed on full sets. Sketches only discard pairs whose estimate is under EST (five standard deviations under
80 %). Components are exact once every pair between different components is found. A pair at exactly 80 % is computed to miss all
trees with probability 5.5e-8 at level 2 and, averaged over the sketch values that the trees share, 1.6e-4 at level 4, the deepest.

Null or wordless texts: empty set, linked with nothing, a component each. Null ids: kept, in the component of an equal set, else null.
Repeated ids count as one document that has either set. Repeated rows pass through. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, small_batches, stage, table
from .graph import components

N_HASHES, TREES, DEPTH, SMALL, EST, BLOCK = 96, 12, 4, 32, 0.60, 2048
CHUNK, MEMBERS = 256, 1024
#: Bits of the filter that leaves texts without a candidate at home: a broadcast of 4 MB, whatever the input.
FILTER_BITS = 1 << 25
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(1, 2**63, N_HASHES, dtype=np.uint64)
_ODD = _RNG.integers(1, 2**63, N_HASHES, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 200_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; remembers words' hashes."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: white space and case of ASCII alone
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minwise values."""
    best = np.full(N_HASHES, 2**32 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = (hashes[at : at + 1024, None] ^ _XOR) * _ODD
        best = np.minimum(best, (part >> np.uint64(32)).min(axis=0))
    return best.astype("<u2")


def nibbles(sig: np.ndarray) -> bytes:
    """Four bits of each value."""
    low = (sig & 15).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


#: Fewest equal nibbles of a pair at EST: unequal values agree in one of sixteen.
_FEWEST = round((EST + (1 - EST) / 16) * N_HASHES)


def similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sketches (rows of nibbles) and set sizes allow the similarity; equal nibbles."""
    apart = x ^ y
    equal = ((apart & 15) == 0).sum(axis=1) + ((apart & 240) == 0).sum(axis=1)
    return (equal >= _FEWEST) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)), equal


def sketch(docs: DataFrame, id_column: str, text_column: str, k: int) -> DataFrame:
    """(id, n_shingles, digest, sig, bits) a document."""
    out = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch in small_batches(batches, "text", 16 << 20):
            sizes, digests, sigs, bits = [], [], [], []
            for text in batch.column("text"):
                s = shingle(text.as_py())
                sig = minwise(s) if len(s) else None
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(sig.tobytes() if len(s) else None)
                bits.append(nibbles(sig) if len(s) else None)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_shingles": sizes, "digest": digests, "sig": sigs, "bits": bits}, schema=out)

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, n_shingles long, digest binary, sig binary, bits binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def wanted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts whose id is in a pair, and few others: a filter of fixed size goes to the texts, so that most need no shuffle."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    marks = pairs.select(F.explode(F.array(at("a"), at("b"))).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    bit = F.bitmap_bit_position(at("id"))
    byte = F.conv(F.hex(F.substring("map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return texts.join(F.broadcast(marks), F.bitmap_bucket_number(at("id")) == F.col("bucket")).where(marked).select("id", "text")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the similarity. The two texts meet in one row, so a hot side can be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, mine = Shingler(k), None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if x != last:
                    last, mine = x, shingle(x)
                other = shingle(y)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = wanted(docs, pairs)
    joined = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def _token(at: F.Column) -> F.Column:
    return F.substring("sig", 2 * at + 1, F.lit(2))


def _children(node: F.Column | None) -> F.Column:
    """Keys of the children: tokens selected by the node's own hash; of the roots (None), by the tree."""
    if node is None:
        picks = [(t, i) for t in range(TREES) for i in range(1 + (t % 4 == 3))]
        return F.array(*[F.xxhash64(F.lit(t), F.lit(i), _token(F.lit((5 * t + i) % N_HASHES))) for t, i in picks])
    pick = lambda i: F.pmod(F.xxhash64(node, F.lit(i)), F.lit(N_HASHES)).cast("int")
    one, two = (F.xxhash64(node, pick(i), _token(pick(i))) for i in (0, 1))
    return F.when(F.pmod(F.xxhash64(node, F.lit(2)), F.lit(4)) == 0, F.array_distinct(F.array(one, two))).otherwise(F.array(one))


_PAIRS = "a long, b long, est int"
_PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("est", pa.int32())])


def _pairs_of_small(members: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b, est) across the components of nodes with at most SMALL members (node, id, comp, n, bits), as far as sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            node, ids, comp, n = (t.column(c).to_numpy() for c in ("node", "id", "comp", "n"))
            bits, found = _matrix(t.column("bits"), N_HASHES // 2), [np.empty((0, 3), np.int64)]
            for d in range(1, min(SMALL, len(node))):  # rows are sorted: a node's pairs lie less than SMALL rows apart
                i = np.flatnonzero((node[:-d] == node[d:]) & (comp[:-d] != comp[d:]))
                for at in range(0, len(i), 65536):
                    p = i[at : at + 65536]
                    fits, equal = similar(bits[p], bits[p + d], n[p], n[p + d], percent)
                    p = p[fits]
                    found.append(np.stack([np.minimum(ids[p], ids[p + d]), np.maximum(ids[p], ids[p + d]), equal[fits]], axis=1))
            a, b, est = np.concatenate(found).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(est.astype(np.int32))], schema=_PAIR_SCHEMA)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            if len(t):
                node = t.column("node").to_numpy()
                whole = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
                left = t.slice(whole)
                yield pairs(t.slice(0, whole))
        if left is not None:
            yield pairs(left)

    return members.select("node", "id", "comp", "n", "bits").repartition("node").sortWithinPartitions("node", "id").mapInArrow(run, _PAIRS)


_FOUND = pa.schema([*_PAIR_SCHEMA, ("x", pa.int64()), ("top", pa.int64()), ("node", pa.int64())])


def _pairs_of_large(members: DataFrame, percent: int) -> DataFrame:
    """The same for larger nodes, of (node, top, tops, others, id, comp, n, bits), but only the best partner of each member outside the largest component. If
    there are more, x says whose they are, and top (its partners lie in the largest component) or node (they do not) where to look for them.

    Rows of a node's largest component are dealt in blocks of their own, which never meet one another."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        block = t.column("block").to_numpy()
        lo, hi = key[1].as_py(), key[2].as_py()
        sides = []
        for which in (lo, hi):
            part = t.filter(pa.array(block == which))
            sides.append((*(part.column(c).to_numpy() for c in ("id", "comp", "n")), _matrix(part.column("bits"), N_HASHES // 2)))
        (ids, comp, n, bits), (others, theirs, m, y) = sides
        top, inside = t.column("top")[0].as_py(), hi >= -(-t.column("others")[0].as_py() // BLOCK)
        ways, most, which = np.zeros(len(others), np.int64), np.zeros(len(others), np.int64), np.zeros(len(others), np.int64)
        out: list[tuple] = []

        def tell(x: int, other: int, equal: int, more: bool) -> None:
            out.append((min(x, other), max(x, other), equal, x if more else None, top if more and inside else None, key[0].as_py() if more and not inside else None))

        for i in range(len(ids)):
            j = np.flatnonzero(comp[i] != theirs)
            fits, equal = similar(bits[i][None], y[j], n[i], m[j], percent)
            j, equal = j[fits], equal[fits]
            if len(j):
                best = equal.argmax()
                tell(int(ids[i]), int(others[j[best]]), int(equal[best]), len(j) > 1)
                if not inside and lo != hi:
                    better = j[equal > most[j]]
                    most[better], which[better] = equal[equal > most[j]], ids[i]
                    ways[j] += 1
        for j in np.flatnonzero(ways).tolist():
            tell(int(others[j]), int(which[j]), int(most[j]), bool(ways[j] > 1))
        return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_FOUND)], schema=_FOUND)

    top = F.col("comp") == F.col("top")
    other, same = F.ceil(F.col("others") / BLOCK).cast("int"), F.ceil(F.col("tops") / BLOCK).cast("int")
    block = F.when(top, other + F.pmod(F.xxhash64("id"), same)).otherwise(F.pmod(F.xxhash64("id"), other)).cast("int")
    meets = F.sequence(F.lit(0), F.when(top, other).otherwise(other + same) - 1)
    rows = members.select("node", "id", "comp", "top", "others", "n", "bits", block.alias("block"), F.explode(meets).alias("with"))
    return rows.groupBy("node", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi")).applyInArrow(run, _PAIRS + ", x long, top long, node long")


def _against_components(ask: DataFrame, comps: DataFrame, narrow: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """ask: (x, comp). One link (a, b) of x with a member of the component, if there is any."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shingle, sets, found = Shingler(k), {}, []
        if len(left) and len(right):
            ids, n, bits, text = right.column("id").to_numpy(), right.column("n").to_numpy(), _matrix(right.column("bits"), N_HASHES // 2), right.column("text")
            for x, size, sketch_, said in zip(left.column("id").to_pylist(), left.column("n").to_pylist(), _matrix(left.column("bits"), N_HASHES // 2), left.column("text").to_pylist(), strict=True):
                fits, equal = similar(sketch_[None], bits, size, n, percent)
                j = np.flatnonzero(fits)
                mine = shingle(said) if len(j) else None
                for at in j[np.argsort(-equal[j], kind="stable")].tolist():
                    if at not in sets:
                        sets[at] = shingle(text[at].as_py())
                    both = len(np.intersect1d(mine, sets[at], assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(sets[at]) - both):
                        found.append((min(x, int(ids[at])), max(x, int(ids[at]))))
                        break
        return pa.Table.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    held = comps.join(ask.select(F.col("comp").alias("component")).distinct(), "component").select(F.col("component").alias("comp"), "id")
    sizes = held.groupBy("comp").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks")).join(ask.groupBy("comp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "comp")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    asked = ask.withColumnRenamed("x", "id")
    ids = asked.select("id").unionByName(held.select("id")).select(F.col("id").alias("a"), F.col("id").alias("b"))
    full = wanted(texts, ids).join(narrow, "id")
    left = asked.join(sizes, "comp").join(full, "id").select("comp", "id", "n", "bits", "text", deal("chunks").alias("chunk"), each("blocks").alias("block"))
    right = held.join(sizes, "comp").join(full, "id").select("comp", "id", "n", "bits", "text", deal("blocks").alias("block"), each("chunks").alias("chunk"))
    right = right.toDF(*right.columns)  # new names for the columns that both sides have from one table
    keys = ["comp", "chunk", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, b long").distinct()


def _within_groups(ask: DataFrame, narrow: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """ask: (id, own, set_id), own the component so far. Links (a, b) that join the components of a set, as far as each block sees them."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        shingle, sets, found, root = Shingler(k), {}, [], {}
        block, ids, own, n, bits, text = t.column("block").to_numpy(), *(t.column(c).to_numpy() for c in ("id", "own", "n")), _matrix(t.column("bits"), N_HASHES // 2), t.column("text")

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        def members(at: int) -> np.ndarray:
            if at not in sets:
                sets[at] = shingle(text[at].as_py())
            return sets[at]

        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        for i in left.tolist():
            j = right[(own[right] != own[i]) & ((ids[right] > ids[i]) | (key[1].as_py() != key[2].as_py()))]
            fits, equal = similar(bits[i][None], bits[j], n[i], n[j], percent)
            for at in j[fits][np.argsort(-equal[fits], kind="stable")].tolist():
                a, b = find(int(own[i])), find(int(own[at]))
                if a != b:
                    mine, other = members(i), members(at)
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        root[max(a, b)] = min(a, b)
                        found.append((min(int(ids[i]), int(ids[at])), max(int(ids[i]), int(ids[at]))))
        return pa.Table.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    sizes = ask.groupBy("set_id").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    full = wanted(texts, ask.select(F.col("id").alias("a"), F.col("id").alias("b"))).join(narrow, "id")
    rows = ask.join(sizes, "set_id").join(full, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("set_id", "id", "own", "n", "bits", "text", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    return rows.groupBy("set_id", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi")).applyInArrow(run, "a long, b long").distinct()


def _estimated(pairs: DataFrame, narrow: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those, with est, that sketches and sizes allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fits, equal = similar(*(_matrix(batch.column(c), N_HASHES // 2) for c in ("x", "y")), batch.column("n").to_numpy(), batch.column("m").to_numpy(), percent)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal.astype(np.int32))], schema=_PAIR_SCHEMA).filter(pa.array(fits))

    both = pairs.distinct().join(narrow.select(F.col("id").alias("a"), "n", F.col("bits").alias("x")), "a").join(narrow.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, _PAIRS)


def _with_components(df: DataFrame, comps: DataFrame, column: str, name: str) -> DataFrame:
    return df.join(comps.select(F.col("id").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    return _with_components(_with_components(pairs, comps, "a", "ca"), comps, "b", "cb").where("ca != cb").select("a", "b")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component) a document, of all documents. Percentages at or above 80 are what EST allows."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    known = stage(sketch(docs, id_column, text_column, k), "sketch")
    usable = known.where("n_shingles > 0 and id is not null")
    classes = stage(usable.groupBy("digest").agg(F.min(F.struct("id", "sig", "bits", F.col("n_shingles").alias("n"))).alias("r")).select("digest", "r.*"), "classes")
    narrow = classes.select("id", "n", "bits")

    with Stages(docs.sparkSession) as held:
        rows = classes.select("id", F.explode(_children(None)).alias("node"))
        members = held(rows.join(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "node"), "members")
        large = members.where(F.col("size") > SMALL).select("node", "id")
        ends = large.join(large.groupBy("node").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "node")
        pivot = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("id").alias("b")), F.struct(F.col("id").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.*").where("a < b")
        small = members.where(F.col("size") <= SMALL).join(narrow, "id").withColumn("comp", F.col("id"))
        found = _pairs_of_small(small, percent).unionByName(_estimated(pivot, narrow, percent))
        cand = held(found.groupBy("a", "b").agg(F.max("est").alias("est")), "candidates")

        # Confirm the best link of every class first: what these connect needs no further pair.
        ends = cand.select(F.explode(F.array(F.struct("a", F.col("b").alias("o")), F.struct(F.col("b").alias("a"), F.col("a").alias("o")))).alias("p"), "est").select("p.*", "est")
        best = ends.groupBy("a").agg(F.max(F.struct("est", "o")).alias("m")).select(F.least("a", "m.o").alias("a"), F.greatest("a", "m.o").alias("b")).distinct()
        links = held(verify(held(best, "best"), texts, k, percent), "links")
        comps = components(links, held)
        def joined(more: DataFrame) -> None:
            """Confirmed links, and the components with them; the earlier ones are released."""
            nonlocal links, comps
            if not more.isEmpty():
                links = links.unionByName(more)
                old, comps = comps, components(links, held)
                held.drop(old)

        rest = held(_across(cand, comps), "rest")
        if not rest.isEmpty():
            joined(held(verify(rest, texts, k, percent), "links"))

        rows, deeper = held(_with_components(large, comps, "id", "comp"), "level1"), []
        for level in range(1, DEPTH + 1):
            per = rows.groupBy("node", "comp").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("tops"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
            rows = held(rows.join(per, "node"), "nodes")
            small, done = F.col("others") + F.col("tops") <= SMALL, (F.col("others") <= SMALL) | F.lit(level == DEPTH)
            none = F.lit(None).cast("long")
            deeper.append(_pairs_of_small(rows.where(small).join(narrow, "id"), percent).select("*", none.alias("x"), none.alias("top"), none.alias("node")))
            deeper.append(_pairs_of_large(rows.where(~small & done).join(narrow, "id"), percent))
            rows = held(rows.where(~small & ~done).join(classes.select("id", "sig"), "id").select("id", "comp", F.explode(_children(F.col("node"))).alias("node")), "level")
            if rows.isEmpty():
                break
        more = held(functools.reduce(DataFrame.unionByName, deeper).groupBy("a", "b", "x", "top", "node").agg(F.max("est").alias("est")), "deeper")
        if not more.isEmpty():
            joined(held(verify(held(more.select("a", "b").distinct(), "more"), texts, k, percent), "links"))
        ask = _with_components(_with_components(more.where("top is not null").select("x", "top").distinct(), comps, "top", "comp"), comps, "x", "own")
        ask = held(ask.where("own != comp").select("x", "comp").distinct(), "ask")
        if not ask.isEmpty():
            joined(held(_against_components(ask, comps, narrow, texts, k, percent), "links"))
        ask = _with_components(more.where("node is not null").select(F.col("x").alias("id"), "node").distinct(), comps, "id", "own")
        ask = ask.join(ask.groupBy("node").agg(F.min("id").alias("first"), F.min("own").alias("c0"), F.max("own").alias("c1")).where("c0 != c1").select("node", "first"), "node")
        ask = held(ask.select("id", "own", "first").distinct(), "ask")
        if not ask.isEmpty():
            sets = components(ask.select(F.col("id").alias("a"), F.col("first").alias("b")), held).select("id", F.col("component").alias("set_id"))
            joined(held(_within_groups(ask.select("id", "own").distinct().join(sets, "id"), narrow, texts, k, percent), "links"))
        comps = held.keep(comps)

    by_class = classes.join(comps, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = known.select("id", "n_shingles", "digest").join(by_class, "digest", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group stays (the smallest id), with its columns; of rows with one id all stay. Rows without an id stay."""
    found = near_duplicates(docs).where("id != component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["__gone"], "left_anti")


#: Sets, pairs by shared shingles, and reachable ids: for small tables, as a check.
ORACLE = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) end as s from t),
e as (select doc_id, len(s) as n, hash(unnest(s)) as h from s),
c as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c where 100 * i >= 80 * (na + nb - i)),
ends as (select a as u, b as v from l union all select b, a from l),
r as (select doc_id as id, doc_id as reached from documents union select r.id, ends.v from r join ends on ends.u = r.reached),
m as (select id, min(reached) as component_id from r group by 1)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join m on m.id = s.doc_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
