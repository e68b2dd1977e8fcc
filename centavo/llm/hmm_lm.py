"""LM scoring with a hidden Markov model trained by Baum-Welch.

Words are counted over the training documents (partial counts a block, then a shuffle). The model's symbols are the words whose count
reaches a bar that at most VOCABULARY words reach, and one class for all rarer words, within which a word has a smoothed share
of its own. Every document is written once as symbols. All training comes from every training document: START_ROUNDS rounds take each as a
whole from one of STATES states (a mixture, without a recursion), and from there FULL_ROUNDS Baum-Welch rounds take expected counts: each task
runs scaled forward-backward recursions over its documents, and its counts are summed by symbol across partitions. The scaled forward
recursion gives a text's exact likelihood.

Frequent words' counts are sent to every task (bounded by VOCABULARY); rarer words of a document are looked up by a join.

Null and empty texts: the end token alone. No training documents: every known count is 0 and the sums are defined. Null and repeated ids are rows of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, stage, table

STATES, VOCABULARY, FULL_ROUNDS = 6, 60_000, 2
START_ROUNDS, SEED = 2, 3
PIECE_CHARS = 20_000
#: Texts, and symbols of texts, that are worked on together.
BLOCK_BYTES, SYMBOL_BYTES = 8 << 20, 4 << 20
#: The end of a text: no word holds a space.
END = b" "
#: Added to expected counts, a share of the symbol's count over all states.
SMOOTH = 0.05


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents given."""
    out = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 2 * BLOCK_BYTES):
            seen: Counter[bytes] = Counter()
            for text in batch.column("text"):
                seen.update(tokens(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema=out)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """Words that reach the lowest bar which at most that many words reach, and the bar. Counts are binned by size first, so only the kept words reach the driver."""
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()
    held, bar = 0, None
    for row in sorted(steps, key=lambda r: -r["bin"]):
        held += row["n"]
        if held > most:
            break
        bar = row["low"]
    if bar is None:
        bar = (max((r["low"] for r in steps), default=0) or 0) + 1 if not steps else 2**62
    words = counts.where((F.col("c") >= bar) | (F.col("word") == F.lit(END))).collect()
    return {bytes(r["word"]): r["c"] for r in words}, bar


def encode(text: str | None, symbols: dict[bytes, int]) -> tuple[np.ndarray, list[bytes]]:
    """A text's symbols, and its words of the rare class, whose symbol follows all others."""
    words, rare = tokens(text), len(symbols)
    ids = np.fromiter(map(symbols.get, words, repeat(rare)), np.dtype("<i4"), len(words))
    return ids, [words[i] for i in np.flatnonzero(ids == rare).tolist()]


class Sequences:
    """A block's documents as symbol sequences, longest first, to be stepped through together."""

    def __init__(self, texts: list[str | None], symbols: dict[bytes, int]):
        self._lay([encode(text, symbols)[0] for text in texts])

    @classmethod
    def of(cls, coded: pa.Array) -> Sequences:
        """Of documents written as symbols."""
        self = cls.__new__(cls)
        self._lay([np.frombuffer(x, "<i4") for x in coded.to_pylist()])
        return self

    def _lay(self, rows: list[np.ndarray]) -> None:
        self.lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.order = np.argsort(-self.lengths, kind="stable")
        sizes = self.lengths[self.order]
        self.active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # documents at least that long
        starts = np.append(0, np.cumsum(self.active))
        self.starts = starts
        flat = np.empty(starts[-1], np.int32)
        for place, k in enumerate(self.order.tolist()):
            flat[starts[: len(rows[k])] + place] = rows[k]
        self.flat = flat  # by step, then document
        self.place = np.arange(len(flat)) - np.repeat(starts[:-1], self.active)  # the document of each, in the order of lengths


def forward(model: dict[str, np.ndarray], seq: Sequences, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Natural log likelihoods by document; the scaled forward values and the scales if kept."""
    emit, move, begin = model["emit"], model["move"], model["begin"]
    scale = np.empty(len(seq.flat))
    alphas = np.empty((len(seq.flat), move.shape[0])) if keep else None
    alpha = None
    for t, n in enumerate(seq.active.tolist()):
        a = seq.starts[t]
        b = emit[seq.flat[a : a + n]]
        alpha = (begin if alpha is None else alpha[:n] @ move) * b
        s = alpha.sum(axis=1)
        alpha = alpha / s[:, None]
        scale[a : a + n] = s
        if keep:
            alphas[a : a + n] = alpha
    logs = np.zeros(len(seq.order))
    logs[seq.order] = np.bincount(seq.place, np.log(scale), len(seq.order))
    return logs, alphas, scale


def expect(model: dict[str, np.ndarray], seq: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts: (symbols, states), (states, states), (states,)."""
    _, alphas, scale = forward(model, seq, keep=True)
    emit, move = model["emit"], model["move"]
    k = move.shape[0]
    moves, beta, gammas = np.zeros((k, k)), None, np.empty_like(alphas)
    for t in range(len(seq.active) - 1, -1, -1):
        n, a = int(seq.active[t]), seq.starts[t]
        now = np.ones((n, k))
        if beta is not None:
            m = len(beta)
            c = seq.starts[t + 1]
            ahead = emit[seq.flat[c : c + m]] * beta / scale[c : c + m, None]
            now[:m] = ahead @ move.T
            moves += alphas[a : a + m].T @ ahead
        beta = now
        gammas[a : a + n] = alphas[a : a + n] * beta
    counts = np.stack([np.bincount(seq.flat, gammas[:, s], len(emit)) for s in range(k)], axis=1)
    return counts, moves * move, gammas[: seq.active[0]].sum(axis=0)


def belong(model: dict[str, np.ndarray], seq: Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts as of expect(), without moves, where one state emits all of a document and all states are as likely before."""
    emit, size = np.log(model["emit"]), len(seq.order)
    k = emit.shape[1]
    logs = np.stack([np.bincount(seq.place, emit[:, s][seq.flat], size) for s in range(k)], axis=1)
    share = np.exp(logs - logs.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    counts = np.stack([np.bincount(seq.flat, share[:, s][seq.place], len(emit)) for s in range(k)], axis=1)
    return counts, np.zeros((k, k)), share.sum(axis=0)


def maximise(counts: np.ndarray, moves: np.ndarray, begins: np.ndarray, totals: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters from expected counts; totals: the symbols' counts over all training documents."""
    share = (totals + 0.5) / (totals + 0.5).sum()
    weight = SMOOTH * counts.sum() / counts.shape[1] + 1.0
    emit = counts + weight * share[:, None]
    moves, begins = moves + 1.0, begins + 1.0
    return {"emit": emit / emit.sum(axis=0), "move": moves / moves.sum(axis=1, keepdims=True), "begin": begins / begins.sum()}


def first_model(totals: np.ndarray) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    share = (totals + 0.5) / (totals + 0.5).sum()
    emit = share[:, None] * rng.uniform(0.3, 1.7, (len(totals), STATES))
    move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    return {"emit": emit / emit.sum(axis=0), "move": move, "begin": np.full(STATES, 1 / STATES)}


def _pack(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.ascontiguousarray(v) for k, v in model.items()}


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, i, text): texts in pieces of at most PIECE_CHARS characters, cut in one pass over a text. Training takes whole documents and does not use them."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    return docs.select("doc_id", F.posexplode(F.when(F.size(cut) > 0, cut).otherwise(F.array("text"))).alias("i", "text"))


def gather(coded: DataFrame, size: int, work: Callable[[Sequences], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of a block's expected counts over all documents given."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("part", pa.int32()), ("id", pa.int32()), ("v", pa.list_(pa.float64()))])
        counts, moves, begins = np.zeros((size, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        for batch in small_batches(batches, "ids", SYMBOL_BYTES):
            for held, more in zip((counts, moves, begins), work(Sequences.of(batch.column("ids"))), strict=True):
                held += more
        if begins.any():  # one row a symbol and task
            used = np.flatnonzero(counts.any(axis=1))
            values = [*counts[used], *moves, begins]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(used) + [1] * STATES + [2], pa.int32()), pa.array([*used.tolist(), *range(STATES), 0], pa.int32()), pa.array(values, pa.list_(pa.float64()))], schema=out)

    rows = coded.select("ids").mapInArrow(step, "part int, id int, v array<double>")
    # One row a symbol: at most VOCABULARY + 1, and STATES + 1 more.
    sums = rows.groupBy("part", "id").agg(*[F.sum(F.get("v", F.lit(s))).alias(f"s{s}") for s in range(STATES)]).collect()
    counts, moves, begins = np.zeros((size, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
    for r in sums:
        v = [r[f"s{s}"] for s in range(STATES)]
        if r["part"] == 0:
            counts[r["id"]] = v
        elif r["part"] == 1:
            moves[r["id"]] = v
        else:
            begins[:] = v
    return counts, moves, begins


def train(coded: DataFrame, totals: np.ndarray) -> dict[str, np.ndarray]:
    """coded: (ids), all training documents and no others."""
    sc, model = coded.sparkSession.sparkContext, first_model(totals)
    for work in [belong] * START_ROUNDS + [expect] * FULL_ROUNDS:
        sent = sc.broadcast(_pack(model))
        found = gather(coded, len(totals), lambda seq, work=work, sent=sent: work(sent.value, seq))
        if not found[2].any():
            return model
        now = maximise(*found, totals)
        model = now if work is expect else now | {"move": model["move"]}
    return model


def score(docs: DataFrame, modulus: int = 5, remainder: int = 1, vocabulary: int = VOCABULARY) -> DataFrame:
    """docs: (doc_id, text). Learns from documents outside the held-out fold and scores all."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", modulus, remainder).alias("held_out"))
    learn = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = stage(count_words(learn), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    known, bar = frequent(counts, vocabulary)
    known.setdefault(END, 0)
    words = sorted(known)
    symbols = {w: i for i, w in enumerate(words)}
    top = np.array([known[w] for w in words], float)
    rare_n, rare_v = n - int(top.sum()), v - int((top > 0).sum())
    names = spark.sparkContext.broadcast(symbols)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document: its symbols, and its rare words."""
        word = pa.struct([("word", pa.binary()), ("times", pa.int64())])
        out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("rare", pa.list_(word))])
        for batch in small_batches(batches, "text", BLOCK_BYTES):
            ids, rare = zip(*(encode(text.as_py(), names.value) for text in batch.column("text")), strict=True)
            each = [Counter(x) for x in rare]
            flat = pa.StructArray.from_arrays([pa.array([w for x in each for w in x], pa.binary()), pa.array([c for x in each for c in x.values()], pa.int64())], fields=list(word))
            rare = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("held_out"), pa.array([x.tobytes() for x in ids], pa.binary()), rare.cast(out.field("rare").type)], schema=out)

    keyed = docs.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "held_out", "text")
    coded = stage(keyed.mapInArrow(write, "key long, doc_id long, held_out boolean, ids binary, rare array<struct<word:binary,times:bigint>>"), "symbols")
    model = train(coded.where(~F.col("held_out")), np.append(top, rare_n))
    base = np.append(np.log10((top + 0.5) / (n + 0.5 * (v + 1))), 0.0)
    sent = spark.sparkContext.broadcast({"model": _pack(model), "base": base, "known": np.append(top > 0, False)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        held = sent.value
        for batch in small_batches(batches, "ids", SYMBOL_BYTES):
            seq = Sequences.of(batch.column("ids"))
            logs, _, _ = forward(held["model"], seq)
            place, size = seq.order[seq.place], len(seq.order)
            base = np.bincount(place, held["base"][seq.flat], size)
            seen = np.bincount(place, held["known"][seq.flat], size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("held_out"), pa.array(seq.lengths), pa.array(seen), pa.array(base), pa.array(logs / np.log(10))], schema=out)

    scored = coded.select("key", "doc_id", "held_out", "ids").mapInArrow(run, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    rest = coded.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.times")
    c = F.coalesce("c", F.lit(0))
    rest = rest.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("rare_base"),
        F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(rare_n + 0.5 * (rare_v + 1)))).alias("rare_score"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return scored.join(rest, "key", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("score") + zero("rare_score")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
