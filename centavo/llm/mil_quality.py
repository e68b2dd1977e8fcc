"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage's features are the mean shape of its words (case, marks,
repeats, lengths) and a mean of their hashed vectors; an encoder maps them to a hidden vector, gated attention
(tanh times sigmoid) weighs the passages, and a logistic layer scores the weighted sum. All weights are learned
from document labels, on a sample of at most SAMPLE_DOCS labelled documents outside the held-out fold, of each at most TRAIN_PASSAGES
passages spread over its text; every document is scored whole.

Null and empty texts: one passage of zeros, hence a score too. No labels at all: every score is 0.5. Null and repeated
ids pass through; of labels that disagree for an id the greatest counts. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, table

PASSAGE, HASHED, HIDDEN, GATE = 64, 16, 24, 12
#: Passages of one document that are learned from at most, evenly spread over its whole text; scoring takes all.
TRAIN_PASSAGES = 64
SAMPLE_DOCS, EPOCHS, RATE, DECAY, SEED = 6000, 250, 0.02, 1e-4, 7
SHAPES = 12
_CACHE_WORDS, BLOCK = 150_000, 64
_MARKS = set("#*$%&<>")


def _marked(word: str) -> tuple[float, ...]:
    letters, upper = sum(map(str.isalpha, word)), sum(map(str.isupper, word))
    digits = any(map(str.isdigit, word))
    return (letters > 1 and upper == letters, upper > 0, not letters, "!" in word, "|" in word, not _MARKS.isdisjoint(word), digits, word[-1] in ".,;:?", "http" in word or "@" in word)


def word_features(words: list[str]) -> np.ndarray:
    """A row a word: its shape (the last is the place of repeats) and a hashed vector of signs."""
    out = np.zeros((len(words), SHAPES + HASHED), np.float32)
    marked = [i for i, w in enumerate(words) if not (w.isalpha() and w.islower()) or "http" in w]
    if marked:
        out[marked, : SHAPES - 3] = np.array([_marked(words[i]) for i in marked], np.float32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out[:, SHAPES - 3], out[:, SHAPES - 2] = np.minimum(lengths, 40) / 10, lengths > 20
    seeds = np.array([xxhash.xxh3_64_intdigest(w.lower().encode(errors="replace")) for w in words], np.uint64)
    out[:, SHAPES:] = ((seeds[:, None] >> np.arange(HASHED, dtype=np.uint64)) & np.uint64(1)) * 2.0 - 1
    return out


class Encoder:
    """Passages' features of texts; remembers words."""

    def __init__(self):
        self.known, self.table = {}, np.zeros((1024, SHAPES + HASHED), np.float32)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros((1, SHAPES + HASHED), np.float32)
        known = self.known
        if len(known) > _CACHE_WORDS:
            known.clear()
        if new := list(set(words).difference(known)):
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            while len(known) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : len(known)] = word_features(new)
        ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        whole = len(ids) // PASSAGE
        parts = [ids[: whole * PASSAGE].reshape(whole, PASSAGE), ids[whole * PASSAGE :].reshape(1, -1)]
        out = np.concatenate([self.means(x) for x in parts if x.size])
        again = np.append(False, ids[1:] == ids[:-1])
        starts = np.arange(0, len(ids), PASSAGE)
        out[:, SHAPES - 1] = np.add.reduceat(again, starts, dtype=np.float32) / np.minimum(len(ids) - starts, PASSAGE)
        return out

    def means(self, ids: np.ndarray) -> np.ndarray:
        """The mean features of rows of word numbers, BLOCK rows at a time."""
        total = np.zeros((len(ids), SHAPES + HASHED), np.float32)
        for at in range(0, len(ids), BLOCK):
            total[at : at + BLOCK] = np.ones(ids.shape[1], np.float32) @ self.table[ids[at : at + BLOCK]]
        return total / ids.shape[1]


def forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """x: passages of all bags in a row; starts: each bag's first."""
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh(((x - p["mean"]) / p["scale"]) @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["a"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    att = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(att[:, None] * h, starts, axis=0)
    logit = np.clip((z @ p["c"] + p["d"]).astype(np.float64), -30, 30)
    return {"bag": bag, "h": h, "t": t, "s": s, "att": att, "z": z, "score": 1 / (1 + np.exp(-logit))}


def gradients(p: dict[str, np.ndarray], fixed: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross entropy of the bags' scores, by parameter."""
    f = forward(p | fixed, x, starts)
    bag, h, t, s, att = f["bag"], f["h"], f["t"], f["s"], f["att"]
    g = weight * (f["score"].astype(x.dtype) - y)
    gz = g[:, None] * p["c"]
    ga = (gz[bag] * h).sum(axis=1)
    ge = att * (ga - np.add.reduceat(att * ga, starts)[bag])
    gt, gs = ge[:, None] * p["a"] * s * (1 - t * t), ge[:, None] * p["a"] * t * s * (1 - s)
    gh = (att[:, None] * gz[bag] + gt @ p["v"].T + gs @ p["u"].T) * (1 - h * h)
    xn = (x - fixed["mean"]) / fixed["scale"]
    return {"w": xn.T @ gh, "b": gh.sum(axis=0), "v": h.T @ gt, "u": h.T @ gs, "a": (t * s).T @ ge, "c": f["z"].T @ g, "d": g.sum()}


def train(bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Full-batch Adam; the two classes weigh the same."""
    x = np.concatenate(bags)
    starts = np.cumsum([0] + [len(b) for b in bags])[:-1]
    rng = np.random.default_rng(SEED)
    new = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    p = {"w": new(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": new(HIDDEN, GATE), "u": new(HIDDEN, GATE), "a": new(GATE), "c": new(HIDDEN), "d": np.zeros((), np.float32)}
    fixed = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-3}
    y = labels.astype(np.float32)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, EPOCHS + 1):
        grads = gradients(p, fixed, x, starts, y, weight)
        for k in p:
            d = grads[k] + DECAY * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * d
            m2[k] = 0.999 * m2[k] + 0.001 * d * d
            p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def _spread(x: np.ndarray) -> np.ndarray:
    return x if len(x) <= TRAIN_PASSAGES else x[np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(np.int64)]


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray] | None:
    """docs: (doc_id, text); labels: (doc_id, quality). Learns from a bounded sample (smallest id hashes) outside the held-out fold."""
    out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": [_spread(encode(t.as_py())).astype("<f4").tobytes() for t in batch.column("text")]}, schema=out)

    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id", 3, 1)).groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "quality", F.xxhash64("text")).agg(F.first("text").alias("text")).select("doc_id", "quality", "text")  # equal rows of an id count once
    seen = texts.mapInArrow(run, "doc_id long, quality long, x binary")
    rows = seen.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample_docs).collect()  # an id may have many texts
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(bytes(r["x"]), "<f4").reshape(-1, SHAPES + HASHED) for r in rows]
    return train(bags, np.array([r["quality"] for r in rows]))


def _free(docs: DataFrame, name: str) -> str:
    """The name, longer if the documents have such a column (names differ by more than case)."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, name: str = "__score", keep_text: bool = True) -> DataFrame:
    """Adds a score to the documents' columns; it must not be named like one of them. Texts that are not kept do not come back from the Python workers."""
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder()
        for batch in small_batches(batches, "text", 8 << 20):
            if model is None:
                values = np.full(batch.num_rows, 0.5)
            else:
                bags = [encode(t.as_py()) for t in batch.column("text")]
                values = forward(model, np.concatenate(bags), np.cumsum([0] + [len(b) for b in bags])[:-1])["score"]
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(values, pa.float64())], names=[*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(run, f"{kinds}, {name} double")


def keep_good(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    name = _free(docs, "__score")
    return score(docs, model, name).where(F.col(name) >= 0.5).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, keep_text=False)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("__score").alias("score"), F.when(F.col("__score") >= 0.5, 1).otherwise(0).alias("predicted"))
