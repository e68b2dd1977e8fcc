"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

A block of documents (a task's batch) is treated as one corpus: its distinct pattern matches lie in one flat array of
symbols, an inverted index maps each mergeable pair of symbols to its positions, and merges are applied in rank order, each to all
positions of its pair at once; only the touched neighbours enter the index anew. A document's ids are then looked up match by match. Recent
matches stay in a bounded memory, so that frequent ones are replayed once a task.

Null and empty texts: no ids. Ids decode to the exact bytes of the text; null ids and repeated rows pass through.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import MULTI_BPE, load_ranks

#: Bytes of text in a block; matches that a task remembers.
BLOCK_BYTES, REMEMBERED = 6 << 20, 500_000


def distinct(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    return places[np.append(True, places[1:] != places[:-1])]


class Replay:
    """Encodes distinct byte strings by applying merges in rank order over all of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_ranks: dict[int, int] = {}

    def _rank(self, key: int) -> int:
        """The rank of a pair of symbols, or -1."""
        r = self.pair_ranks.get(key)
        if r is None:
            r = self.pair_ranks[key] = self.ranks.get(self.bytes_of[key >> 32] + self.bytes_of[key & 0xFFFFFFFF], -1)
        return r

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        symbol = np.append(self.single[flat], -1)  # the place n stands for no neighbour
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = ends[lengths > 0] - 1
        after[last] = n
        before[np.append(0, last + 1)] = n
        after[n] = before[n] = n
        index: dict[int, list[np.ndarray]] = {}
        heap: list[tuple[int, int]] = []

        def enter(places: np.ndarray) -> None:
            """Pairs that begin at these places."""
            places = places[after[places] != n]
            if not len(places):
                return
            keys = symbol[places] << 32 | symbol[after[places]]
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for key, a, b in zip(keys[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(keys)).tolist(), strict=True):
                rank = self._rank(key)
                if rank >= 0:
                    held = index.get(key)
                    if held is None:
                        index[key] = [places[a:b]]
                        heapq.heappush(heap, (rank, key))
                    else:
                        held.append(places[a:b])

        enter(np.arange(n))
        while heap:
            rank, key = heapq.heappop(heap)
            left, right = key >> 32, key & 0xFFFFFFFF
            places = distinct(np.concatenate(index.pop(key)))
            places = places[(symbol[places] == left) & (symbol[after[places]] == right)]
            if left == right and len(places) > 1:
                places = self._apart(places, after)
            if not len(places):
                continue
            gone = after[places]
            symbol[places], symbol[gone] = rank, -1
            after[places] = after[gone]
            near = after[places]
            before[near] = places
            before[n] = n
            back = before[places]
            enter(distinct(np.append(places, back[back != n])))
        keep = np.flatnonzero(symbol[:n] >= 0)
        parts = symbol[keep].tolist()
        cuts = np.searchsorted(keep, ends).tolist()
        return [parts[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    @staticmethod
    def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences the leftmost, then the next that is free."""
        kept, taken = [], -1
        for p, q in zip(places.tolist(), after[places].tolist(), strict=True):
            if p != taken:
                kept.append(p)
                taken = q
        return np.array(kept, np.int64)


class Encoder:
    """Texts' ids with one Replay and a bounded memory of matches."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.replay, self.pattern, self.known = Replay(load_ranks(path)), regex.compile(pattern), {}

    def block(self, texts: Iterable[str | None]) -> list[list[object]]:
        """For each text the ids of its matches, in order."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = list(set().union(*split).difference(known))
        known.update(zip(fresh, map(self.digest, self.replay([w.encode() for w in fresh])), strict=True))
        return [list(map(known.__getitem__, words)) for words in split]

    def digest(self, ids: list[int]) -> object:
        return ids


class Digester(Encoder):
    """Keeps for a match what the digests need: its ids as text, their number and the bytes they decode to."""

    def __init__(self, path: str):
        super().__init__(path)
        self.names = [str(i) for i in range(max(self.replay.bytes_of) + 1)]

    def digest(self, ids: list[int]) -> tuple[str, int, bytes]:
        if len(ids) == 1:
            return self.names[ids[0]], 1, self.replay.bytes_of[ids[0]]
        return ",".join([self.names[i] for i in ids]), len(ids), b"".join([self.replay.bytes_of[i] for i in ids])


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = MULTI_BPE) -> DataFrame:
    """(doc_id, ids)."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in small_batches(batches, "text", BLOCK_BYTES):
            found = encoder.block(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": [[i for part in x for i in part] for x in found]}, schema=out)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = MULTI_BPE) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are not UTF-8 become U+FFFD."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {v: k for k, v in load_ranks(vocabulary).items()}
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": [b"".join(map(bytes_of.__getitem__, x)).decode(errors="replace") for x in batch.column("ids").to_pylist()]}, schema=out)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = MULTI_BPE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids and digests both, without moving ids out of the task."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Digester(vocabulary)
        for batch in small_batches(batches, "text", BLOCK_BYTES):
            rows: list[list] = [[], [], []]
            for found in encoder.block(batch.column("text").to_pylist()):
                text, count, raw = zip(*found, strict=True) if found else ((), (), ())
                rows[0].append(sum(count))
                rows[1].append(hashlib.sha256(",".join(text).encode()).hexdigest())
                rows[2].append(hashlib.sha256(b"".join(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2])], schema=out)

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
