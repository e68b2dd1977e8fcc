"""Token counts by a separator scan over flat, unindexed token files.

``write_token_files`` lays token ids of documents end to end in flat little-endian files, each document followed by the
end-of-document id. ``scan`` knows only the files: blocks of BLOCK_TOKENS ids are read as byte ranges, a vectorised search finds the
separators of a block, and a prefix scan over a file's blocks (counts and last separator before each) stitches documents
that cross blocks. Nothing in a file says where a document begins.

Null and empty texts: no tokens. Ids may be null or repeated: counts follow the place in the file. Tokens after the last separator are a document with terminated = false.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small_batches, stage, table
from .tokens import BYTE_BPE, encoding

SEPARATOR, WIDTH = 50256, 2
BLOCK_TOKENS, FILE_TOKENS = 1 << 20, 1 << 26


def write_token_files(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = BYTE_BPE) -> DataFrame:
    """Writes the files; returns (file, ordinal, doc_id), the order of documents. A retried task writes new files, and only files named in the result count."""
    out = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, sink, ordinal, held = "", None, 0, 0
        for batch in small_batches(batches, "text", 8 << 20):
            if sink is None or held > FILE_TOKENS:
                if sink:
                    sink.close()
                path = f"{root}/{uuid.uuid4().hex}.tokens"
                sink, ordinal, held = store.open_output_stream(path), 0, 0
            for text in batch.column("text"):
                ids = np.array(encode(text.as_py() or "") + [SEPARATOR], "<u2")
                sink.write(ids.tobytes())
                held += len(ids)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column("doc_id")], schema=out)
            ordinal += n
        if sink:
            sink.close()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, "file string, ordinal long, doc_id long")
    return stage(rows, "token-files")


def scan(files: DataFrame, folder: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """files: (file). Returns (file, ordinal, start, n_tokens, terminated), a row a document."""
    sized = pa.schema([("file", pa.string()), ("size", pa.int64())])
    found = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("size", pa.int64())])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column("file").to_pylist()
            yield pa.RecordBatch.from_pydict({"file": names, "size": [x.size // WIDTH for x in store.get_file_info(names)] if names else []}, schema=sized)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size")), strict=True):
                with store.open_input_file(name) as source:
                    first = block * block_tokens
                    ids = np.frombuffer(source.read_at(min(block_tokens, size - first) * WIDTH, first * WIDTH), "<u2")
                yield pa.RecordBatch.from_pydict({"file": [name], "block": [block], "ends": [first + np.flatnonzero(ids == separator)], "size": [size]}, schema=found)

    blocks = files.select("file").distinct().mapInArrow(sizes, "file string, size long").where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_tokens))).alias("block"))
    spread = blocks.repartition("file", "block")
    hits = stage(spread.mapInArrow(search, "file string, block long, ends array<long>, size long"), "separators")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.select("file", "block", F.size("ends").cast("long").alias("n"), F.element_at("ends", F.when(F.size("ends") > 0, -1)).alias("last"))
    prefix = ends.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("seen"), F.coalesce(F.max("last").over(earlier), F.lit(-1).cast("long")).alias("edge"))
    inner = hits.join(prefix, ["file", "block"]).select("file", "seen", "edge", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("edge") + 1).otherwise(F.get("ends", F.col("k") - 1) + 1)
    whole = inner.select("file", (F.col("seen") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated"))
    tails = hits.groupBy("file").agg(F.max("size").alias("size"), F.sum(F.size("ends")).alias("ordinal"), F.coalesce(F.max(F.array_max("ends")), F.lit(-1)).alias("last")).where("last < size - 1")
    return whole.unionByName(tails.select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents become token files, the scan counts them, and the files' order names the documents."""
    folder = new_path(spark, "tokens")
    order = write_token_files(table(spark, sf_dir, "documents"), folder)
    return scan(order, folder).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")
