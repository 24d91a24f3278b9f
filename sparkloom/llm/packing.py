"""Packing by concatenating and cutting.

First pass: every task encodes its rows and keeps a running sum of their tokens; the rows are written
with that position.  The totals of the tasks, summed up in order, give each task's place in the one long
stream of all tokens.  Second pass: the stream is cut every ``LENGTH`` tokens; a document becomes one
piece for each window it reaches into, and pieces record where they lie in document and sequence.  Only
the last sequence has padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import batches
from .bpe import Tokenizer
from .workspace import Workspace

LENGTH = 2048
END_ID = 1
BROADCAST = 200_000  # scan tasks (16 bytes each) whose places are broadcast; more are joined by a shuffle


def token_rows(docs: DataFrame, tokenizer: Tokenizer, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit, closed by end_id), task and at: the tokens
    that the rows before it in the same task have.  A null text has the end id alone."""
    end = end_id.to_bytes(4, "little")

    def encoded(parts):
        task, at, encoder = TaskContext.get().partitionId(), 0, tokenizer.encoder
        for batch in parts:
            own, texts = batch.columns
            for k, n in batches.parts(texts):
                ids = [encoder.encode(t) + end for t in texts.slice(k, n).to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + sizes.cumsum() - sizes
                at += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([own.slice(k, n), pa.array(ids, pa.binary()), pa.array(np.full(n, task, np.int32)), pa.array(starts)], ["doc_id", "ids", "task", "at"])
        batches.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encoded, f"doc_id {kind}, ids binary, task int, at long")


def pack(docs: DataFrame, tokenizer: Tokenizer, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    Repeated rows are packed each; null ids stay null.  An empty table gives no pieces.
    """
    work = Workspace(docs.sparkSession)
    batches.use(docs.sparkSession)
    rows = work.write(token_rows(docs, tokenizer, end_id), "tokens", "zstd")
    size = (F.octet_length("ids") / 4).cast("long")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    tasks = work.write(rows.groupBy("task").agg(F.sum(size).alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "tasks")
    placed = rows.join(F.broadcast(tasks) if tasks.count() <= BROADCAST else tasks, "task").select("doc_id", "ids", size.alias("doc_tokens"), (F.col("first") + F.col("at")).alias("place"))
    window = F.sequence(F.expr(f"place div {length}"), F.expr(f"(place + doc_tokens - 1) div {length}"))

    def piece(w):
        start = F.greatest(F.lit(0).cast("long"), w * length - F.col("place"))
        end = F.least(F.col("doc_tokens"), (w + 1) * length - F.col("place"))
        ids = F.substring("ids", (start * 4 + 1).cast("int"), ((end - start) * 4).cast("int"))
        return F.struct(start.alias("start"), (end - start).alias("length"), ids.alias("ids"), w.alias("sequence_id"), (F.col("place") + start - w * length).alias("offset"))

    cut = placed.select("doc_id", "doc_tokens", F.explode(F.transform(window, piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
