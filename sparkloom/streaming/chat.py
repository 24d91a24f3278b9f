"""Chat hooks as transforms of conversation rows, the same in batch and in a stream.

Rows are (conv_id, turn, role, text).  Streams need no state: each hook works row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_JS, is_filled, preview, text_or_empty

#: What results begin with, and the answers and models of a pipe that has none of its own.
ACTION, TOOL = "Action processed: ", "Processed: "
ANSWER = "This is a response from the pipe function."
MOST_MODELS = 1000
MODELS = (("model-1", "Model 1"), ("model-2", "Model 2"))

Transform = Callable[[DataFrame], DataFrame]


def inlet(rows: DataFrame, change: Callable[[Column], Column] = lambda c: c, enabled: bool = True) -> DataFrame:
    """What goes to a model: ``change`` of the texts of user and system rows; the identity unless given."""
    return _on(rows, ("user", "system"), change) if enabled else rows


def outlet(rows: DataFrame, change: Callable[[Column], Column] = lambda c: c, enabled: bool = True) -> DataFrame:
    """What comes from a model: ``change`` of the texts of assistant rows."""
    return _on(rows, ("assistant",), change) if enabled else rows


def _on(rows: DataFrame, roles: tuple[str, ...], change: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("text", F.when(F.col("role").isin(*roles), change(F.col("text"))).otherwise(F.col("text")))


def action_result(content: Column) -> Column:
    return F.concat(F.lit(ACTION), preview(content))


def body_content(body: Column) -> Column:
    """``body.message.content``, empty where any of it is missing."""
    return F.coalesce(body["message"]["content"], F.lit(""))


def tool_result(query: Column) -> Column:
    return F.concat(F.lit(TOOL), text_or_empty(query))


def last_assistant_message(rows: DataFrame) -> DataFrame:
    """conv_id, turn and text of each conversation's last assistant row that isn't blank."""
    own = rows.where((F.col("role") == "assistant") & is_filled(F.col("text"), WS_JS))
    last = own.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    return last.select("conv_id", "m.turn", "m.text")


def nested(rows: DataFrame) -> DataFrame:
    """conv_id and messages, array<struct<role,text>> by turn."""
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return grouped.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))


@dataclass(frozen=True)
class Pipe:
    """A source of models and of answers: ``answer`` gives the chunks for one text."""

    id: str = "pipe"
    name: str = "Pipe"
    type: str = "manifold"
    models: tuple[tuple[str, str], ...] = MODELS
    answer: Callable[[str], Iterable[str]] = lambda text: (ANSWER,)
    settings: Mapping[str, str] = field(default_factory=dict)

    def pipes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.models), "id string, name string")

    def run(self, rows: DataFrame) -> DataFrame:
        """conv_id, turn, chunk, text: the chunks for each user row, as an iterator over batches."""
        import pandas as pd

        answer = self.answer

        def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = [(c, t, i, x) for c, t, text in zip(b.conv_id, b.turn, b.text, strict=True) for i, x in enumerate(answer(text or ""))]
                yield pd.DataFrame(made, columns=["conv_id", "turn", "chunk", "text"])

        return rows.where("role = 'user'").select("conv_id", "turn", "text").mapInPandas(chunks, "conv_id long, turn long, chunk int, text string")


def per_model(models: DataFrame, tests: DataFrame) -> DataFrame:
    """Each given test once for each model id: the product of two given lists, of which the models' has
    ``MOST_MODELS`` at most."""
    ids = models.select(F.col("id").alias("model_id")).distinct()
    if ids.count() > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} models")
    return tests.crossJoin(F.broadcast(ids)).select(*tests.columns, "model_id")


def stream(spark: SparkSession, path: str, hook: Transform, out: str, checkpoint: str, schema=None) -> None:
    """Runs ``hook`` over all rows that are in ``path`` now, as a stream, into Parquet files at ``out``."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(schema or table.schema)
    if [f.rstrip("/").rpartition("/")[2] for f in table.inputFiles()] == [path.rpartition("/")[2]]:  # one file; streams read folders
        reader, path = reader.option("pathGlobFilter", path.rpartition("/")[2]), path.rpartition("/")[0]
    rows = reader.parquet(path)
    query = hook(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
