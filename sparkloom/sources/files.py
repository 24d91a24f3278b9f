"""File sources: uploads, Markdown with front matter, plugin manifests, env files, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import basename, strip_js, unquote, without_export

#: Formats that are told apart by the end of a name.
FORMATS = ("csv", "xlsx", "pdf", "docx", "pptx")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content and format of the files in a folder."""
    return spark.read.format("binaryFile").load(folder).withColumn("format", file_format(F.col("path")))


def file_format(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for f in FORMATS:
        out = F.when(F.lower(path).endswith(f".{f}"), f).otherwise(out)
    return out


def csv_uploads(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(folder)


def first_file(spark: SparkSession, folder: str, explicit: str | None = None) -> DataFrame:
    """The file named explicitly (which must exist), else the first by path that isn't hidden; 0 or 1 rows."""
    if explicit and explicit.strip():
        return spark.read.format("binaryFile").load(explicit.strip())
    files = spark.read.format("binaryFile").load(folder)
    return files.where(~basename(F.col("path")).startswith(".")).orderBy("path").limit(1)


def front_matter(text: Column) -> Column:
    """struct<name, description, body> of a Markdown document that may begin with a ``---`` block."""
    head = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
    block = F.regexp_extract(text, head, 1)
    value = lambda k: F.nullif(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))
    return F.struct(value("name").alias("name"), value("description").alias("description"), F.regexp_replace(text, head, "").alias("body"))


def skill_documents(spark: SparkSession, paths: str) -> DataFrame:
    """path, name, description and body of Markdown files."""
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), front_matter(F.col("value")).alias("d"))
    return texts.select("path", "d.*")


def manifest(text: Column) -> Column:
    """map of the ``key: value`` lines in a plugin file's first docstring."""
    block = F.regexp_extract(text, r'(?s)\A\s*"""(.*?)"""', 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*\w+\s*:"))
    pair = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))
    return F.transform(lines, pair)


def plugin_manifests(spark: SparkSession, paths: str) -> DataFrame:
    """(path, key, value) of plugin files."""
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.explode(manifest(F.col("value"))).alias("m"))
    return texts.select("path", "m.key", "m.value")


def env_entries(lines: DataFrame) -> DataFrame:
    """key and value of lines (value ...), with their other columns: comments, lines without ``=`` and
    empty keys are dropped, ``export`` and one pair of quotes are taken off."""
    t = strip_js(F.col("value"))
    rest = [c for c in lines.columns if c != "value"]
    kept = lines.withColumn("_raw", t).where((F.col("_raw") != "") & ~F.col("_raw").startswith("#"))
    kept = kept.withColumn("_t", without_export(F.col("_raw"))).withColumn("_at", F.instr("_t", "=")).where("_at > 0")
    key = strip_js(F.substring(F.col("_t"), F.lit(1), F.col("_at") - 1))
    value = unquote(strip_js(F.substring(F.col("_t"), F.col("_at") + 1, F.length("_t"))))
    return kept.select(*rest, key.alias("key"), value.alias("value")).where("key <> ''")


def env_lines(spark: SparkSession, path: str, priority: int) -> DataFrame:
    """priority, line and value of a file's lines, split at line feeds with or without returns."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return whole.select(F.lit(priority).alias("priority"), "line", "value")


def merged_env(entries: DataFrame) -> DataFrame:
    """The winner of each key of entries (priority, line, key, value): lowest priority, then first line."""
    order = Window.partitionBy("key").orderBy("priority", "line")
    return entries.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("key", "value")
