"""The skill registry as a table: user-scoped reading, lookups, counts and name collisions.

A registry has the columns id, user_id, name, description, content, is_active, updated_at and seq; seq
gives the order in which rows were put in.  ``user_id`` is the column to partition a stored one by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import or_else, strip_py, text_or_empty

RANKED = 3  # characters that names begin with, by which a user's rows are ranked apart
SCHEMA = "id string, user_id string, name string, description string, content string, is_active boolean, updated_at long, meta map<string,string>, seq long"


class RegistryUnavailable(RuntimeError):
    """There is no registry to read."""

    def __init__(self):
        super().__init__("skills_model_unavailable")


def open_registry(spark: SparkSession, table: str) -> DataFrame:
    """A catalogued registry, or ``RegistryUnavailable``."""
    if not spark.catalog.tableExists(table):
        raise RegistryUnavailable
    return spark.table(table)


def user_skills(registry: DataFrame, user_id: str) -> DataFrame:
    """A user's rows; the filter is pushed to the scan."""
    return registry.where(F.col("user_id") == user_id)


def _shown(registry: DataFrame) -> dict[str, Column]:
    have = set(registry.columns)
    updated = F.col("updated_at") if "updated_at" in have else F.lit(None)
    number = "updated_at" in have and registry.schema["updated_at"].dataType.typeName() not in ("string", "timestamp", "date")
    return {
        "id": text_or_empty(F.col("id")),
        "name": F.col("name"),
        "description": F.col("description"),
        "is_active": F.coalesce("is_active", F.lit(False)) if "is_active" in have else F.lit(True),
        "updated_at": F.when(updated == 0, "").otherwise(text_or_empty(updated)) if number else text_or_empty(updated),
    }


def project(registry: DataFrame, include_content: bool = False) -> DataFrame:
    """The columns of a listing; content is read only if asked for."""
    shown = _shown(registry) | ({"content": F.col("content")} if include_content else {})
    return registry.select(*[c.alias(k) for k, c in shown.items()])


def by_name(registry: DataFrame) -> list[Column]:
    """Sort order of a listing: case-folded name, null as empty, then seq."""
    return [F.lower(F.coalesce("name", F.lit(""))), F.col("seq")]


def list_skills(registry: DataFrame, user_id: str, include_content: bool = False) -> DataFrame:
    return project(user_skills(registry, user_id).orderBy(*by_name(registry)), include_content)


def counts(registry: DataFrame) -> DataFrame:
    """user_id, count and active_count."""
    active = F.coalesce(F.col("is_active"), F.lit(False))
    return registry.groupBy("user_id").agg(F.count("*").alias("count"), F.count_if(active).alias("active_count"))


def matches(skill_id: str | None, name: str | None) -> Column:
    """The given id, or the given name in any case; blank ones match nothing.  Stored names aren't stripped."""
    wanted_id, wanted_name = strip_py(F.lit(skill_id or "")), F.lower(strip_py(F.lit(name or "")))
    own_id, own_name = text_or_empty(F.col("id")), F.lower(text_or_empty(F.col("name")))
    return ((wanted_id != "") & (own_id == wanted_id)) | ((wanted_name != "") & (own_name == wanted_name))


def find_skill(registry: DataFrame, user_id: str, skill_id: str = "", name: str = "") -> DataFrame:
    """The first row by seq that matches either; at most one row."""
    return user_skills(registry, user_id).where(matches(skill_id, name)).orderBy("seq").limit(1)


def show_skill(registry: DataFrame, user_id: str, skill_id: str = "", name: str = "", include_content: bool = True) -> DataFrame:
    return project(find_skill(registry, user_id, skill_id, name), include_content)


def first_matches(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """req_id and the id of the first row that a request (req_id, user_id, skill_id, name) matches.

    Two equi-joins, by id and by name, instead of one with OR; each only brings the first row of a key,
    so a name that very many rows have is one row before it is joined."""
    key = F.lower(text_or_empty(F.col("name")))
    first = lambda k: registry.groupBy("user_id", k.alias("key")).agg(F.min(F.struct("seq", "id")).alias("hit"))
    wanted = requests.select("req_id", "user_id", strip_py(F.coalesce("skill_id", F.lit(""))).alias("by_id"), F.lower(strip_py(F.coalesce("name", F.lit("")))).alias("by_name"))
    hits = [wanted.where(F.col(by) != "").withColumnRenamed(by, "key").join(first(k), ["user_id", "key"]).select("req_id", "hit") for by, k in (("by_id", text_or_empty(F.col("id"))), ("by_name", key))]
    return hits[0].unionByName(hits[1]).groupBy("req_id").agg(F.min("hit").alias("hit")).select("req_id", F.col("hit.id").alias("id"))


def name_collisions(registry: DataFrame) -> DataFrame:
    """Rows whose name another row of the same user has in any case, with how many do; one row each."""
    keyed = registry.withColumn("name_key", F.lower(text_or_empty(F.col("name"))))
    shared = keyed.groupBy("user_id", "name_key").agg(F.count("*").alias("holders")).where("holders > 1")
    return keyed.join(shared, ["user_id", "name_key"]).select("id", "user_id", "name_key", "holders")


def rename_conflicts(registry: DataFrame, renames: DataFrame) -> DataFrame:
    """Of renames (user_id, id, new_name), those whose new name another row of the user has."""
    new = renames.withColumn("_key", F.lower(strip_py(F.col("new_name")))).where("_key <> ''")
    held = registry.select("user_id", F.lower(text_or_empty(F.col("name"))).alias("_key"), F.col("id").alias("_id"))
    held = held.groupBy("user_id", "_key").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"))
    return new.join(held, ["user_id", "_key"]).where("_low <> id or _high <> id").select(*renames.columns)


def display_name(name: Column, skill_id: Column) -> Column:
    return or_else(name, skill_id, F.lit("unknown"))


def split_by_existing(registry: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose name is new to the user, requests whose name exists), by case-folded name."""
    key = requests.withColumn("_key", F.lower(strip_py(F.coalesce("name", F.lit("")))))
    held = registry.select("user_id", F.lower(text_or_empty(F.col("name"))).alias("_key")).distinct()
    return tuple(key.join(held, ["user_id", "_key"], how).select(*requests.columns) for how in ("left_anti", "left_semi"))


def ranked(registry: DataFrame) -> DataFrame:
    """Every user's listing with its place in it.

    A user's rows are ranked by groups of names that begin alike, so a large registry is no single task: a row's place is
    its rank in its group and the rows of the groups before.  Those are counted beforehand, and a user has as many of them as
    there are beginnings of ``RANKED`` characters."""
    key, seq = by_name(registry)
    rows = registry.select("user_id", key.alias("_key"), F.substring(key, 1, RANKED).alias("_group"), seq.alias("_seq"), *[c.alias(k) for k, c in _shown(registry).items()])
    before = Window.partitionBy("user_id").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("user_id", "_group").agg(F.count("*").alias("n")).select(F.col("user_id").alias("_user"), F.col("_group").alias("_begins"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    met = rows.join(groups, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_group") == F.col("_begins")))
    rank = F.row_number().over(Window.partitionBy("user_id", "_group").orderBy("_key", "_seq"))
    return met.select("user_id", (F.col("_before") + rank).cast("int").alias("place"), *_shown(registry))
