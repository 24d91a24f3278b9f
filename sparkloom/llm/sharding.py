"""Sharding by balanced label propagation, in built-in functions only.

Documents that share a link key (here: equal texts) attract each other.  Each round counts the members
of a key in every shard; a member wants to be where most of them are.  A key with more members than a
shard may hold attracts to as many of its fullest shards as hold it.  The wished moves between the n x n
pairs of shards are counted, the largest shares of them that respect every shard's quota are found on
those n x n numbers, and documents of small keys move with that share, each key as a whole.  Large keys go where they want to, as
small ones can make room without a cut: a last pass makes the quotas exact, large keys first, and what
is over a shard's quota, with small keys that are still in several shards and all documents without
links, fills the free places.  Small keys go there whole; at most one a shard is cut, where none has room.

Law ``rows``: the counts of any two shards differ by one at most.

The texts are read once.  All later passes move rows of fixed size.  Large keys, of which there are at most
``LARGE`` a shard, are joined by broadcast, so a key that has a third of all rows is never shuffled by its
name; small ones are joined by a shuffle.  Ranks are taken in buckets whose number grows with the table.

Order and chance come from doc_id, text and, for rows that repeat both, their number among these; so the
result doesn't depend on how the table is split into files and tasks.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace

ROUNDS = 8
STILL = 0.002  # propagation ends when a smaller share of linked documents still moves
PER_BUCKET = 20_000  # rows that are ranked together
LARGE = 20  # a key is large if so many of its size fill a shard
COPIES = 100_000  # rows that repeat an id and its text are numbered in runs of so many
IDENTITY = ("doc_id", "text_crc32", "link_key", "copy")


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and link_key of each row; equal texts have equal keys, null texts none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col("text").isNotNull(), F.unhex(F.md5(F.col("text").cast("binary"))))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("link_key"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with ``copy``, the number among rows that are equal, and ``row_id``, a hash of it all."""
    same = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    runs = same.select(*rows.columns, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("run"))
    last = F.least(F.col("n") - 1, F.col("run") * COPIES + (COPIES - 1))
    return runs.select(*rows.columns, F.explode(F.sequence(F.col("run") * COPIES, last)).alias("copy")).withColumn("row_id", F.xxhash64(*IDENTITY))


def _joined(rows: DataFrame, one_a_key: DataFrame, large: Column, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row a link_key: its large keys, ``LARGE`` a shard at most, by broadcast."""
    few = F.broadcast(one_a_key.where(large))
    rest = rows.join(few.select("link_key"), "link_key", "left_anti").join(one_a_key.where(~large), "link_key", how)
    return rows.join(few, "link_key").unionByName(rest)


def _shares(flow: dict[tuple[int, int], int], load: list[int], quota: list[int]) -> list[float]:
    """The largest share of wished moves into each shard under which no shard passes its quota.

    Starts at all and lowers: a shard can take its free places and what leaves it at the other
    shards' shares.  The shares fall from step to step and stay above 0, so they settle."""
    n = len(load)
    share = [1.0] * n
    wish = [sum(flow.get((i, j), 0) for i in range(n)) for j in range(n)]
    for _ in range(50):
        leaves = [sum(flow.get((i, j), 0) * share[j] for j in range(n)) for i in range(n)]
        share = [min(share[j], max(0.0, quota[j] - load[j] + leaves[j]) / wish[j]) if wish[j] else 1.0 for j in range(n)]
    return share


def _fraction(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 20)) / F.lit(float(1 << 20))


def propagate(linked: DataFrame, n_shards: int, quota: list[int], rounds: int, work: Workspace) -> DataFrame:
    """linked (row_id, link_key, members ...; row_id a hash) with ``shard`` after the rounds."""
    state = linked.withColumn("shard", F.pmod("row_id", F.lit(n_shards)).cast("int"))
    free, last = max(1, min(quota)), None
    large, open_ = F.col("members") * LARGE > free, [True] * n_shards
    for k in range(rounds):
        room = large | F.get(F.array(*[F.lit(x) for x in open_]), F.col("shard"))

        def targets(rows: DataFrame) -> DataFrame:
            cells = rows.groupBy("link_key", "shard").agg(F.count("*").alias("n"), F.max("members").alias("members"))
            ranked = F.sort_array(F.collect_list(F.struct(room.alias("room"), "n", F.xxhash64("link_key", "shard", F.lit(k)).alias("tie"), "shard")), asc=False)  # noqa: B023  # one entry a shard at most
            wide = F.greatest(F.lit(1), F.ceil(F.max("members") / free).cast("int"))
            return cells.groupBy("link_key").agg(ranked.alias("at"), wide.alias("wide")).select("link_key", F.transform(F.slice("at", 1, F.least("wide", F.size("at"))), lambda x: x["shard"]).alias("targets"))

        want = F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(F.get("targets", F.pmod(F.xxhash64("row_id", F.lit(k)), F.size("targets")).cast("int")))
        few, many = state.where(large), state.where(~large)
        met = few.join(F.broadcast(targets(few)), "link_key").unionByName(many.join(targets(many), "link_key"))  # LARGE targets a shard at most
        moves = work.write(met.withColumn("want", want).drop("targets"), f"moves{k}")
        counts = moves.groupBy("shard", "want", large.alias("large")).agg(F.count("*").alias("n")).collect()  # 2 * n_shards squared
        if last is not None:
            work.drop(last)
        last = moves
        load = [sum(r.n for r in counts if (r.want if r.large else r.shard) == s) for s in range(n_shards)]
        flow = {(r.shard, r.want): r.n for r in counts if not r.large and r.shard != r.want}
        shares = _shares(flow, load, quota)
        open_ = [shares[s] > 0.2 or load[s] < 0.9 * quota[s] for s in range(n_shards)]
        share = F.array(*[F.lit(x) for x in shares])
        goes = large | (_fraction("link_key", F.lit(k)) < F.get(share, F.col("want")))
        state = moves.withColumn("shard", F.when(goes, F.col("want")).otherwise(F.col("shard"))).drop("want")
        if sum(r.n for r in counts if r.shard != r.want) <= STILL * sum(load):
            break
    return state


def _bucket(buckets: int, first: Column) -> Column:
    """What is ranked together, in order: whole keys by their hash; a key of many rows has buckets of its own beside."""
    own = F.coalesce(F.col("members") > PER_BUCKET // 20, F.lit(False))
    part = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("members") / PER_BUCKET))
    return F.struct(first.alias("first"), F.pmod(F.xxhash64("link_key"), F.lit(buckets)).alias("hash"), F.when(own, F.col("link_key")).otherwise(F.lit(b"")).alias("own"), F.when(own, part).otherwise(F.lit(0)).alias("part"))


def _order(taken: list[int], quota: list[int]) -> tuple[list[int], list[int]]:
    """Shards by free places, most first, and where the free places of each end."""
    order = sorted(range(len(quota)), key=lambda s: taken[s] - quota[s])
    return order, list(itertools.accumulate(quota[s] - taken[s] for s in order))


def _stretches(linked: int, spans: list[tuple[int, int]], taken: list[int], quota: list[int]) -> list[tuple[int, int, int]]:
    """(first rank, shard, slot less rank) of the stretches in which the rest goes to the free places.

    The first ``linked`` ranks have links.  spans are (first rank, rows) of small keys at an end of a
    shard's free places: those that it would cut go where they fit, before documents without links fill up."""
    (order, ends), at, out = _order(taken, quota), list(taken), []
    torn = sorted((a, n) for a, n in spans if bisect.bisect_right(ends, a) != bisect.bisect_right(ends, a + n - 1))

    def put(rank: int, n: int, s: int) -> None:
        out.append((rank, s, at[s] - rank))
        at[s] += n

    for s, start, end in zip(order, [0, *ends[:-1]], ends, strict=True):
        low, high = start, min(end, linked)
        for a, n in torn:
            if a < low:
                low = max(low, a + n)
            else:
                high = min(high, a)
        if low < high:
            put(low, high - low, s)
    for a, n in sorted(torn, key=lambda x: -x[1]):
        while n:
            room = [q - x for q, x in zip(quota, at, strict=True)]
            fits = [s for s, r in enumerate(room) if r >= n]
            s = min(fits, key=room.__getitem__) if fits else room.index(max(room))
            k = min(n, room[s])
            put(a, k, s)
            a, n = a + k, n - k
    for s, q in enumerate(quota):
        n = q - at[s]
        if n:
            put(linked, n, s)
            linked += n
    return sorted(out)


def shard_documents(docs: DataFrame, n_shards: int, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, link_key, members, shard and slot for each row of docs (doc_id, text).

    Null texts have no link and the size 16.  Rows that repeat are documents of their own, linked like
    any equal texts; null ids are allowed.  An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession)
    base = work.write(_numbered(facts(docs)), "facts")
    total = base.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    free, buckets = max(1, min(quota)), max(1, -(-total // PER_BUCKET))
    large = F.coalesce(F.col("members") * LARGE > free, F.lit(False))
    groups = work.write(base.where(F.col("link_key").isNotNull()).groupBy("link_key").agg(F.count("*").alias("members")).where("members > 1"), "groups")
    alone = F.coalesce("link_key", F.encode(F.concat(F.lit("-"), F.col("row_id").cast("string")), "UTF-8"))  # null keys would meet in one task
    rows = work.write(_joined(base.withColumn("link_key", alone), groups, large, "left"), "rows")
    work.drop(base)
    linked = work.write(propagate(rows.where("members is not null"), n_shards, quota, rounds, work), "linked")

    # A small key that is still apart gives up all its places and goes, whole, with the rest.
    shards = linked.where(~large).groupBy("link_key").agg(F.min("shard").alias("low"), F.max("shard").alias("high"))
    apart = work.write(shards.where("low < high").select("link_key"), "apart")

    # Ranks within a shard: large keys first, so that what is over the quota are small keys; the key at the quota goes whole.
    placed = linked.join(apart, "link_key", "left_anti").withColumn("bucket", _bucket(buckets, ~large))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("link_key", "doc_id", "copy")) - 1
    ranked = work.write(placed.join(starts, ["shard", "bucket"]).withColumn("slot", rank.cast("long")).drop("start", "bucket"), "ranked")
    limit = F.get(F.array(*[F.lit(q).cast("long") for q in quota]), F.col("shard"))
    cut = {r.shard: bytes(r.link_key) for r in ranked.where(~large & (F.col("slot") == limit)).select("shard", "link_key").collect()}  # n_shards rows
    cuts = F.array(*[F.lit(cut.get(s)).cast("binary") for s in range(n_shards)])
    stays = (F.col("slot") < limit) & ~F.col("link_key").eqNullSafe(F.get(cuts, F.col("shard")))
    kept = ranked.where(stays)
    load = {r.shard: r.n for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # n_shards rows
    taken = [load.get(s, 0) for s in range(n_shards)]

    # The rest goes to the free places in order: large keys to the roomiest shards, small keys, then documents without links.
    rest = ranked.where(~stays).drop("slot", "shard").unionByName(linked.join(apart, "link_key", "left_semi").drop("shard")).unionByName(rows.where("members is null"))
    rest = rest.withColumn("bucket", _bucket(buckets, F.when(F.col("members").isNull(), 2).when(large, 0).otherwise(1)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = rest.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("bucket").orderBy("link_key", "doc_id", "copy")) - 1
    rest = work.write(rest.join(starts, "bucket").withColumn("rank", rank.cast("long")).drop("start", "bucket"), "rest")
    work.keep(ranked, rest)
    pairs = rest.where("members is not null")
    at_ends = pairs.where(~large & F.col("rank").isin(_order(taken, quota)[1])).select("link_key").distinct()
    spans = pairs.join(F.broadcast(at_ends), "link_key").groupBy("link_key").agg(F.min("rank").alias("first"), F.count("*").alias("n")).collect()  # n_shards rows
    stretches = _stretches(pairs.count(), [(r["first"], r.n) for r in spans], taken, quota) or [(0, 0, 0)]
    firsts, shards, offsets = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in zip(*stretches, strict=True))
    which = F.size(F.filter(firsts, lambda e: e <= F.col("rank"))) - 1
    rest = rest.withColumn("shard", F.get(shards, which).cast("int")).withColumn("slot", F.col("rank") + F.get(offsets, which))
    columns = ["doc_id", "size", "text_crc32", "link_key", "members", "shard", "slot"]
    return kept.select(columns).unionByName(rest.select(columns))
