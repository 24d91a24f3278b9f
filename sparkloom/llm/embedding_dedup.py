"""Embedding near-duplicates: sign hashes in several tables, exact cosines, connected components.

Each vector gets a bit per random hyperplane; ``bits`` of them name its bucket in a table.  The number of
bits follows the number of vectors, so buckets keep their size, and the number of tables follows from the bits
and the wanted recall at the threshold: a pair at angle a shares a table's bucket with probability
(1 - a / pi) ** bits.

First only ids and packed sign bits travel to the buckets.  All pairs of a bucket are compared by the Hamming
distance of their bits, and a vector stays in a bucket only if it has a near one there whose first shared table
this is.  Then the vectors of what is left are fetched and compared exactly, in double precision, bucket by
bucket; so vectors without near ones never travel.  A bucket over ``BLOCK`` vectors is cut into blocks and each
pair of blocks is a group of its own, so no task has more than two blocks at once.  A pair is counted in the
first table that it shares only.  What comes out of a group is linear in it: how many vectors each one links
to, and edges that connect what is linked.

Equal vectors are one class (by 128 bits of a digest) with a multiplicity, from before hashing to the end.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .components import connected_components
from .jaccard_join import _Forest, maybe_in
from .workspace import Workspace

THRESHOLD = 0.9
RECALL = 0.985  # of pairs just at the threshold; closer ones are found more often
PER_BUCKET = 256  # vectors that a bucket would hold if they were spread evenly
BLOCK = 1024
LEAST_BITS = 256  # of the packed bits that are compared; more tables have more
MARGIN = 3.3  # standard deviations of the Hamming distance at the threshold's angle; one such pair in 2000 is over
SHIFTED = 24  # rows of a group that is compared by shifting
BROADCAST = 200_000  # hot buckets (16 bytes each) that are broadcast; more are joined by a shuffle
VALUES = 1 << 21  # numbers that a task multiplies at once
KEYS = ["key", "part"]
SEED = 7


def plan(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(4, round(math.log2(max(vectors, 1) / PER_BUCKET)))
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared)))


def furthest(width: int, threshold: float) -> int:
    """The Hamming distance of ``width`` bits up to which pairs are compared exactly."""
    p = math.acos(threshold) / math.pi
    return math.floor(width * p + MARGIN * math.sqrt(width * p * (1 - p)))


def _usable(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles, -0.0 as 0.0) of those that can link, by length and slice by slice: not null
    or empty, all components finite numbers, not all zero."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, n in batches.cuts(sizes * 8):
        own = sizes[at : at + n]
        flat = vectors.slice(at, n).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        starts = np.cumsum(own) - own
        for dim in np.unique(own[own > 0]):
            rows = np.flatnonzero(own == dim)
            v = flat[starts[rows][:, None] + np.arange(dim)] + 0.0
            good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            yield rows[good] + at, v[good]


def _digests(v: np.ndarray) -> np.ndarray:
    """128 bits of a digest of each row, as two integers."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in v), np.int64).reshape(-1, 2)


def _signed(vectors: DataFrame, width: int, seed: int = SEED) -> DataFrame:
    """vec_id, h1, h2 and bits of each row; the last three are null for rows that can't link."""

    def sign(parts):
        planes: dict[int, np.ndarray] = {}
        for batch in parts:
            told = np.zeros((batch.num_rows, 2), np.int64)
            bits = np.zeros((batch.num_rows, width // 8), np.uint8)
            can = np.zeros(batch.num_rows, bool)
            for rows, v in _usable(batch.column(1)):
                can[rows], told[rows] = True, _digests(v)
                dim = v.shape[1]  # vectors of other lengths have other planes, and link with nothing here
                if dim not in planes:
                    planes = {dim: np.random.default_rng([seed, dim]).standard_normal((dim, width))}
                step = max(1, VALUES // width)
                for k in range(0, len(rows), step):
                    part = v[k : k + step] / np.abs(v[k : k + step]).max(axis=1, keepdims=True)
                    bits[rows[k : k + step]] = np.packbits(part @ planes[dim] > 0, axis=1, bitorder="little")
            none = ~can
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width // 8), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
            packed = pc.if_else(pa.array(can), packed, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told[:, 0], mask=none), pa.array(told[:, 1], mask=none), packed], ["vec_id", "h1", "h2", "bits"])
        batches.release()

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(sign, f"vec_id {kind}, h1 long, h2 long, bits binary")


def _unpacked(bits: pa.Array, size: int) -> np.ndarray:
    """A row of bytes for each binary of ``size`` bytes."""
    bits = bits.cast(pa.binary())  # a session may ask for large ones
    data = bits.buffers()[2]
    first = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset]
    return np.frombuffer(data, np.uint8)[first : first + len(bits) * size].reshape(-1, size)


def _codes(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The names of the buckets of rows of packed bits, by table."""
    own = np.unpackbits(packed, axis=1, count=bits * tables, bitorder="little").reshape(-1, tables, bits)
    return own @ (1 << np.arange(bits, dtype=np.int64))


def _buckets(classes: DataFrame, bits: int, tables: int, width: int) -> DataFrame:
    """id, bits and key, the buckets of each class: a row for each table."""

    def named(parts):
        for batch in parts:
            step = max(1, VALUES // width)
            for k in range(0, batch.num_rows, step):
                some = batch.slice(k, step)
                keys = _codes(_unpacked(some.column(1), width // 8), bits, tables) | (np.arange(tables, dtype=np.int64) << 48)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([*some.columns, lists], ["id", "bits", "keys"])

    return classes.select("id", "bits").mapInArrow(named, "id long, bits binary, keys array<long>").select("id", "bits", F.explode("keys").alias("key"))


def _first_shared(codes: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether table t is the first in which rows i and j share a bucket."""
    return (codes[i] == codes[j]).argmax(axis=1) == t


def _groups(parts, compare):
    """What ``compare`` makes of whole groups, out of rows sorted by (key, part); it gets a table of rows and their keys."""
    held = None
    for batch in batches.merged(parts):
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if table.num_rows:
            keys = np.column_stack([table[k].to_numpy() for k in KEYS])
            begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            held = table.slice(begin[-1])  # may go on in the next batch
            yield from compare(table.slice(0, begin[-1]), keys[: begin[-1]])
    if held is not None:
        yield from compare(held, np.column_stack([held[k].to_numpy() for k in KEYS]))
    batches.release()


def _column(table: pa.Table, name: str) -> pa.Array:
    whole = table[name].combine_chunks()
    return whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole


def _shape(table: pa.Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, table, upper, both) of rows: their group, the hash table it is of, whether a row is of the group's upper
    block, and whether the group is one block, whose rows all meet."""
    run = np.cumsum(np.r_[False, (keys[1:] != keys[:-1]).any(axis=1)])
    return run, keys[:, 0] >> 48, (table["who"].to_numpy() & 1).astype(bool), keys[:, 1] >> 31 == keys[:, 1] & 0x7FFFFFFF


def _promising(table: pa.Table, keys: np.ndarray, bits: int, tables: int, width: int, most: int):
    """key, part and who of the rows that have a near one in their group, by Hamming distance, which they share no
    table with before this."""
    if table.num_rows < 2:
        return
    packed = _unpacked(_column(table, "bits"), width // 8)
    words, codes = np.ascontiguousarray(packed).view(np.uint64), None
    run, t, upper, both = _shape(table, keys)
    keep = np.zeros(len(run), bool)

    def mark(i, j):
        nonlocal codes
        open_ = ~(keep[i] & keep[j])
        i, j = i[open_], j[open_]
        if len(i):
            codes = _codes(packed, bits, tables) if codes is None else codes
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                new = _first_shared(codes, x, y, t[x])
                keep[x[new]] = keep[y[new]] = True

    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, len(run)])
    at = np.flatnonzero((size <= SHIFTED)[run])
    for step in range(1, SHIFTED):
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        i = at[both[at] | (upper[at] != upper[at + step])]
        mark(*(x[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1, dtype=np.int64) <= most] for x in (i, i + step)))
    for f, n in zip(first[size > SHIFTED].tolist(), size[size > SHIFTED].tolist(), strict=True):
        own = words[f : f + n]
        for k in range(0, n, 64):
            distance = np.bitwise_count(own[k : k + 64, None, :] ^ own[None, k:, :]).sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(distance <= most)
            i, j = i + k + f, j + k + f
            met = (i < j) & (both[f] | (upper[i] != upper[j]))
            mark(i[met], j[met])
    yield pa.RecordBatch.from_arrays([pa.array(keys[keep, 0]), pa.array(keys[keep, 1]), _column(table, "who").filter(pa.array(keep))], ["key", "part", "who"])


def _links(v: np.ndarray, codes: np.ndarray, table: np.ndarray, run: np.ndarray, upper: np.ndarray, both: np.ndarray, threshold: float) -> tuple[list, list, list, list, list]:
    """Linked rows within runs of rows (one run a group), as lists of index arrays: pairs (left, right)
    of small groups, which are compared by shifting all rows at once; and for large ones, a matrix
    product each, edges (rows, roots) that connect what is linked, and the pairs to be counted."""
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, len(run)])
    small = np.flatnonzero((size <= SHIFTED)[np.searchsorted(first, np.arange(len(run)), "right") - 1])
    left, right, at = [], [], small
    for step in range(1, SHIFTED):
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        i, j = at, at + step
        met = both[i] | (upper[i] != upper[j])
        i, j = i[met], j[met]
        near = np.einsum("ij,ij->i", v[i], v[j]) >= threshold
        i, j = i[near], j[near]
        new = _first_shared(codes, i, j, table[i])
        left.append(i[new])
        right.append(j[new])
    rows, roots, counts = [], [], []
    for f, n in zip(first[size > SHIFTED].tolist(), size[size > SHIFTED].tolist(), strict=True):
        near = v[f : f + n] @ v[f : f + n].T >= threshold
        if not both[f]:
            near &= upper[f : f + n, None] != upper[f : f + n]
        i, j = np.nonzero(np.triu(near, 1))
        new = _first_shared(codes, i + f, j + f, table[f])
        i, j = i[new], j[new]
        forest = _Forest(n)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            forest.join(x, y)
        some = np.union1d(i, j)
        rows.append(some + f)
        roots.append(np.array([forest.root(x) for x in some.tolist()], np.int64) + f)
        counts.append((i + f, j + f))
    return left, right, rows, roots, counts


def _compared(table: pa.Table, keys: np.ndarray, bits: int, tables: int, width: int, threshold: float):
    """id, links and other (an edge): how many vectors each row links to in its group, and edges that connect what is linked."""
    if table.num_rows < 2:
        return
    run, t, upper, both = _shape(table, keys)
    ids, n, vectors = _column(table, "id"), table["n"].to_numpy(), _column(table, "vector")
    codes = _codes(_unpacked(_column(table, "bits"), width // 8), bits, tables)
    sizes = pc.list_value_length(vectors).to_numpy().astype(np.int64)
    flat = vectors.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):  # vectors of other lengths may share a bucket's name
        own = np.flatnonzero(sizes == dim)
        v = flat[starts[own][:, None] + np.arange(dim)].astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)  # keeps squares in range; cosines stay
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        left, right, rows, roots, counts = _links(v, codes[own], t[own], run[own], upper[own], both[own], threshold)
        links, seen = np.zeros(len(own), np.int64), n[own]
        for i, j in [*zip(left, right, strict=True), *counts]:
            np.add.at(links, i, seen[j])
            np.add.at(links, j, seen[i])
        some = np.flatnonzero(links)
        a = np.concatenate([some, *left, *rows]) if len(some) else some
        b = np.concatenate([some, *right, *roots]) if len(some) else some
        links = np.r_[links[some], np.zeros(len(a) - len(some), np.int64)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[a])), pa.array(links), ids.take(pa.array(own[b]))], ["id", "links", "other"])


def _vectors(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, n, bits and vector of the wanted classes (id, first_id, h1, h2, n, bits), from the table itself."""

    def digested(parts):
        for batch in parts:
            lists = batch.column(1)
            for rows, v in _usable(lists):
                told = _digests(v)
                yield pa.RecordBatch.from_arrays([pa.array(told[:, 0]), pa.array(told[:, 1]), lists.take(pa.array(rows))], ["h1", "h2", "vector"])
        batches.release()

    kind = vectors.schema["embedding"].dataType.simpleString()
    some = maybe_in(vectors.where("vec_id is not null").select("vec_id", "embedding"), "vec_id", wanted.select(F.col("first_id").alias("vec_id"))).where("_maybe").select("vec_id", "embedding")
    told = maybe_in(some.mapInArrow(digested, f"h1 long, h2 long, vector {kind}"), "h1", wanted).where("_maybe").drop("_maybe")
    return told.join(wanted.drop("first_id"), ["h1", "h2"]).dropDuplicates(["id"]).select("id", "n", "bits", "vector")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding).

    n_links: other rows found with a cosine of at least ``threshold``; component_id: the smallest vec_id
    reachable; kept: whether that is the row's own.  Vectors that are null, empty, zero, or hold nulls or
    non-finite components link with nothing, as do vectors of different lengths with each other.  Rows
    that repeat link with each other like equal vectors of other ids; rows with a null vec_id link with
    nothing and are kept.  An empty table gives no rows.
    """
    batches.use(vectors.sparkSession)
    work = Workspace(vectors.sparkSession)
    bits, tables = plan(vectors.count(), threshold, recall)
    width = max(LEAST_BITS, -(-bits * tables // 64) * 64)
    rows = work.write(_signed(vectors, width), "rows")
    usable = F.col("h1").isNotNull() & F.col("vec_id").isNotNull()
    classes = rows.where(usable).groupBy("h1", "h2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"), F.first("bits").alias("bits"))
    classes = work.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    named = _buckets(classes, bits, tables, width)
    hot = work.write(named.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block).select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "hot")
    held = hot.count()
    met = named.join(F.broadcast(hot) if held <= BROADCAST else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long")
    met = met.select("id", "bits", "key", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("k"))
    part = F.call_function("shiftleft", F.least("own", "k"), F.lit(31)).bitwiseOR(F.greatest("own", "k"))
    who = F.call_function("shiftleft", F.col("id"), F.lit(1)).bitwiseOR((F.col("own") >= F.col("k")).cast("long"))
    by_group = lambda df: df.repartition(*KEYS).sortWithinPartitions(*KEYS)
    most = furthest(width, threshold)
    promising = by_group(met.select("key", part.alias("part"), who.alias("who"), "bits")).mapInArrow(lambda b: _groups(b, lambda x, keys: _promising(x, keys, bits, tables, width, most)), "key long, part long, who long")
    promising = work.write(promising.withColumn("id", F.call_function("shiftright", F.col("who"), F.lit(1))), "promising")
    fetched = work.write(_vectors(vectors, promising.select("id").distinct().join(classes, "id")), "vectors")
    found = by_group(promising.join(fetched, "id")).mapInArrow(lambda b: _groups(b, lambda x, keys: _compared(x, keys, bits, tables, width, threshold)), "id long, links long, other long")
    found = work.write(found, "found")
    work.keep(rows, classes, found)

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), work)
    own = classes.select("id", "h1", "h2", "first_id", "n").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = own.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = own.join(least, "component").join(counts, "id", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    some = rows.where(usable).join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    none = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
