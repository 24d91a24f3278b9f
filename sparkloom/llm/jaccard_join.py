"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is folded into XOR sketches: each shingle's hash goes into one lane of
a sketch, and a lane keeps the XOR of what went in.  Two sets that differ in d shingles differ in at
most d lanes, so of d + 1 lanes one is equal.  A link needs d <= (100 - t) / t * size of the smaller
set, hence sizes are cut into bands, each with as many lanes as its largest d asks for, and equal lanes
are found by a join on (band, lane, value).  Documents that could be the larger side of a pair with the
band below are sketched for that band too.

A lane that got no shingle is equal for very many documents.  Each band has E lanes more than needed, so
d differing lanes leave E + 1 equal ones; a document with at most E empty lanes needn't join on those,
and one with more does.  No link is lost either way.  By the same count a linked pair shares several
lanes, so a class with too few lanes that it shares with anyone is left out early, and so is a pair.

What shares a lane is tested by parity bits first: shingles toggle bits of a bit sketch (about 2 to 4 bits
a shingle), whose Hamming distance never exceeds the symmetric difference.  Survivors are verified
on the sets themselves.  Documents with equal sets are one class throughout.

Lanes that over ``SMALL`` classes share come from large groups of near copies or from passages that many
documents have.  Their classes are clustered (connected components over one star a lane).  In a cluster
all classes first meet two representatives of each size band; classes that are connected by then need no
comparison with each other.  What is left is compared with all others in blocks of bounded size, by size
band, in memory: only links that connect something are given out.  So nothing is capped; rows stay linear
in the classes' number, and blocks in that of the classes that no representative connects.

A lane that very many classes share would come to one task.  Each task therefore makes a lane that it has
more than ``SMALL`` times in a chunk of its own into a star with a salted key, and only the star's hub goes to
the lane itself, marked, so that whoever else has the lane joins the same cluster.

Classes are told apart by 128 bits of a digest; lanes carry 64 of them, and sets that agree in these only
are taken apart again before anything is compared.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import batches
from .columns import set_aside
from .components import connected_components
from .shingles import SHINGLE, mix, shingle_set
from .workspace import Workspace

THRESHOLD = 85  # percent
GROWTH = 1.5  # of a band's largest size over its smallest
SMALL = 32  # classes in a lane whose pairs are given out
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000  # of a block in a cluster
LARGEST = 1 << 40  # bands cover sets up to this size
NEED = 1 << 16  # band * NEED + need is one integer
CHUNK = 200_000  # rows of lanes that a task holds, and looks for hot lanes in
WORDS = 1 << 18  # of 64 bits, in the bitmaps that spare most texts a shuffle
_U = np.uint64


class Bands:
    """Size bands and their numbers of lanes for a threshold in percent."""

    def __init__(self, threshold: int):
        self.threshold, self.high, self.spare, self.lanes = threshold, [], [], []
        low = 1
        while low < LARGEST:
            high = max(low, int(low * GROWTH))
            differ = (100 - threshold) * high // threshold
            lanes, spare = differ + 1, 0
            for _ in range(3 if differ else 0):
                empty = lanes * math.exp(-low / lanes)  # expected for the smallest sets of the band
                spare = math.ceil(empty + 3 * math.sqrt(empty))
                lanes = differ + 1 + spare
            self.high.append(high)
            self.spare.append(spare)
            self.lanes.append(lanes)
            low = high + 1
        self.tops = np.array(self.high)

    def of(self, size: int) -> list[int]:
        """The bands a set of this size is sketched for; sets that can only link to equal ones have none."""
        k = int(np.searchsorted(self.tops, size))
        both = (k, k - 1) if k and size <= self.high[k - 1] * 100 // self.threshold else (k,)
        return [b for b in both if self.lanes[b] > 1]

    def keys(self, hashes: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        """What a set with these sorted hashes joins on in a band, and how many of its keys any set that
        links to it in this band has too: the equal lanes less those that both leave out as empty."""
        lanes = self.lanes[band]
        lane = ((hashes >> _U(32)) * _U(lanes)) >> _U(32)  # hashes are sorted, so lanes are runs
        first = np.flatnonzero(np.diff(lane, prepend=_U(lanes)))
        value, lane = np.bitwise_xor.reduceat(hashes, first), lane[first]
        need = self.spare[band] + 1 - (lanes - len(lane))
        if need < 1:
            need = 1
            rest = np.setdiff1d(np.arange(lanes, dtype=np.uint64), lane)
            lane, value = np.concatenate([lane, rest]), np.concatenate([value, np.zeros(len(rest), np.uint64)])
        return mix(value ^ mix(lane + _U(band << 48))), min(need, NEED - 1)


def class_of(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a digest of a whole set, as two integers; equal sets are one class."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def parity_bits(hashes: np.ndarray) -> bytes:
    """The bit sketch: 2 to 4 bits a shingle, 64 at least; each hash toggles the bit that its low bits name."""
    size = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches; the longer is folded onto the shorter, which keeps the bound."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    short = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, short), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def most_different(n: int, m: int, threshold: int) -> int:
    """The largest symmetric difference of linked sets of these sizes, -1 if the sizes rule a link out."""
    if 100 * min(n, m) < threshold * max(n, m):
        return -1
    return (100 - threshold) * (n + m) // (100 + threshold)


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _measured(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, class, check and bits of every row; the last three are null for empty sets."""

    def measure(parts):
        for batch in parts:
            ids, texts = batch.columns
            for at, n in batches.parts(texts):
                rows = []
                for t in texts.slice(at, n).to_pylist():
                    h = shingle_set(t, shingle)
                    rows.append((len(h), *class_of(h), parity_bits(h)) if len(h) else (0, None, None, None))
                made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), *made], ["doc_id", "n_shingles", "class", "check", "bits"])
        batches.release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, n_shingles long, class long, check long, bits binary")


LANE = "key long, class long, info int"


def _lanes(docs: DataFrame, shingle: int, bands: Bands, small: int) -> DataFrame:
    """key, class and info (band and need, negative for hubs of hot lanes); a task gives out each class once."""

    def sketch(parts):
        seen: set[int] = set()
        keys, classes, infos, held = [], [], [], 0

        def flush():
            made = salted(np.concatenate(keys), np.concatenate(classes), np.concatenate(infos), small)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "class", "info"])

        for batch in parts:
            for texts in batches.texts(batch.column(0)):
                for t in texts:
                    h = shingle_set(t, shingle)
                    if not len(h) or (c := class_of(h)[0]) in seen:
                        continue
                    seen.add(c)
                    for band in bands.of(len(h)):
                        own, need = bands.keys(h, band)
                        keys.append(own.view(np.int64))
                        classes.append(np.full(len(own), c, np.int64))
                        infos.append(np.full(len(own), band * NEED + need, np.int32))
                        held += len(own)
                    if held > CHUNK:
                        yield flush()
                        keys, classes, infos, held = [], [], [], 0
        if held:
            yield flush()
        batches.release()

    return docs.select("text").mapInArrow(sketch, LANE)


def salted(key: np.ndarray, cls: np.ndarray, info: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a chunk with hot keys salted: a key of more than ``small`` rows becomes a key of this chunk,
    named after its first row, the hub.  The hub stays with the old key too; both its rows have a negative info."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    size = np.diff(np.r_[first, len(key)])
    if not (size > small).any():
        return key, cls, info
    run = np.repeat(np.arange(len(first)), size)
    hot = (size > small)[run]
    rows, hub = order[hot], order[first[run[hot]]]
    hubs = order[first[size > small]]
    new, marked = key.copy(), info.copy()
    new[rows] = mix(key[rows].view(_U) ^ mix(cls[hub].view(_U))).view(np.int64)
    marked[hubs] = -info[hubs]
    return np.r_[new, key[hubs]], np.r_[cls, cls[hubs]], np.r_[marked, marked[hubs]]


def shared_rows(parts):
    """Of rows sorted by (key, class, info), those whose key has more than one class, each once.  Keeps one row
    between batches, the last, which may turn out to share its key."""
    last, given = None, False
    for batch in parts:
        if not len(batch):
            continue
        x = batch if last is None else pd.concat([last, batch], ignore_index=True)
        key, cls = x["key"].to_numpy(), x["class"].to_numpy()
        new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        x, key = x[new], key[new]
        same = key[1:] == key[:-1]
        give = np.r_[False, same] | np.r_[same, False]
        if last is not None and given:
            give[0] = False
            given = len(x) == 1
        else:
            given = False
        given = given or bool(len(x) > 1 and same[-1])
        last = x.iloc[-1:]
        yield x[give]


def bucket_pairs(parts, small: int = SMALL):
    """(a, b, info, large) from rows sorted by (key, class, info): all pairs of a key with up to ``small`` classes
    and no marked one, with the larger info of both, else a star from its first class, marked large.  Keeps
    at most ``small`` rows between batches."""
    empty = np.zeros(0, np.int64)
    held_key, held, held_info, hub = None, empty, empty, None
    for batch in parts:
        key, cls, info = batch["key"].to_numpy(), batch["class"].to_numpy(), batch["info"].to_numpy()
        if not len(key):
            continue
        out_a, out_b, out_info, out_large = [], [], [], []

        def give(a, b, i, large):
            out_a.append(a)  # noqa: B023
            out_b.append(b)  # noqa: B023
            out_info.append(np.abs(i))  # noqa: B023
            out_large.append(np.full(len(b), large))  # noqa: B023

        if hub is not None:  # a large key that began before
            own = int(np.searchsorted(key != held_key, True))
            give(np.full(own, hub), cls[:own], info[:own], True)
            key, cls, info = key[own:], cls[own:], info[own:]
            if len(key):
                hub = None
        if hub is None and len(key):
            if len(held):
                key, cls, info = np.concatenate([np.full(len(held), held_key), key]), np.concatenate([held, cls]), np.concatenate([held_info, info])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, info = key[new], cls[new], info[new]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            big = (size > small) | np.logical_or.reduceat(info < 0, first)
            run = np.repeat(np.arange(len(first)), size)
            held_key, held = key[-1], empty
            open_ = len(first) - 1
            if size[-1] <= small:  # may go on in the next batch
                held, held_info = cls[first[-1] :], info[first[-1] :]
                keep = run < open_
                cls, info, run = cls[keep], info[keep], run[keep]
            else:
                hub = cls[first[-1]]
            at = np.flatnonzero(big[run])
            if len(at):
                give(cls[first[run[at]]], cls[at], info[at], True)
            at = np.flatnonzero(~big[run])
            for step in range(1, small):
                at = at[at + step < len(run)]
                at = at[run[at] == run[at + step]]
                if not len(at):
                    break
                give(cls[at], cls[at + step], np.maximum(info[at], info[at + step]), False)
        if out_a:
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "info": np.concatenate(out_info).astype(np.int32), "large": np.concatenate(out_large)})
    if hub is None and len(held) > 1:
        large = bool((held_info < 0).any())
        i, j = (np.zeros(len(held), int), np.arange(len(held))) if large else np.triu_indices(len(held), 1)
        info = np.abs(held_info[j]) if large else np.maximum(held_info[i], held_info[j])
        yield pd.DataFrame({"a": held[i], "b": held[j], "info": info.astype(np.int32), "large": np.full(len(j), large)})


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def block_links(sets: list[np.ndarray], sides: np.ndarray, labels: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect all that is linked among ``sets``, between the two sides (or, if there is one
    side only, within it); sets of one label are connected already.  Parity bits of all are compared as
    one matrix product."""
    n = np.array([len(s) for s in sets])
    width = 1 << min(13, max(8, int(2 * n.max() - 1).bit_length()))
    sign = np.ones((len(sets), width), np.float32)
    for i, h in enumerate(sets):
        sign[i] -= 2 * (np.bincount((h & _U(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.float32)
    distance = (width - sign @ sign.T) / 2
    most = np.minimum((100 - threshold) * (n[:, None] + n) // (100 + threshold), width)
    near = (distance <= most) & (100 * np.minimum(n[:, None], n) >= threshold * np.maximum(n[:, None], n)) & (labels[:, None] != labels)
    if sides.any() and not sides.all():
        near &= sides[:, None] != sides
    i, j = np.nonzero(np.triu(near, 1))
    order = np.argsort(distance[i, j], kind="stable")
    forest, out = _Forest(len(sets)), []
    for a, b in zip(*_runs(labels), strict=True):
        forest.join(a, b)
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if forest.root(a) != forest.root(b) and linked(sets[a], sets[b], threshold):
            forest.join(a, b)
            out.append((a, b))
    return out


def _runs(labels: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of neighbours among equal labels."""
    order = np.argsort(labels, kind="stable")
    at = np.flatnonzero(labels[order][1:] == labels[order][:-1])
    return order[at].tolist(), order[at + 1].tolist()


def maybe_in(table: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """table with ``_maybe``: false only where the column's value is surely not among ``wanted``'s.

    A bitmap over hashes of the wanted values, of ``WORDS`` words whatever the data, is broadcast; rows
    that it rules out need no shuffle to be told apart.  The more values, the fewer it rules out."""
    h = F.xxhash64(column)
    word, bit = F.pmod(h, F.lit(WORDS)), F.pmod(F.expr(f"xxhash64({column}) div {WORDS}"), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = wanted.select(word.alias("_word"), one.alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    out = table.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    return out.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False))).drop("_word", "_bits")


def _sides(pairs: DataFrame, facts: DataFrame, key: str = "id") -> DataFrame:
    """pairs (a, b) with what facts has beside its key for each, under its name and ``_a`` or ``_b``."""
    for s in "ab":
        pairs = pairs.join(facts.select(F.col(key).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in facts.columns if c != key]), s)
    return pairs


def similar_classes(docs: DataFrame, threshold: int, shingle: int, small: int, block_sets: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(measured rows, classes with their component): a component is named by one of its classes' ids."""
    batches.use(docs.sparkSession)
    bands = Bands(threshold)
    measured = work.write(_measured(docs, shingle), "measured")
    classes = measured.where("class is not null").groupBy("class", "check").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    classes = work.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "class", "info")
    shared = work.write(by_key(_lanes(docs, shingle, bands, small)).mapInArrow(batches.framed(shared_rows), LANE), "shared")
    enough = F.col("lanes") >= F.pmod("info", F.lit(NEED))
    alive = shared.groupBy("class", F.abs("info").alias("info")).agg(F.count("*").alias("lanes")).where(enough).select("class", F.col("info").alias("_info"))
    live = shared.where("info > 0").join(alive.withColumnRenamed("_info", "info"), ["class", "info"], "left_semi").unionByName(shared.where("info < 0"))
    found = by_key(live).mapInArrow(batches.framed(functools.partial(bucket_pairs, small=small)), "a long, b long, info int, large boolean")
    found = work.write(found, "found")
    work.drop(shared)
    met = found.where("not large").groupBy("a", "b", F.floor(F.col("info") / NEED).alias("band")).agg(F.count("*").alias("lanes"), F.max("info").alias("info"))
    pairs = _sides(met.where(enough).select("a", "b").distinct(), classes.select("class", "id", "n", "bits"), "class")
    facts = classes.select("id", "n", "bits")
    banded = None
    if not found.where("large").isEmpty():
        clusters = connected_components(found.where("large").select("a", "b"), work).withColumnRenamed("id", "class")
        band = F.floor(F.log(F.col("n").cast("double")) / _width(threshold)).cast("int")
        banded = work.write(clusters.join(classes.select("class", "id", "n"), "class").select("id", "component", "n", band.alias("band")), "clusters")
        pairs = pairs.select("id_a", "id_b", "n_a", "n_b", "bits_a", "bits_b").unionByName(_sides(_star(banded), facts).withColumnsRenamed({"a": "id_a", "b": "id_b"}))

    def near(parts):
        for x in parts:
            keep = []
            for at, n in batches.parts(x["bits_a"], x["bits_b"]):
                y = x.slice(at, n).to_pydict()
                keep += [(d := most_different(i, j, threshold)) >= 0 and hamming(p, q) <= d for i, j, p, q in zip(y["n_a"], y["n_b"], y["bits_a"], y["bits_b"], strict=True)]
            yield x.select(["id_a", "id_b"]).rename_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        batches.release()

    pairs = work.write(pairs.select("id_a", "id_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(near, "a long, b long").distinct(), "pairs")
    left = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = work.write(_sets(docs, (left.unionByName(banded.select("id")) if banded else left).distinct().join(classes, "id").select("id", "class", "check", "first_id"), shingle), "sets")

    def verified(parts):
        for x in parts:
            keep = []
            for at, n in batches.parts(x["set_a"], x["set_b"]):
                y = x.slice(at, n)
                keep += [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), threshold) for p, q in zip(y["set_a"].to_pylist(), y["set_b"].to_pylist(), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        batches.release()

    links = work.write(_sides(pairs, sets).select("a", "b", "set_a", "set_b").mapInArrow(verified, "a long, b long"), "links")
    labels = work.write(connected_components(links, work), "labels")
    own = classes.select("id", "class", "check", "first_id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if banded is not None:
        more = work.write(_cluster_links(banded, labels, sets, threshold, block_sets, work), "more_links")
        if not more.isEmpty():
            joined = connected_components(more, work).select(F.col("component").alias("whole"), F.col("id").alias("component"))
            own = own.join(work.write(joined, "joined"), "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    return measured, own


def _width(threshold: int) -> float:
    """The logarithm of 100 / threshold, and a little more: links stay within a band of that width or reach the next."""
    return 1.000001 * math.log(100 / threshold) if threshold < 100 else 1.0


def _star(banded: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class of a cluster with two representatives of its size band and of the next ones."""
    place = F.struct(F.xxhash64("id").alias("h"), "id")
    chosen = banded.groupBy("component", "band").agg(F.array(F.min(place)["id"], F.max(place)["id"]).alias("reps"))
    chosen = chosen.select("component", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.explode("reps").alias("rep"))
    met = banded.join(chosen, ["component", "band"]).where(F.col("id") != F.col("rep"))
    return met.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """id and set of the wanted classes (id, class, check, first_id): their first documents, read again and
    known by their digests, so ids that repeat, or are null, meet only the classes of their own texts."""

    def again(parts):
        seen: set[tuple[int, int]] = set()
        for x in parts:
            for texts in batches.texts(x["text"]):
                rows = []
                for t in texts:
                    h = shingle_set(t, shingle)
                    if len(h) and (c := class_of(h)) not in seen:
                        seen.add(c)
                        rows.append((*c, h.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["class", "check", "set"])
        batches.release()

    texts = maybe_in(docs.select("doc_id", "text").where("text is not null"), "doc_id", wanted.where("first_id is not null").select(F.col("first_id").alias("doc_id")))
    made = texts.where("_maybe or doc_id is null").select("text").mapInArrow(again, "class long, check long, set binary")
    return maybe_in(made, "class", wanted).where("_maybe").drop("_maybe").join(wanted.select("id", "class", "check"), ["class", "check"]).select("id", "set").dropDuplicates(["id"])


def _cluster_links(banded: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int, block_sets: int, work: Workspace) -> DataFrame:
    """Links (a, b), between labels, within clusters between classes that aren't connected yet (labels name what is).  A cluster is cut
    by size band; a band's most frequent label is its main one, and its classes with and without that
    are cut into blocks.  A task compares two blocks, of one band or neighbours; two of one main label needn't meet."""
    own = banded.join(labels.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = work.write(own.where("label <> id").groupBy("component", "band", "label").agg(F.count("*").alias("k")), "counts")  # written, so the next sum begins in its tasks
    common = counts.groupBy("component", "band").agg(F.max(F.struct("k", "label"))["label"].alias("main"))
    own = own.join(common, ["component", "band"], "left").withColumn("other", ~F.col("label").eqNullSafe(F.col("main")))
    cells = own.groupBy("component", "band", "main", "other").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    near = cells.select("component", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct("band", "main", "other", "blocks").alias("cell"))
    near = near.groupBy("component", "band").agg(F.collect_list("cell").alias("cells"))  # six at most
    own = own.join(cells.drop("main"), ["component", "band", "other"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    place = lambda b, o, k: F.struct(b.alias("band"), o.alias("other"), k.alias("block"))
    me = place(F.col("band"), F.col("other"), F.col("block"))

    def meets(c):
        there = lambda k: place(c["band"], c["other"], k)
        return F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda k: F.struct(F.least(me, there(k)).alias("low"), F.greatest(me, there(k)).alias("high")))

    apart = F.filter("cells", lambda c: F.col("other") | c["other"] | ~c["main"].eqNullSafe(F.col("main")))
    placed = own.join(near, ["component", "band"]).select("id", "component", "label", me.alias("me"), F.explode(F.flatten(F.transform(apart, meets))).alias("m"))
    placed = placed.select("id", "component", "label", "m.low", "m.high", (F.col("me") == F.col("m.high")).alias("upper")).join(sets, "id").drop("id")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(s, np.uint64) for s in x["set"]]
        out = block_links(hashes, x["upper"].to_numpy(bool), x["label"].to_numpy(), threshold) if len(x) > 1 else []
        label = x["label"].to_numpy()
        return pd.DataFrame([(label[a], label[b]) for a, b in out], columns=["a", "b"], dtype="int64")

    return placed.groupBy("component", "low", "high").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE, small: int = SMALL, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    n_shingles is the size of the set of distinct ``shingle``-word shingles of the whole text; sets link
    when 100 * intersection >= threshold * union; component_id is the smallest doc_id reachable.  Rows
    without words or text have an empty set, no links and their own id.  Rows that repeat an id get a row
    each, with links of their own text.  Null ids stay null unless linked to others; an empty table gives
    no rows.
    """
    measured, lookup = _found(docs, threshold, shingle, small, block_sets, Workspace(docs.sparkSession))
    return _named(measured, lookup)


def _found(docs: DataFrame, threshold: int, shingle: int, small: int, block_sets: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(measured rows, lookup): component, named by one of its classes, and least_id of each class."""
    measured, own = similar_classes(docs, threshold, shingle, small, block_sets, work)
    own = work.write(own, "named")
    work.keep(measured, own)
    least = own.groupBy("component").agg(F.min("first_id").alias("least_id"))
    return measured, own.join(least, "component").select("class", "check", "component", "least_id")


def _named(measured: DataFrame, lookup: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each measured row."""
    lookup = lookup.select("class", "check", "least_id")
    some = measured.where("class is not null").select("doc_id", "n_shingles", "class", "check").join(lookup, ["class", "check"], "left")
    none = measured.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("least_id"))
    return some.select("doc_id", "n_shingles", "least_id").unionByName(none).withColumnRenamed("least_id", "component_id")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """docs without near duplicates: of each component the document with the smallest doc_id.

    Documents without words link with nothing and stay.  Rows that repeat an id and its text become one
    row; those that repeat an id with other texts are judged each by its own text, and of several in one
    component one stays.  Rows with a null id can't be named as anyone's copy and stay, all of them.
    """
    work = Workspace(docs.sparkSession)
    measured, lookup = _found(docs, threshold, shingle, SMALL, BLOCK_SETS, work)
    judged = work.write(_named(measured, lookup).where("doc_id is not null").select("doc_id", "component_id"), "judged")
    own, back = set_aside(docs, ["_word", "_bits", "_maybe", "_told", "_text", "_class", "_check", "_component", "_least", "_place"])
    named = own.where("doc_id is not null")
    gone, firsts = judged.where("doc_id <> component_id").select("doc_id"), judged.where("doc_id = component_id").select("doc_id").distinct()
    repeats = work.write(judged.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    if repeats.isEmpty():
        marked = maybe_in(named, "doc_id", gone)
        kept = marked.where("not _maybe").unionByName(marked.where("_maybe").join(firsts, "doc_id", "left_semi"))
    else:
        marked = maybe_in(named, "doc_id", gone.unionByName(repeats))
        again = marked.where("_maybe").join(firsts.join(repeats, "doc_id", "left_anti"), "doc_id", "left_semi")
        kept = marked.where("not _maybe").unionByName(again).drop("_maybe")
        kept = kept.unionByName(_one_of_repeats(marked.where("_maybe").drop("_maybe").join(repeats, "doc_id", "left_semi"), lookup, shingle))
    return back(kept.select([f"`{c}`" for c in own.columns])).select([f"`{c}`" for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def _one_of_repeats(rows: DataFrame, lookup: DataFrame, shingle: int) -> DataFrame:
    """Of rows whose ids repeat: one of each id and component that the id names, one of each text without words."""

    @F.arrow_udf("class long, check long")
    def classes(texts: pa.Array) -> pa.Array:
        told = []
        for some in batches.texts(texts):
            told += [dict(zip(("class", "check"), class_of(h), strict=True)) if len(h) else {"class": None, "check": None} for h in (shingle_set(t, shingle) for t in some)]
        batches.release()
        return pa.array(told, pa.struct([("class", pa.int64()), ("check", pa.int64())]))

    lookup = lookup.select(F.col("class").alias("_class"), F.col("check").alias("_check"), F.col("component").alias("_component"), F.col("least_id").alias("_least"))
    told = rows.withColumn("_told", classes("text")).withColumns({"_class": F.col("_told.class"), "_check": F.col("_told.check"), "_text": F.md5(F.col("text").cast("binary"))})
    told = told.drop("_told").join(lookup, ["_class", "_check"], "left")
    first = told.where(F.col("_class").isNull() | (F.col("doc_id") == F.col("_least")))
    order = Window.partitionBy("doc_id", "_component", F.when(F.col("_class").isNull(), F.struct(F.col("text").isNull(), "_text"))).orderBy("_text")
    return first.withColumn("_place", F.row_number().over(order)).where("_place = 1").select([f"`{c}`" for c in rows.columns])
