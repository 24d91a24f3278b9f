"""Quality rules by distribution divergence, in built-in functions only.

Each text is measured (words, symbols, repeated lines and 3-word windows) and its
character-class and common-word histograms are compared with language references by
Jensen-Shannon distance.  The references are the summed histograms of all documents of
the languages that have a list of common words, so they cover the whole corpus; they
come back as at most ``len(COMMON_WORDS)`` rows and enter the plan as constants.

Two scans of the texts, no shuffle of texts, no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import set_aside

#: Frequent function words of the reference languages.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this", "or", "at", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "au", "sur"],
}
#: Classes of the character histogram.  ``beyond_ascii`` counts the bytes that a text has above one a character.
CHAR_CLASSES = ("space", "symbol", "digit", "beyond_ascii", "other")
SYMBOLS = "[#*$%&|<>]"
SPACES = " \t\n\x0b\f\r"

#: Names of columns that come and go on the way, and of those that stay.
WORKING = ("_words", "_bits", "_at", "_sorted", "_wide", "_pairs", "_where", "_repeats", "_lines", "_chars", "_common", "_found", "_starts", "_length", "_in_words", "_symbols", "_digits", "_more_bytes", "_total", "_entries")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "divergence")

MIN_WORDS = 50  # fewer words fail the base rule
MAX_REPEAT_PERCENT = 50  # so do texts with a larger share of repeated words
GUARD_WORDS = 50  # the common-word histogram counts from here on
GUARD_CHARS = 200  # the character histogram counts from here on
MAX_DISTANCE = 0.5  # mean Jensen-Shannon distance (base 2, 0 to 1) to the nearest reference


def _measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column ``_q``: words, windows and the counts made from them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return docs.withColumn("_words", words)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeats(docs: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """Adds ``_repeats``: words in 3-word windows that the text has twice or more.

    First pass: a window is a hash shifted left by as many bits as positions need, with its position in the
    low bits; a sort of primitives brings equal windows together, and equal neighbours may be repeated.
    Second pass: these few are sorted by their words, which decide.  A covered word counts once.
    """
    n = F.size("_words")
    bits = F.length(F.bin(n.cast("long")))
    sequence = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: hashed(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    docs = docs.withColumn("_bits", bits).withColumn("_at", sequence)
    docs = docs.withColumn("_sorted", F.sort_array(F.transform("_at", lambda i: F.call_function("shiftleft", window(i), F.col("_bits")).bitwiseOR(i.cast("long")))))
    equal = lambda x, i: F.coalesce(F.call_function("shiftright", x.bitwiseXOR(F.get("_sorted", i)), F.col("_bits")) == 0, F.lit(False))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1
    docs = docs.withColumn("_pairs", F.filter("_sorted", lambda x, i: equal(x, i + 1) | equal(x, i - 1)))
    place = lambda x: x.bitwiseAND(low).cast("int")
    said = lambda i: F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))  # noqa: E731  # words have no spaces
    docs = docs.withColumn("_wide", F.sort_array(F.transform("_pairs", lambda x: F.struct(said(place(x)).alias("w"), place(x).alias("i")))))
    same = lambda x, i: F.coalesce(F.get("_wide", i)["w"] == x["w"], F.lit(False))
    docs = docs.withColumn("_where", F.sort_array(F.transform(F.filter("_wide", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"].cast("long"))))
    covered = F.transform("_where", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_where", i + 1) - p, F.lit(3).cast("long"))))
    return docs.withColumn("_repeats", F.coalesce(_sum(covered), F.lit(0).cast("long"))).drop("_bits", "_at", "_sorted", "_wide", "_where", "_pairs")


def _histograms(docs: DataFrame) -> DataFrame:
    """Adds ``_chars`` and ``_common``, arrays of (bin, n), and what the former is made from."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    docs = docs.withColumns(
        {
            "_length": F.length(text).cast("long"),
            "_in_words": F.length(F.array_join("_words", "")).cast("long"),
            "_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "_digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
            "_more_bytes": F.octet_length(text).cast("long") - F.length(text),
        }
    )
    rest = F.greatest(F.col("_in_words") - F.col("_symbols") - F.col("_digits") - F.col("_more_bytes"), F.lit(0).cast("long"))
    counts = (F.col("_length") - F.col("_in_words"), F.col("_symbols"), F.col("_digits"), F.col("_more_bytes"), rest)
    docs = docs.withColumn("_chars", F.array(*[F.struct(F.lit(k).alias("bin"), c.alias("n")) for k, c in zip(CHAR_CLASSES, counts, strict=True)]))
    written = sorted({x for w in every for x in (w, w.capitalize(), w.upper())})
    docs = docs.withColumn("_found", F.sort_array(F.transform(F.filter("_words", lambda w: w.isin(written)), F.lower)))
    docs = docs.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size("_found")), lambda i: (i < F.size("_found")) & ((i == 0) | (F.get("_found", i) != F.get("_found", i - 1)))))
    run = lambda s, i: F.struct(F.get("_found", s).alias("bin"), (F.coalesce(F.get("_starts", i + 1), F.size("_found")) - s).cast("long").alias("n"))
    return docs.withColumn("_common", F.transform("_starts", run)).drop("_found", "_starts")


def references(docs: DataFrame) -> dict[str, dict[str, dict[str, float]]]:
    """language -> histogram -> bin -> share, over all documents of the languages with a word list.

    Languages without any document have no reference; an empty table gives an empty dict.
    """
    known = docs.select("text", "lang").where(F.col("lang").isin(sorted(COMMON_WORDS)))
    parts = _histograms(_measured(known)).select(
        "lang",
        F.explode(F.concat(F.transform("_chars", lambda x: F.struct(F.lit("chars").alias("h"), x["bin"].alias("bin"), x["n"].alias("n"))), F.transform("_common", lambda x: F.struct(F.lit("common").alias("h"), x["bin"].alias("bin"), x["n"].alias("n"))))).alias("x"),
    )
    rows = parts.groupBy("lang", "x.h", "x.bin").agg(F.sum("x.n").alias("n")).collect()  # languages x bins
    out: dict[str, dict[str, dict[str, float]]] = {}
    for lang in sorted({r.lang for r in rows}):
        for h in ("chars", "common"):
            own = {r.bin: r.n for r in rows if r.lang == lang and r.h == h and r.n}
            out.setdefault(lang, {})[h] = {k: v / sum(own.values()) for k, v in sorted(own.items())}
    return out


def _part(p: Column, q: Column) -> Column:
    """A bin's part of the divergence of p from q, beyond q / 2 for each bin of q."""
    term = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return (term(p) + term(q) - q) / 2


def _char_distance(share: dict[str, float]) -> Column:
    """Jensen-Shannon distance of ``_chars`` to a reference, as plain arithmetic over its few bins."""
    total = F.col("_length").cast("double")
    parts = [_part(F.get("_chars", i)["n"] / total, F.lit(share.get(k, 0.0))) for i, k in enumerate(CHAR_CLASSES)]
    return F.sqrt(F.greatest(F.lit(0.5) + sum(parts[1:], parts[0]), F.lit(0.0)))


def _common_distances(refs: list[dict[str, float]]) -> tuple[Column, Column, list[Column]]:
    """(number of common words, entries, distance to each reference); entries pair a word's share with its reference
    shares, so each word is looked up once.  Without common words, or a reference, the distance is 1."""
    words = sorted({w for r in refs for w in r})
    shares = F.create_map(*[x for w in words for x in (F.lit(w), F.array(*[F.lit(r.get(w, 0.0)) for r in refs]))]) if words else None
    total = _sum(F.transform("_common", lambda x: x["n"])).cast("double")
    none = F.array(*[F.lit(0.0)] * len(refs))
    looked_up = lambda w: F.coalesce(F.element_at(shares, w), none) if words else none
    entries = F.transform("_common", lambda x: F.struct((x["n"] / F.col("_total")).alias("p"), looked_up(x["bin"]).alias("q")))
    one = lambda i: F.lit(0.5) + F.aggregate("_entries", F.lit(0.0), lambda a, x: a + _part(x["p"], F.get(x["q"], F.lit(i))))
    distance = lambda i, r: F.when((F.col("_total") > 0) & bool(r), F.sqrt(F.greatest(one(i), F.lit(0.0)))).otherwise(1.0)
    return total, entries, [distance(i, r) for i, r in enumerate(refs)]


def judge(docs: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    divergence (null where both guards hold it back) and kept; columns of these names are replaced.

    Null text measures as empty, and fails the base rule as any text under ``MIN_WORDS`` words does.
    Rows are judged one by one, so repeated rows get equal verdicts and an empty table stays empty.
    A text is kept if the base rule holds and its divergence from the nearest language reference is at
    most ``max_distance`` or can't be told (guards, or no reference at all).
    """
    refs = references(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs, back = set_aside(docs, WORKING)
    out = _histograms(_repeats(_measured(docs))).withColumn("_lines", lines)
    n = F.size("_words").cast("long")
    divergence = F.lit(None).cast("double")
    if refs:
        total, entries, by_words = _common_distances([r["common"] for r in refs.values()])
        out = out.withColumn("_total", total).withColumn("_entries", entries)
        both = [(_char_distance(r["chars"]) + w) / 2 for r, w in zip(refs.values(), by_words, strict=True)]
        chars = [_char_distance(r["chars"]) for r in refs.values()]
        nearest = lambda x: F.least(*x) if len(x) > 1 else x[0]
        divergence = F.when(F.col("_length") < GUARD_CHARS, divergence).when(n >= GUARD_WORDS, nearest(both)).otherwise(nearest(chars))
    out = out.withColumns(
        {
            "n_words": n,
            "word_chars": F.col("_in_words"),
            "n_symbols": F.col("_symbols"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.col("_repeats"),
            "divergence": divergence,
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    # A filter on kept that is pushed below the projections which it is made in would hold every expression written out
    # in place again and again.  Spark neither copies nor moves what isn't deterministic, hence the row number (always >= 0).
    near = F.coalesce(F.col("divergence") <= max_distance, F.lit(True))
    out = out.withColumn("kept", ~F.col("base_failed") & near & (F.monotonically_increasing_id() >= 0))
    return back(out.drop(*WORKING))


def passing(docs: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The rows of docs that ``judge`` keeps, with their own columns; null texts, empty ones and repeated rows
    as told there."""
    own, back = set_aside(docs, ["kept", *MEASURES])
    return back(judge(own, max_distance).where("kept").select([f"`{c}`" for c in own.columns]))
