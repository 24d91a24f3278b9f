"""Byte-level BPE with forced boundaries.

A byte pair that is inside no vocabulary token can't be inside any merge, so a text may be cut between
its two bytes and the fragments encoded one by one.  The cut must also leave the pre-tokenizer's pieces
alone, hence the conditions in ``forced_cuts`` and ``Encoder.fragments``.  Fragments are mostly single
words and recur, so each worker keeps the ids of short fragments it has seen, up to ``KEPT_BYTES``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import batches
from .columns import set_aside

#: Fixed value: the pre-tokenizer's pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_BYTES, KEPT_LENGTH = 16 << 20, 64  # of a worker's fragments with their ids, which it forgets beyond; and of a fragment that is kept
ENTRY = 200  # bytes that an entry takes beside its contents
#: White space beyond ASCII, as the pattern's ``\s`` has it.
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What the file must say of itself, as the code here does no other thing; absent parts count as None.
EXPECTED = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False},
}


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the alphabet in which such vocabularies are written: printable Latin-1
    characters stand for themselves, the other bytes for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_spec(spec: dict) -> None:
    """Raises ValueError for a tokenizer file of another kind than this module encodes as."""
    for part, wanted in EXPECTED.items():
        own = spec.get(part)
        if wanted is None and own is not None:
            raise ValueError(f"a tokenizer file with a {part} is not supported")
        for k, v in (wanted or {}).items():
            if (own or {}).get(k, {"use_regex": True}.get(k)) not in ((v, None) if v is False else (v,)):
                raise ValueError(f"{part}.{k} of the tokenizer file must be {v}, not {own.get(k) if own else None}")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must be taken as they are written")
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    if None in made or any(a >= b for a, b in zip(made, made[1:])):  # noqa: B905
        raise ValueError("ids of merged tokens must rise with their merges")


def forced_cuts(tokens: list[bytes]) -> np.ndarray:
    """A table over 256 * left + right: certain cuts between the last byte of a character and the first of the next.

    Besides being inside no token, the left byte must not be ASCII white space or control (a run of white space
    is split by what follows it), the right byte must begin a character, neither must be an apostrophe
    (which begins a contraction only where no other mark is before it), and pairs inside contractions stay."""
    inside = np.zeros(65536, bool)
    for t in [*tokens, *(c.encode() for c in re.findall("'([a-z]+)", PATTERN))]:
        b = np.frombuffer(t, np.uint8).astype(np.int64)
        inside[b[:-1] * 256 + b[1:]] = True
    left, right = np.divmod(np.arange(65536), 256)
    begins = (right < 0x80) | (right >= 0xC0)
    ends = ((left > 0x20) & (left < 0x7F)) | ((left >= 0x80) & (left < 0xC0))
    return ~inside & begins & ends & (left != ord("'")) & (right != ord("'"))


class Encoder:
    """Encodes and decodes as the tokenizer file says; made from the file's text."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        check_spec(model)
        letters = _byte_letters()
        self.specials = {t["content"]: t["id"] for t in model["added_tokens"]}
        tokens = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in self.specials}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.cuts = forced_cuts(list(tokens))
        self.space = re.compile("|".join(WIDE_SPACES).encode())
        self.bytes_of = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in self.specials.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.seen: dict[bytes, bytes] = {}
        self.held = 0

    def fragments(self, data: bytes) -> list[bytes]:
        """data cut at every certain boundary, but for those after white space beyond ASCII."""
        b = np.frombuffer(data, np.uint8)
        pair = b[:-1].astype(np.uint16) << 8 | b[1:]
        cut = np.flatnonzero(self.cuts[pair])
        wide = [m.end() - 1 for m in self.space.finditer(data)]
        if wide:
            cut = np.setdiff1d(cut, wide, assume_unique=True)
        at = [0, *(cut + 1).tolist(), len(data)]
        return [data[i:j] for i, j in zip(at, at[1:])]  # noqa: B905

    def _plain(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a text without special tokens."""
        data, seen = text.encode("utf-8"), self.seen
        if len(data) < 2:
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        parts = self.fragments(data)
        new = set(parts).difference(seen)
        for f in new:
            seen[f] = np.array(self.bpe.encode_ordinary(f.decode("utf-8")), "<u4").tobytes()
        out = b"".join([seen[f] for f in parts])
        for f in new:
            if len(f) > KEPT_LENGTH:
                del seen[f]
            else:
                self.held += len(f) + len(seen[f]) + ENTRY
        if self.held > KEPT_BYTES:
            seen.clear()
            self.held = 0
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if self.splitter is None or not any(s in text for s in self.specials):
            return self._plain(text)
        return b"".join(self.specials[p].to_bytes(4, "little") if p in self.specials else self._plain(p) for p in self.splitter.split(text) if p)

    def decode(self, ids: bytes) -> str:
        """The text of such ids, special tokens written out; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


class Tokenizer:
    """A tokenizer file, read on the driver and sent to the workers once (a vocabulary, of fixed size)."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = spark.sparkContext.broadcast(f.read())

    def __getstate__(self):
        return {"spec": self.spec}

    @property
    def encoder(self) -> Encoder:
        return _encoder(self.spec.value)


def encode(text: Column, tokenizer: Tokenizer) -> Column:
    """Binary column of ids, little-endian unsigned 32-bit; null texts give no ids."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = tokenizer.encoder
        return pa.array([encoder.encode(t) for some in batches.texts(texts) for t in some], pa.binary())

    return ids(text)


def decode(ids: Column, tokenizer: Tokenizer) -> Column:
    """Text of a binary column of ids; null stays null."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        encoder = tokenizer.encoder
        return pa.array([None if v is None else encoder.decode(v) for some in batches.texts(values) for v in some], pa.string())

    return text(ids)


def round_trip(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 (columns of these names are replaced).

    Each text is encoded whole and its ids decoded again, in one pass; ids and decoded texts stay in the
    worker.  Null and empty texts have no tokens and the digests of nothing; repeated rows are alike.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pa.Array) -> pa.Array:
        encoder, out = tokenizer.encoder, []
        for some in batches.texts(texts):
            for t in some:
                ids = encoder.encode(t)
                out.append({"n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest()})
        batches.release()
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    batches.use(docs.sparkSession)
    kept, back = set_aside(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), ["_trip"])
    return back(kept.withColumn("_trip", digests("text")).select(*[F.col(f"`{c}`") for c in kept.columns], "_trip.*"))
