"""Secret scans: all rules compiled into one minimal automaton that reads the bytes once.

The automaton (``automaton.py``) tells where matches may end first; from these few places the rule's
reversed automaton finds the leftmost start and its own one the end, which gives leftmost,
non-overlapping matches per rule.  Matches
that fail their rule's length are dropped after they have taken their place, as a regex search would.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import automaton, batches
from .columns import set_aside


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int  # characters of the match, or of its value
    fold: bool = False  # letters in either case
    value: str = ""  # regex whose last group is the value that ``least`` counts


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules, then added ones; kinds are listed in this order.
BASE = (
    Rule("assign", _ASSIGN, 8, fold=True, value=_ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{8}[0-9a-f]*", 32),  # runs under 8 could not pass; counting to 32 here would take many more states
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
)
RULES = BASE + ADDED
BATCH_BYTES = 8 << 20  # bytes that are scanned together


class Scanner:
    """The compiled rules; small arrays that go to the workers with the function that uses them."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.dfa, self.back, self.forward = automaton.compile_rules([(r.pattern, r.fold) for r in rules])
        self.values = [re.compile(r.value.encode(), re.I if r.fold else 0) if r.value else None for r in rules]

    def _passes(self, k: int, match: bytes) -> bool:
        if self.values[k] is not None:
            found = self.values[k].fullmatch(match)
            match = found[found.re.groups] if found else b""
        return len(match) >= self.rules[k].least

    def _of_text(self, data: bytes, ends: np.ndarray, accepts: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of one text, from the places where matches may end."""
        out = []
        for k in range(len(self.rules)):
            own = ends[(accepts >> k) & 1 == 1]
            if not len(own):
                continue
            floor = 0
            for e in own.tolist():
                if e < floor:
                    continue
                start = automaton.first_start(self.back[k], data, floor, e + 1)
                if start >= 0:
                    floor = automaton.last_end(self.forward[k], data, start)
                    if self._passes(k, data[start:floor]):
                        out.append((start, k, floor))
        return sorted(out)

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Per text its spans (kind, start, end in code points) by start and then kind as listed."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        batch: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            if t:
                batch.append((i, t.encode("utf-8")))
                size += len(batch[-1][1]) + 1
                if size >= BATCH_BYTES:
                    self._scan(batch, out)
                    batch, size = [], 0
        self._scan(batch, out)
        return out

    def _scan(self, batch: list[tuple[int, bytes]], out: list[list[tuple[str, int, int]]]) -> None:
        data = np.frombuffer(b"\xff".join(b for _, b in batch), np.uint8)
        at, states = automaton.scan(self.dfa, data)
        starts = np.cumsum([0, *(len(b) + 1 for _, b in batch)])
        own = np.searchsorted(starts, at, "right") - 1
        for k in np.unique(own):
            i, text = batch[k]
            here = own == k
            found = self._of_text(text, at[here] - starts[k], self.dfa.accept[states[here]])
            if found:
                place = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # code points up to and with a byte
                out[i] = [(self.rules[r].kind, int(place[s]) - 1, int(place[e - 1])) for s, r, e in found]


@functools.cache
def _scanner() -> Scanner:
    return Scanner()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans (columns of these names are replaced).

    spans: ``kind:start:end`` of all rules by start and then kind as listed, joined by commas; code
    points, end exclusive.  base_sha256: digest of the same for the base rules.  A null text is empty.
    """
    scanner, base = _scanner(), {r.kind for r in BASE}

    kind = pa.struct([*((f"n_{r.kind}", pa.int64()) for r in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for some in batches.texts(texts):
            for spans in scanner.spans(some):
                kinds = [k for k, _, _ in spans]
                digest = hashlib.sha256(joined([s for s in spans if s[0] in base]).encode()).hexdigest()
                rows.append({f"n_{r.kind}": kinds.count(r.kind) for r in BASE} | {"base_sha256": digest, "spans": joined(spans)})
        batches.release()
        return pa.array(rows, kind)

    batches.use(docs.sparkSession)
    kept, back = set_aside(docs.drop("n_assign", "n_access", "n_hex", "base_sha256", "spans"), ["_found"])
    return back(kept.withColumn("_found", found("text")).select(*[F.col(f"`{c}`") for c in kept.columns], "_found.*"))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or what overlapping spans cover together, replaced by ``[KIND]`` of the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in ``text`` replaced by their kind; a null text stays null."""
    scanner = _scanner()

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        out = [pa.array([redact_text(t, s) if s else t for t, s in zip(some, scanner.spans(some), strict=True)], pa.string()) for some in batches.texts(texts)]
        batches.release()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    batches.use(docs.sparkSession)
    return docs.withColumn("text", cleaned("text"))
