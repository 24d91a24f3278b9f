"""The registered queries against SQL, or against brute force where SQL can't express them."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.queries import N_SHARDS, ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    rows = lambda f: sorted(map(str, f[sorted(f)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_op1(spark, sf, docs):
    got = QUERIES["op1_sharding"](spark, sf).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    sizes = got.groupby("shard").slot.agg(["size", "max", "min", "nunique"]).reindex(range(N_SHARDS), fill_value=0)
    assert sizes["size"].max() - sizes["size"].min() <= 1
    assert (sizes["nunique"] == sizes["size"]).all() and (sizes["max"] == sizes["size"] - 1).all()
    assert (got["size"] == got.text.map(lambda t: len(t.encode()) + 16)).all()
    assert (got.text_crc32 == got.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert (got.groupby("text").shard.nunique() == 1).all()  # small groups stay together


def test_op3(spark, sf, docs):
    got = QUERIES["op3_language_id"](spark, sf).toPandas().merge(docs, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() >= 0.95


def test_op4(spark, sf, docs, library):
    got = QUERIES["op4_packing"](spark, sf).toPandas()
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 1], 0
        for p in got[got.doc_id == i].sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    last = got.sequence_id.max()
    for s, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() == 2048 or s == last


def test_op6(spark, sf, docs, library):
    got = QUERIES["op6_bpe"](spark, sf).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text) if len(m[g]) >= least]
    return [(BASE[k][0], s, e) for s, k, e in sorted(found)]


def test_op7(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table with secrets
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = QUERIES["op7_secret_scan"](spark, sf).toPandas().set_index("doc_id")
    met = 0
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        want = base_spans(text)
        kinds = collections.Counter(k for k, _, _ in want)
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        row = got.loc[i]
        assert (row.n_assign, row.n_access, row.n_hex, row.base_sha256) == (kinds["assign"], kinds["access"], kinds["hex"], digest)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(row.spans.split(","))
        met += len(want)
    assert met
