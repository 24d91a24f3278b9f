"""The pipeline's stages, each on its own input, against brute force; and cases planted in it."""

import re

import pytest

import corpus_pipeline
from sparkloom.llm.queries import tokenizer

from .test_contracts import base_spans
from .test_operators import DOCS, brute_components, brute_quality


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = docs.where("doc_id = 1").first().text
    words = docs.where("doc_id = 0").first().text.split()
    near = list(words)
    near[50] = "changed"
    planted = [(9001, " ".join(words), "fr"), (9002, " ".join(words), "fr"), (9003, " ".join(near), "fr"), (9004, None, None), (9005, "12345 67890", "en"), (9006, clean + " password = hunter2hunter2 end", "en"), (None, clean + " unnamed", "en")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in planted], DOCS))
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"file://{at}/{name}")
        docs = spark.read.parquet(f"file://{at}/{name}")
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s) == list(stages[0]) for s in stages[:-1])


def test_language(stages):
    before, after = stages[0], stages[1]
    gone = set(before.doc_id.dropna()) - set(after.doc_id.dropna())
    assert {9004, 9005} <= gone
    assert all(not re.search(r"[^\W\d_]", t or "") for t in before[before.doc_id.isin(gone)].text)
    assert set(after.lang) <= {"de", "en", "es", "fr"}


def test_quality(stages):
    before, after = stages[1], stages[2]
    left = set(after.doc_id.dropna())
    for i, t in zip(before.doc_id, before.text, strict=True):
        n, _, symbols, _, repeats = brute_quality(t)
        if n < 50 or 100 * repeats > 50 * n:
            assert i not in left
        elif symbols == 0 and i == i:
            assert i in left


def test_duplicates(stages):
    before, after = stages[2].dropna(subset=["doc_id"]).sort_values("doc_id"), stages[3]
    texts, ids = before.text.tolist(), before.doc_id.tolist()
    _, roots = brute_components(texts, 5, 80)
    assert sorted(after.doc_id.dropna()) == sorted({ids[r] for r in roots})
    assert not {9002, 9003} & set(after.doc_id)


def test_secrets(stages):
    before, after = stages[3].set_index("doc_id"), stages[4].set_index("doc_id")
    assert len(before) == len(after)
    for i in before.index.dropna():
        old, new = before.text[i], after.text[i]
        assert (old == new) == (not base_spans(old)) or "[" in new
        assert not base_spans(new) and after.n_chars[i] == len(new)


def test_packing(spark, stages):
    docs, pieces = stages[4], stages[5]
    encoder = tokenizer(spark).encoder
    whole = {i: encoder.encode(t) + (1).to_bytes(4, "little") for i, t in zip(docs.doc_id, docs.text, strict=True) if i == i}
    for i, own in pieces.sort_values("start").dropna(subset=["doc_id"]).groupby("doc_id"):
        assert b"".join(own.ids) == whole[i]
    sums = pieces.groupby("sequence_id").length.sum()
    assert (sums.iloc[:-1] == 2048).all()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_tables(spark, sf, stage):
    """Nulls in all columns, repeated rows, clashing further columns, and no rows at all."""
    from pyspark.sql import functions as F

    text = " ".join(f"the word{i}" for i in range(60))
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " more", None), (3, None, "en"), (4, "", None), (None, text, "en"), (None, None, None)]
    table = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    for name in ("_words", "_lang", "lang_pred", "score", "kept", "n_words", "_text", "_class", "class", "ids", "task", "n"):
        table = table.withColumn(name, F.lit(7))
    name, function = stage
    out = function(spark, table, sf)
    got = out.collect()
    empty = function(spark, table.limit(0), sf)
    assert empty.collect() == [] and empty.columns == out.columns
    if name == "packing":
        assert sum(r.length for r in got if r.start + r.length == r.doc_tokens) > 0 and len({r.sequence_id for r in got}) >= 1
        return
    assert out.columns == table.columns and all(r.score == r.kept == r["class"] == 7 for r in got)
    ids = sorted(str(r.doc_id) for r in got)
    assert ids == {
        "language": ["1", "1", "2", "None"],
        "quality": ["1", "1", "2", "None"],
        "duplicates": ["1", "3", "4", "None", "None"],
        "secrets": ["1", "1", "2", "3", "4", "None", "None"],
    }[name]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
