"""Every query of the core against its SQL, in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def values(frame):
    return sorted(map(str, frame[sorted(frame)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert values(got) == values(want)


def test_office_queries(spark, sf):
    texts = {r.path: r.text for r in QUERIES["office_texts"](spark, sf).collect()}
    assert texts["a.docx"] == "AFRICA AMERICA ASIA EUROPE MIDDLE EAST"
    assert [x.split(":")[0] for x in texts["b.pptx"].split("\n")] == ["Slide 1", "Slide 10", "Slide 11", "Slide 2", "Slide 3"]
    assert [tuple(r) for r in QUERIES["office_sheet"](spark, sf).collect()][0] == (2, "AMERICA", "20")
    assert QUERIES["office_cells"](spark, sf).count() == 10
    assert QUERIES["office_members"](spark, sf).count() == 8


def test_scans_are_pushed_down(spark, sf):
    plan = QUERIES["skills_counts_by_user"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "documents" in x]
    assert scans and all("text" not in x.split("ReadSchema")[-1] for x in scans)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize(
    ("text", "source", "lang"),
    [("A line of twenty-three..\nx", "src0", "en"), ("A line of twenty-two.!!\nx", "src0", "en"), ("\tTab", "src1", "en"), ("", "src0", "en"), ("  ", "src1", "en"), (" ", "src1", "en"),
     ("ΟΔΟΣ", "src1", "en"), ("İ", "src1", "en"), (None, "src0", "en"), (None, "src1", "en"), ("Name", "src1", None), ("Name", None, "en")],
)
def test_upsert_of_odd_names_matches_sql(spark, sf, tmp_path, text, source, lang):
    rows = [(i, f"Text {i}", "en", "src0") for i in range(20)] + [(20, text, lang, source), (21, "οδοσ", "en", "src0"), (22, "i", "en", "src0"), (40, "text 3", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for t in ("labels", "nation"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = QUERIES["skills_upsert"](spark, str(tmp_path)).collect(), con.execute(ORACLE_SQL["skills_upsert"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_short_columns_join_without_texts(spark, sf):
    """What the registry's queries cut out of texts is cut before labels are joined."""
    nodes, joins = [QUERIES["skills_upsert"](spark, sf)._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
        joins += [node.output().mkString(" ")] if node.nodeName() == "Join" else []
    assert joins and not [x for x in joins if "text#" in x or "content#" in x]
