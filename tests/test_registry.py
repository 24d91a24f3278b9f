"""Rules of the registry, one by one, and random programs against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import registry
from sparkloom.operators.mutate import Registry, User, Valves, delete_many, update_many, upsert_many
from sparkloom.sources.snapshots import SnapshotStore

ROWS = [
    ("1", "u", "Beta", "d1", "c1", True, 5, None, 1),
    ("2", "u", "alpha", None, None, None, 0, None, 2),
    ("3", "u", None, "d3", "c3", False, None, None, 3),
    ("4", "v", "BETA", "d4", "c4", True, 7, None, 4),
    ("5", "u", " Beta ", "d5", "c5", True, 9, None, 5),
]


@pytest.fixture()
def state(spark):
    return spark.createDataFrame(ROWS, registry.SCHEMA)


def make(state, **kw):
    return Registry(state, User("u"), **{"new_id": lambda: "new", "now": lambda: 100} | kw)


def test_list_projection_and_order(state):
    rows = registry.list_skills(state, "u").collect()
    assert [r.id for r in rows] == ["3", "5", "2", "1"]  # null as empty, then " beta "
    by = {r.id: r for r in rows}
    assert (by["2"].name, by["2"].description, by["2"].is_active, by["2"].updated_at) == ("alpha", None, False, "")
    assert (by["1"].is_active, by["1"].updated_at) == (True, "5")
    assert "content" not in rows[0] and "content" in registry.list_skills(state, "u", True).columns
    assert all(r.is_active for r in registry.list_skills(state.drop("is_active"), "u").collect())


@pytest.mark.parametrize(
    ("skill_id", "name", "want"),
    [("1", "", "1"), (" 1 ", "", "1"), ("", "BETA", "1"), ("5", "beta", "1"), ("2", "beta", "1"), ("", " beta ", "1"), ("", "", None), (" ", "\t", None), ("9", "alpha", "2"), ("4", "", None)],
)
def test_first_match(state, skill_id, name, want):
    got = registry.find_skill(state, "u", skill_id, name).first()
    assert (got and got.id) == want
    req = state.sparkSession.createDataFrame([("r", "u", skill_id, name)], "req_id string, user_id string, skill_id string, name string")
    batch = registry.first_matches(state, req).first()
    assert (batch and batch.id) == want


def test_counts_and_collisions(spark, state):
    assert {r.user_id: (r["count"], r.active_count) for r in registry.counts(state).collect()} == {"u": (4, 2), "v": (1, 1)}
    assert registry.name_collisions(state).count() == 0
    more = state.unionByName(state.where("id = '1'").withColumn("id", F.lit("6")).withColumn("name", F.lit("bETA")))
    assert sorted(r.id for r in registry.name_collisions(more).collect()) == ["1", "6"]
    ask = spark.createDataFrame([("u", "1", "BETA"), ("u", "2", "beta"), ("u", "3", " ")], "user_id string, id string, new_name string")
    assert [r.id for r in registry.rename_conflicts(state, ask).collect()] == ["2"]
    new, old = registry.split_by_existing(state, spark.createDataFrame([("u", "ALPHA"), ("u", "gamma")], "user_id string, name string"))
    assert ([r.name for r in new.collect()], [r.name for r in old.collect()]) == (["gamma"], ["ALPHA"])


@pytest.mark.parametrize(
    ("description", "content", "want"),
    [("", "", ("N", "N")), (" ", "", ("", "")), (" d ", "", ("d", "d")), ("", " c ", ("N", "c")), ("d", " ", ("d", ""))],
)
def test_create_defaults(state, description, content, want):
    out = make(state).create(" N ", description, content)
    assert out.result == {"success": True, "action": "created", "id": "new", "name": "N", "is_active": False, "message": out.result["message"]}
    row = out.state.where("id = 'new'").first()
    assert (row.name, row.description, row.content, row.is_active, row.user_id, row.seq) == ("N", *want, False, "u", 6)


@pytest.mark.parametrize(("overwrite", "valve", "allowed"), [(True, True, True), (False, True, True), (True, False, True), (False, False, False)])
def test_overwrite(state, overwrite, valve, allowed):
    events = []
    out = make(state, valves=Valves(allow_overwrite_on_create=valve), emit=events.append).create("bEta", "x", overwrite=overwrite)
    if allowed:
        row = out.state.where("id = '1'").first()
        assert (out.result["action"], row.name, row.description, row.content, row.is_active) == ("updated", "bEta", "x", "x", False)
        assert [e["data"]["done"] for e in events] == [False, True]
    else:
        assert out.result == {"error": "Skill already exists: bEta", "hint": "Use overwrite=true to update existing skill."}
        assert [e["data"]["done"] for e in events] == [False]  # no closing event
    assert out.result_frame().count() == 1


def test_update(state):
    out = make(state).update(skill_id="1", new_name=" Gamma ", description=" ", content=" c ", is_active=False)
    assert out.result == {"success": True, "id": "1", "name": "Gamma", "updated_fields": ["name", "content", "is_active"]}
    row = out.state.where("id = '1'").first()
    assert (row.name, row.description, row.content, row.is_active) == ("Gamma", "d1", "c", False)
    assert make(state).update(skill_id="1", new_name="BETA").result["success"]  # its own name in other case
    assert "hint" in make(state).update(skill_id="2", new_name="beta").result
    assert make(state).update(skill_id="1", description=" ").result == {"error": "Nothing to change was given"}
    assert make(state).update(skill_id="77").result == {"error": "No such skill"}


def test_delete_show_and_guards(state):
    out = make(state).delete(name="ALPHA")
    assert out.result == {"success": True, "id": "2", "name": "alpha"} and out.state.count() == 4
    assert make(state).show(skill_id="3").result["name"] is None
    assert make(state).list().result == {"count": 4}
    assert Registry(state, User("")).list().result == {"error": "A user is needed"}
    assert Registry(None, User("")).list().result == {"error": "The skill registry can't be reached"}
    assert make(state).create(" \t").result == {"error": "A skill needs a name"}
    assert Registry(state, User("u", language="de")).show(skill_id="x").result == {"error": "Skill nicht gefunden"}


def test_user():
    assert User.of([{"id": " 7 ", "language": "fr"}, {}]) == User("7", "User", "fr")
    assert User.of({"id": None}).user_id == "None"
    assert User.of({"language": "fr"}, {"accept-language": "de-DE;q=0.9,en"}).language == "de-DE"
    assert User.of(None) == User.of([]) == User()


def test_batch_mutations(spark, state):
    req = spark.createDataFrame([(1, "a", "u", "BETA", "", ""), (2, "b", "u", "beta", " x ", ""), (3, "c", "u", "New", "", ""), (4, "d", "u", " ", "", "")], "req_seq long, new_id string, user_id string, name string, description string, content string")
    by = {r.id: r for r in upsert_many(state, req).collect()}
    assert set(by) == {"1", "2", "3", "4", "5", "c"}
    assert (by["1"].name, by["1"].description, by["1"].is_active, by["c"].content) == ("beta", "x", False, "New")
    upd = spark.createDataFrame([("u", "1", "", "z", None)], "user_id string, id string, description string, content string, is_active boolean")
    one = update_many(state, upd).where("id = '1'").first()
    assert (one.description, one.content, one.is_active) == ("d1", "z", True)
    assert delete_many(state, upd).count() == 4


def test_snapshots(spark, state, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/registry")
    assert store.read() is None
    assert store.write(state) == 1
    assert store.write(make(store.read()).delete(skill_id="1").state) == 2
    assert (store.read().count(), store.read(1).count(), store.versions()) == (4, 5, [1, 2])
    plan = registry.user_skills(store.read(), "u")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_id" in plan


def test_random_programs(spark):
    """Creates, updates and deletes in random order lead to what a plain list of dicts holds."""
    rnd = random.Random(5)
    state = spark.createDataFrame([], registry.SCHEMA)
    model: list[dict] = []
    find = lambda name: next((s for s in model if s["name"].lower() == name.strip().lower()), None)
    for k in range(14):
        name = rnd.choice(["a", "B", " b", "A ", "c"])
        kind = rnd.choice(["create", "create", "update", "delete"])
        reg = Registry(state, User("u"), new_id=lambda k=k: f"id{k}", now=lambda: 1)
        held = find(name)
        if kind == "create":
            out = reg.create(name, "d")
            if held:
                held |= {"name": name.strip(), "active": False}
            else:
                model.append({"id": f"id{k}", "name": name.strip(), "active": False})
        elif kind == "update":
            out = reg.update(name=name, is_active=True)
            if held:
                held["active"] = True
        else:
            out = reg.delete(name=name)
            if held:
                model.remove(held)
        assert out.changed == (kind == "create" or held is not None)
        rows = out.state.orderBy("seq").collect()
        assert [(r.id, r.name, r.is_active) for r in rows] == [(s["id"], s["name"], s["active"]) for s in model]
        state = spark.createDataFrame(rows, registry.SCHEMA)


def test_upsert_as_sql(spark):
    """Only spaces are stripped, blank names count, case goes by characters; a null name meets nothing and stops additions."""
    own = [("1", "u", "line\n", 1), ("2", "u", "", 2), ("3", "u", "οδοσ", 3), ("4", "v", None, 4), ("5", "w", "w", 5)]
    state = spark.createDataFrame([(i, u, n, "d", "c", True, 0, None, seq) for i, u, n, seq in own], registry.SCHEMA)
    names = [("u", " LINE\n "), ("u", " "), ("u", "ΟΔΟΣ"), ("u", "LINE"), ("u", None), ("v", "x"), ("v", None), ("new", None)]
    req = spark.createDataFrame([(k, f"n{k}", u, n, " a ", "") for k, (u, n) in enumerate(names)], "req_seq long, new_id string, user_id string, name string, description string, content string")
    by = {r.id: (r.name, r.description, r.is_active, r.seq) for r in upsert_many(state, req, as_sql=True).collect()}
    old = {"1": ("LINE\n", "a", False, 1), "2": ("", "a", False, 2), "3": ("ΟΔΟΣ", "a", False, 3), "4": (None, "d", True, 4), "5": ("w", "d", True, 5)}
    assert by == old | {"n3": ("LINE", "a", False, 9), "n7": (None, "a", False, 13)}
    assert {r.seq for r in upsert_many(state.limit(0), req, as_sql=True).collect()} == {None}
