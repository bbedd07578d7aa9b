"""Types, versions, orders, contracts, modules, workspaces, graphs, sandboxes, state, and the catalogue."""

import json
import warnings

import duckdb
import pytest
from pyspark.sql import types as T

from loomline.catalogue import ORACLE_SQL, QUERIES
from loomline.functions import parse_type
from loomline.operators import Graph, Module, Sandbox, SparkProfile, Workspace, select_as
from loomline.plans import StateStore, Version, VersionConflict, VersionMismatch, from_json, layers, merge, parse_reference, to_json, topological
from loomline.sources import Storage
from loomline.streaming import ripple, wave

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE = 'from loomline.operators import Module\ndef module():\n    m = Module("tides", "{v}")\n    m.sink({{"t": m.spark.createDataFrame([(1, 4), (2, 9)], "id long, cm long")}})\n    return m\n'
DERIVED = 'from pyspark.sql import functions as F\nfrom loomline.operators import Module\ndef module():\n    m = Module("summary", "1.0.0")\n    m.source({{"tides": "{v}"}})\n    x = m.upstream["tides"].get("t", {{"cm": "cm"}})\n    m.sink_internal({{"staging": x}})\n    m.flow()\n    m.sink({{"out": m.get("staging", {{"v": "cm"}}).agg(F.sum("v").alias("total"))}})\n    return m\n'


def make(tmp_path, needs="1.0.0", bases=("1.0.0",), real=None):
    w = Workspace(tmp_path / "ws")
    for name, v, code in [*(("tides", v, BASE.format(v=real or v)) for v in bases), ("summary", "1.0.0", DERIVED.format(v=needs))]:
        d = tmp_path / "code" / name / v
        d.mkdir(parents=True)
        (d / "module.py").write_text(code)
        w.set_module(f"{name}@{v}", d)
    w.set_profile("local", SparkProfile())
    w.set_default_profile("local")
    w.validate()
    return w


def test_types():
    assert parse_type("DECIMAL(10, 2)") == T.DecimalType(10, 2) and parse_type("numeric") == T.DecimalType(38, 18)
    assert parse_type("array<timestamp>") == T.ArrayType(T.TimestampNTZType()) and parse_type("VARCHAR[]") == T.ArrayType(T.StringType())
    assert parse_type("STRUCT(Ab INTEGER, c MAP(VARCHAR, DOUBLE))").names == ["Ab", "c"] and parse_type("ubigint") == T.DecimalType(20, 0)
    assert parse_type("timestamp('UTC')") == T.TimestampType() and parse_type("timestamp(6)") == T.TimestampNTZType()
    with pytest.raises(ValueError):
        parse_type("colour")


def test_versions_and_orders():
    assert Version.parse("1.2.10") > Version.parse("1.2.9") and parse_reference("a@1.0.0") == ("a", "1.0.0") and parse_reference("a") == ("a", None)
    for bad in ("1.0", "1.0.0-rc1", "v1.0.0"):
        with pytest.raises(ValueError):
            Version.parse(bad)
    assert merge("x", "1.1.0", "1.0.0") == "1.1.0" and merge("x", "1.0.0", "1.1.0") == "1.1.0"
    for kw in ({"pinned_have": True}, {"pin": True}):
        with pytest.raises(VersionConflict):
            merge("x", "1.0.0", "1.1.0", **kw)
    with pytest.raises(VersionConflict):
        merge("x", "2.0.0", "1.1.0")
    edges = {"d": {"b", "c"}, "b": {"a"}, "c": {"a"}, "a": {"outside"}}
    assert topological(edges) == ["a", "b", "c", "d"] and layers(edges) == [["a"], ["b", "c"], ["d"]]
    for f in (topological, layers):
        with pytest.raises(ValueError, match="cycle"):
            f({"a": {"b"}, "b": {"a"}})


def test_module(spark):
    m = Module("m", "1.0.0", spark=spark)
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    with pytest.raises(ValueError):
        m.source({"m": "1.0.0"})
    m.sink_internal({"one": df})
    m.flow()
    m.sink({"two": m.get("one", {"x": "a", "y": "a"})})
    with pytest.raises(ValueError):
        m.sink({"two": df})
    with pytest.raises(KeyError):
        m.get("one", {"x": "missing"})
    manifest = m.build()
    assert [s.tables for s in manifest.steps] == [("one",), ("two",)] and manifest.steps[1].note and list(manifest.offer().relations) == ["two"]
    assert from_json(json.loads(json.dumps(to_json(manifest)))) == manifest
    m.source({"up": "1.0.0"})
    with pytest.warns(RuntimeWarning):
        assert m.upstream["up"].get("t", {"x": "a"}).schema["x"].dataType == T.DoubleType()
    with pytest.raises(KeyError):
        m.upstream["other"]
    with pytest.raises(ValueError):
        select_as(df, {})


def test_run(spark, tmp_path):
    w = make(tmp_path)
    g = w.graph({"summary": "1.0.0"})
    assert g.plan().order == ["tides", "summary"] and g.column_lineage() == [("summary", "tides", "t", "cm")]
    r = g.run(parallel=2)
    assert r.success and r.duration >= 0 and spark.sql("SELECT total FROM summary.out").first().total == 13
    assert spark.sql("SELECT count(*) FROM tides__v1.t").first()[0] == 2
    s = Storage(spark, w.root)
    assert s.read(s.table_path("summary", "1.0.0", "staging")).count() == 2
    g.run()  # a second pass replaces the tables
    assert g.state.ledger(spark).count() == 2 and not list((tmp_path / "ws/_staging").glob("*-before"))
    assert g.run(freshness=1000).seconds == {}
    w.save(tmp_path / "w.json")
    assert Workspace.load(tmp_path / "w.json").to_dict() == w.to_dict()
    g.save(tmp_path / "g.json")
    assert Graph.load(tmp_path / "g.json").targets == g.targets
    assert len(wave(lambda: g.run(), 2)) == 2


def test_resolution(tmp_path, spark):
    with pytest.raises(VersionMismatch):
        make(tmp_path / "a", real="1.0.1").graph({"tides": "1.0.0"}).resolve()
    with pytest.raises(VersionConflict):
        make(tmp_path / "b", needs="2.0.0", bases=("1.0.0", "2.0.0")).graph({"tides": "1.0.0", "summary": "1.0.0"}).resolve()
    w = make(tmp_path / "c", needs="0.1.0", bases=("0.1.0", "0.2.0"))
    g = w.graph({"summary": "1.0.0"})
    g.state.record_version("tides", "0.2.0")
    g.resolve()
    assert g.versions["tides"] == "0.2.0" and g.manifests["tides"].version == "0.2.0"
    pinned = w.graph({"summary": "1.0.0", "tides": "0.1.0"})
    pinned.resolve()
    assert pinned.versions["tides"] == "0.1.0"
    with pytest.raises(ValueError):
        w.set_mode("scheduled")
    with pytest.raises(KeyError):
        w.graph({"nothing": "1.0.0"})


def test_workspace_catalogue(tmp_path):
    for v in ("1.0.0", "1.1.0", ".git"):
        (tmp_path / "m" / v).mkdir(parents=True)
    w = Workspace(tmp_path)
    w.set_modules({"m": tmp_path / "m" / "{version}"})
    assert sorted(w.modules["m"]) == ["1.0.0", "1.1.0"]
    with pytest.raises(ValueError):
        w.set_module("m@1.0.0", tmp_path / "elsewhere")
    with pytest.raises(KeyError):
        w.module_path("m")
    with pytest.raises(KeyError):
        w.set_default_profile("none")
    (tmp_path / "c.json").write_text(json.dumps({"modules": {"n@1.0.0": "n"}}))
    w.load_modules(tmp_path / "c.json")
    assert w.module_path("n") == str(tmp_path / "n")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        with pytest.raises(ValueError):
            Workspace(tmp_path).validate()


def test_state(tmp_path):
    s = StateStore(tmp_path / "s.sqlite")
    assert s.acquire("n", "a") and not s.acquire("n", "a") and s.renew("n", "a")
    s.release("n", "b")
    assert not s.acquire("n", "b")
    s.release("n", "a")
    assert s.acquire("n", "b", ttl=-1) and s.acquire("n", "c")
    s.record_version("m", "1.2.0")
    s.record_version("m", "1.1.0")
    assert s.version("m", 1) == "1.2.0" and s.version("m", 2) is None


def test_sandbox(spark, tmp_path):
    w = make(tmp_path)
    w.graph({"summary": "1.0.0"}).run()
    code = str(tmp_path / "code/summary/1.0.0")
    box = Sandbox(code, w, "summary", "1.0.0", sink=Workspace(tmp_path / "box"))
    sample = box.upstream["tides"].get("t", infer_select=True)
    assert sample.frame.columns == ["cm"]
    box.sink(sample.transform(lambda d: d.where("cm = 4")))
    with pytest.raises(ValueError):
        box.sink(sample.frame)
    box.materialize(registry=tmp_path / "r.json")
    again = Sandbox.load_active(tmp_path / "r.json")
    again.flow()
    assert again.get("out").first().total == 4
    again.flow()
    assert box.downstream("out").frame.first().total == 13


def test_failed_write_keeps_the_table(spark, tmp_path):
    s = Storage(spark, tmp_path)
    path = f"{tmp_path}/data/m/1.0.0/t.parquet"
    s.write(spark.range(5), path)
    with pytest.raises(Exception):
        s.write(spark.range(5).selectExpr("raise_error('no') AS x"), path)
    s.write(s.read(path).where("id < 3"), path)  # reads what it replaces
    assert s.read(path).count() == 3 and list(s.discover("m", "1.0.0").relations) == ["t"]


def test_ripple(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for n in (10, 5):
        spark.range(n).write.mode("append").parquet(src)
        ripple(spark, src, T.StructType([T.StructField("id", T.LongType())]), lambda d: d, out, cp)
    assert spark.read.parquet(out).count() == 15


def test_freshness_is_of_a_version(spark, tmp_path):
    w = make(tmp_path, bases=("1.0.0", "1.1.0"))
    w.graph({"tides": "1.0.0"}).run()
    assert w.graph({"tides": "1.0.0"}).run(freshness=1000).seconds == {}
    assert set(w.graph({"tides": "1.1.0"}).run(freshness=1000).seconds) == {"tides"}
    g = w.graph({"summary": "1.0.0"})
    g.run()
    w.graph({"tides": "1.1.0"}).run()  # a module that summary reads has succeeded since
    assert set(g.run(freshness=1000).seconds) == {"summary"}


def test_upgrade_where_the_declared_version_is_gone(spark, tmp_path):
    w = make(tmp_path, needs="0.1.0", bases=("0.2.0",))
    g = w.graph({"summary": "1.0.0"})
    with pytest.raises(FileNotFoundError):
        g.resolve()
    g.state.record_version("tides", "0.2.0")
    g.resolve()
    assert g.versions["tides"] == "0.2.0"
    with pytest.raises(FileNotFoundError):
        w.graph({"summary": "1.0.0"}).resolve(auto_upgrade=False)


SETTING = 'from pyspark.sql import functions as F\nfrom loomline import Module\ndef module():\n    m = Module("setting", "1.0.0")\n    m.sink({"t": m.spark.range(1).select(F.lit(m.spark.conf.get("spark.sql.shuffle.partitions")).alias("n"))})\n    return m\n'


def test_profiles_act(spark, tmp_path):
    (tmp_path / "module.py").write_text(SETTING)
    w = Workspace(tmp_path / "ws")
    w.set_module("setting@1.0.0", tmp_path)
    with pytest.raises(ValueError):
        w.graph({"setting": "1.0.0"}).run()  # no default profile
    for name, n in (("plain", "4"), ("wide", "9"), ("narrow", "2")):
        w.set_profile(name, SparkProfile(conf={"spark.sql.shuffle.partitions": n}))
    w.set_default_profile("plain")
    w.set_module_profile("setting", "wide")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for profiles, want in ((None, "9"), ({"setting": "narrow"}, "2")):
        w.graph({"setting": "1.0.0"}, profiles=profiles).run()
        assert spark.sql("SELECT n FROM setting.t").first().n == want
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    g = w.graph({"setting": "1.0.0"}, profiles={"setting": "none"})
    with pytest.raises(ValueError):
        g.run()
    g.set_profiles({})
    g.set_mode("once")
    assert "setting@1.0.0 (target)" in g.plan().explain() and Graph.from_dict(g.to_dict()).profiles == {}
    with pytest.raises(KeyError):
        g.set_workspace(Workspace(tmp_path / "other"))
    w.set_profile("far", SparkProfile("cluster"))
    with pytest.raises(ValueError):
        w.graph({"setting": "1.0.0"}, profiles={"setting": "far"}).run()


def test_a_write_that_ends_between_its_renames(spark, tmp_path):
    s = Storage(spark, tmp_path)
    path = tmp_path / "data/m/1.0.0/t.parquet"
    s.write(spark.range(5), str(path))
    path.rename(path.with_name(".t.parquet.before"))
    assert s.read(str(path)).count() == 5
    path.rename(path.with_name(".t.parquet.before"))
    s.write(spark.range(3), str(path))
    assert s.read(str(path)).count() == 3 and not path.with_name(".t.parquet.before").exists()


def test_views_in_a_new_session(spark, tmp_path):
    w = make(tmp_path)
    w.graph({"summary": "1.0.0"}).run()
    w.save(tmp_path / "w.json")
    spark.sql("DROP VIEW summary.out")
    other = spark.newSession()
    Workspace.load(tmp_path / "w.json", spark=other)
    assert other.sql("SELECT total FROM summary.out").first().total == 13
    assert "staging" not in [r.viewName for r in other.sql("SHOW VIEWS IN summary").collect()]


def test_home_of_a_remote_root(tmp_path):
    with pytest.raises(ValueError):
        Workspace("s3a://bucket/tables").home
    assert Workspace("s3a://bucket/tables", home=tmp_path).home == tmp_path
    assert str(Workspace("file:///data/x").home) == "/data/x" and Workspace(tmp_path).home == tmp_path


GROWING = """
from loomline import Module
def module():
    m = Module("growing", "1.0.0")
    old = m.previous("log")
    n = 0 if old is None else old.count()
    new = m.spark.createDataFrame([(n, "new"), (0, f"seen {n}")], "id long, what string")
    m.sink({"log": new}, mode="append", order=["id"])
    m.sink({"state": new.dropDuplicates(["id"])}, mode="merge", keys=["id"])
    return m
"""


def test_append_merge_and_in_place_runs(spark, tmp_path):
    (tmp_path / "module.py").write_text(GROWING)
    w = Workspace(tmp_path / "ws")
    w.set_module("growing@1.0.0", tmp_path)
    w.set_profile("local", SparkProfile())
    w.set_default_profile("local")
    for n in (2, 4):
        w.graph({"growing": "1.0.0"}).run()
        assert spark.sql("SELECT id FROM growing.log").count() == n
    state = spark.sql("SELECT id, what FROM growing.state").collect()
    assert sorted(r.id for r in state) == [0, 2] and {r.id: r.what for r in state}[0] == "seen 2"
    box = Sandbox(str(tmp_path), w, "growing", "1.0.0", sink=Workspace(tmp_path / "box"))
    box.sink(box.downstream("log"))
    box.materialize(registry=tmp_path / "r.json")
    box.flow()
    assert box.get("log").count() == 6 and box.get("log").where("what = 'seen 4'").count() == 1
    box.flow()
    assert box.get("log").count() == 8
    box.flow(in_place=False)
    assert box.get("log").count() == 2
    m = Module("m", "1.0.0", spark=spark)
    for how in ({"mode": "merge"}, {"mode": "replace", "keys": ["id"]}, {"mode": "upsert"}):
        with pytest.raises(ValueError):
            m.sink({"t": spark.range(1)}, **how)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_catalogue(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want
