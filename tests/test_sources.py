import datetime as dt
import json

import pytest

from petrel.sources import files, ocel, registry, samples
from petrel.sources.rows import from_dicts, numbered


def pairs(df):
    return sorted((r.activity, r.object_type) for r in df.collect())


def test_aliases_differ_by_row(spark):
    df = from_dicts(spark, [{"event_name": "A", "entity_type": "X"}, {"action": "B", "object": "Y"}], "m")
    assert pairs(df) == [("A", "X"), ("B", "Y")]


def test_last_alias_wins_and_extra_keeps_the_rest(spark):
    r = from_dicts(spark, [{"activity": "A", "task": "B", "object_type": "X", "Region": "EU"}], "m").first()
    assert (r.activity, r.extra) == ("B", {"Region": "EU"})


def test_null_is_not_absent(spark):
    rows = from_dicts(spark, [{"activity": None, "object_type": "X", "event_id": None}, {"activity": "A", "object_type": "X"}], "m").orderBy("source_row").collect()
    assert [(r.activity, r.event_id) for r in rows] == [("None", "None"), ("A", "evt_000001")]


def test_rows_without_required_fields_give_nothing(spark):
    df = from_dicts(spark, [{"activity": "", "object_type": "X"}, {"activity": "A", "object_type": ""}, {"activity": "A", "object_type": "X|Y"}], "m")
    assert pairs(df) == [("A", "X"), ("A", "Y")]


def test_csv_text_and_file(spark, tmp_path):
    text = "concept:name,object_type,case:concept:name\nPlace,Order,C1\nPay,Customer,C1\n"
    (tmp_path / "a.csv").write_text(text)
    for source in (text, tmp_path / "a.csv"):
        df = files.parse(spark, source, "m")
        assert pairs(df) == [("Pay", "Customer"), ("Place", "Order")]
        assert {r.case_id for r in df.collect()} == {"C1"}
        assert sorted(r.source_row for r in df.collect()) == [0, 1]


def test_json_text(spark):
    assert pairs(files.parse(spark, json.dumps([{"activity": "A", "object_type": "X"}, {"activity": "B", "object_type": ["Y", "Z"]}]), "m")) == [("A", "X"), ("B", "Y"), ("B", "Z")]
    assert pairs(files.parse(spark, '{"activity": "A", "object_type": "X"}', "m")) == [("A", "X")]


def test_simplified_log(spark):
    doc = {"events": [{"id": "e1", "activity": "Load", "timestamp": "2024-01-01T10:00:00", "omap": ["i1", "v1", "zz"]}, {"activity": "None here", "omap": []}], "objects": [{"id": "i1", "type": "Item"}, {"id": "v1", "type": "Vehicle"}]}
    df = files.parse(spark, json.dumps(doc), "m")
    assert pairs(df) == [("Load", "Item"), ("Load", "Vehicle"), ("Load", "zz")]
    assert df.first().ts == dt.datetime(2024, 1, 1, 10)


def test_ocel2(spark):
    doc = {"objects": [{"id": "o1", "type": "Order"}], "events": [{"id": "e1", "type": "place", "time": "2024-01-01T00:00:00Z", "relationships": [{"objectId": "o1"}, {"objectId": "item:7"}]}, {"id": "e2", "type": "idle", "relationships": []}]}
    assert pairs(ocel.parse_json(spark.createDataFrame([(json.dumps(doc),)], "value string"), "m")) == [("place", "Order"), ("place", "item")]


def test_ocel1(spark):
    doc = {"ocel:objects": {"o1": {"ocel:type": "Order"}}, "ocel:events": {"e1": {"ocel:activity": "place", "ocel:timestamp": "2024-01-01", "ocel:omap": ["o1", "item:7", "zz"]}}}
    df = ocel.parse_json(spark.createDataFrame([(json.dumps(doc),)], "value string"), "m")
    assert pairs(df) == [("place", "Order"), ("place", "item"), ("place", "unknown")]
    assert df.first().ts is None
    with pytest.raises(ValueError):
        ocel.parse_json(spark.createDataFrame([("{}",)], "value string"), "m")


def test_ocel_csv(spark):
    named = spark.createDataFrame([("e1", "a", "['x', \"y\"]", "nan"), ("e2", "b", "[]", "")], ["ocel:eid", "ocel:activity", "ocel:type:T", "ocel:type:U"])
    rows = ocel.from_csv(named, "m").orderBy("source_row", "pos").collect()
    assert [(r.activity, r.object_type, r.object_id) for r in rows] == [("a", "T", "x"), ("a", "T", "y"), ("b", "", "")]
    plain = spark.createDataFrame([("a", "p,q")], ["concept:name", "file"])
    assert pairs(ocel.from_csv(plain, "m")) == [("a", "file"), ("a", "file")]
    assert ocel.from_csv(named, "m", max_rows=1).count() == 2


@pytest.mark.parametrize("broadcast", ["-1", "256k"])
def test_rows_of_a_join_are_numbered_once(spark, broadcast):
    from petrel.plans import queries

    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    settings |= {f"spark.sql.adaptive.coalescePartitions.{k}": v for k, v in (("parallelismFirst", "false"), ("minPartitionSize", "1k"))}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # counting the rows needs narrow ones only, whose plan would deal them differently
        got = numbered(queries._orders_log(spark, "/root/testdata/sf0.01")).collect()
        n = queries._orders_log(spark, "/root/testdata/sf0.01").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.source_row for r in got) == list(range(n)) and len({r.o_orderkey for r in got}) == n


def test_registry(spark, tmp_path):
    (tmp_path / "my-log.json").write_text(json.dumps({"objects": [], "events": [{"id": "e", "type": "a", "relationships": [{"objectId": "x:1"}]}]}))
    assert registry.discover(str(tmp_path))["my-log"]["format"] == "ocel2"
    df, kind = registry.load(spark, "my-log", str(tmp_path))
    assert (pairs(df), kind) == ([("a", "x")], "real")
    df, kind = registry.load(spark, "p2p", str(tmp_path), allow_mock=True)
    assert kind == "mock" and df.select("source_row").distinct().count() == 14671
    with pytest.raises(RuntimeError):
        registry.load(spark, "email", str(tmp_path))


def test_unknown_source(spark):
    with pytest.raises(TypeError):
        files.parse(spark, 7)


def test_sample_logs(spark):
    for source, name in samples.all_logs():
        assert files.parse(spark, source, name).count() > 50
