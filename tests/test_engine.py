import pytest

from petrel.operators import charts, clean, compare, extract, graph, metrics, report, validate
from petrel.operators.clean import CleanConfig
from petrel.operators.extract import ExtractConfig
from petrel.plans.pipeline import Pipeline
from petrel.sources import samples
from petrel.sources.rows import from_dicts

GOLDEN = {
    "Simple Logistics": dict(otc=3, aorc=5, oid=0.3333, sar=0.6667, afo=1.6667, afo_norm=0.5556, re=1.5219, re_norm=0.9602, oc=0.6667, composite=0.629, oii=0, diam=1),
    "E-Commerce Fulfilment": dict(otc=5, aorc=12, oid=0.5, sar=1, afo=2, afo_norm=0.4, re=2.1175, re_norm=0.912, oc=2, composite=0.703, oii=0, diam=2),
    "Hospital Patient Management": dict(otc=6, aorc=20, oid=0.6667, sar=1, afo=2.5, afo_norm=0.4167, re=2.4016, re_norm=0.9291, oc=3.3333, composite=0.7531, oii=0, diam=2),
    "isolated": dict(otc=3, aorc=2, oid=0.3333, sar=1, afo=2, afo_norm=0.6667, re=1, re_norm=0.6309, oc=0.6667, composite=0.6577, oii=0.3333, diam=1),
    "star": dict(otc=3, aorc=3, oid=1, sar=1, afo=3, afo_norm=1, re=1.585, re_norm=1, oc=2, composite=1, oii=0, diam=1),
    "empty": dict(otc=0, aorc=0, oid=0, sar=0, afo=0, afo_norm=0, re=0, re_norm=0, oc=0, composite=0, oii=0, diam=0),
}


def star(n):
    return {"objects": [f"O{k}" for k in range(n)], "activities": ["Hub"], "relations": [("Hub", f"O{k}") for k in range(n)]}


@pytest.fixture(scope="module")
def models(spark):
    extra = [("isolated", {"objects": ["X", "Y", "Z"], "activities": ["A"], "relations": [("A", "X"), ("A", "Y")]}), ("star", star(3)), ("empty", {})]
    return extract.from_dicts(spark, samples.models() + extra)


def test_golden_metrics(models):
    rows = {r.model: r.asDict() for r in metrics.exact_metrics(models).collect()}
    for name, want in GOLDEN.items():
        assert {k: pytest.approx(rows[name][k], abs=1e-9) for k in want} == want, name


def test_weights_override_by_name(models):
    rows = {r.model: r.composite for r in metrics.exact_metrics(models, {"oid": 1, "sar": 0, "afo_norm": 0, "re_norm": 0, "other": 9}).collect()}
    assert rows["Simple Logistics"] == 0.3333


def test_unknown_relation_end(spark):
    with pytest.raises(ValueError):
        extract.from_dicts(spark, [("bad", {"objects": ["O"], "activities": ["A"], "relations": [("A", "nope")]})])


def test_findings(spark, models):
    rows = {}
    for r in validate.findings(models).collect():
        rows.setdefault(r.model, set()).add(r.code)
    assert rows["empty"] == {"NO_OBJECTS", "NO_ACTIVITIES", "NO_RELATIONS"}
    assert rows["isolated"] == {"ISOLATED_OBJECTS", "SINGLE_ACTIVITY", "DENSITY"}
    assert rows["star"] == {"DENSE", "SINGLE_ACTIVITY"}
    valid = {r.model: r.is_valid for r in validate.is_valid(validate.findings(models)).collect()}
    assert not valid["empty"] and valid["star"]


def test_components_and_ties(spark):
    m = extract.from_dicts(spark, [("two", {"objects": list("abcxyz"), "activities": ["1", "2", "3", "4"], "relations": [("1", "a"), ("1", "b"), ("2", "b"), ("2", "c"), ("3", "x"), ("3", "y"), ("4", "x"), ("3", "z")]})])
    found = graph.components(m.objects, graph.edges(m.relations))
    assert {r.object_type: (r.component, r.size) for r in found.collect()} == {**{k: ("a", 3) for k in "abc"}, **{k: ("x", 3) for k in "xyz"}}
    assert graph.diameter(found).first().diam == 2


def test_cleaning_steps(spark):
    rows = [{"activity": None, "object_type": "X"}, {"activity": "N/A", "object_type": "X"}, {"activity": "rare", "object_type": "X"}]
    rows += [{"activity": "common act", "object_type": "order", "event_id": e} for e in ("E1", "E1", "E2")] + [{"activity": "common act", "object_type": "odd", "event_id": "E3"}]
    events = from_dicts(spark, rows, "m")
    config = CleanConfig(min_activity_freq=2, min_object_freq=2)
    r = clean.report(events, config).first()
    assert (r.dropped_null, r.dropped_placeholder, r.dropped_rare_activity, r.dropped_rare_object, r.dropped_duplicate, r.rows_out) == (0, 2, 1, 1, 1, 2)
    assert {(x.activity, x.object_type, x.source_row) for x in clean.clean(events, config).collect()} == {("Common Act", "Order", 3), ("Common Act", "Order", 5)}
    assert "only 2 rows remain" in r.warnings
    kept = clean.clean(events, CleanConfig(reject_placeholders=False, deduplicate=False, title_case=False))
    assert kept.count() == 7


def test_support_and_orphans(spark):
    events = from_dicts(spark, [{"activity": "A1", "object_type": "O1"}] + [{"activity": "A2", "object_type": "O2"}] * 3, "m")
    m = extract.extract(events, ExtractConfig(min_relation_support=2))
    assert [(r.activity, r.object_type) for r in m.relations.collect()] == [("A2", "O2")]
    assert m.objects.count() == 1 and extract.extract(events, ExtractConfig(2, True)).objects.count() == 2
    r = extract.report(events, ExtractConfig(2)).first()
    assert (r.suppressed, r.orphan_activities, r.orphan_objects) == (1, ["A1"], ["O1"])


def test_integrity(spark, models):
    assert extract.integrity_violations(models).count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    p = Pipeline(spark)
    result = p.run_many([*samples.all_logs(), ([{"activity": "N/A", "object_type": "X"}], "nothing")])
    rows = {r.model: r for r in result.metrics.collect()}
    assert set(rows) == {"E-Commerce", "Hospital", "Logistics", "nothing"}
    assert rows["nothing"].otc == 0 and rows["E-Commerce"].otc == 5 and not result.is_valid()
    table = p.compare(result)
    assert [r.metric for r in table.collect()] == compare.COMPARED
    ranks = compare.ranking(result.metrics).orderBy("rank").collect()
    assert [r.composite for r in ranks] == sorted((r.composite for r in ranks), reverse=True)
    assert "Metrics of Hospital" in result.full_report()
    written = p.visualise(result, str(tmp_path))
    assert len(written) == 8
    assert report.as_dict(rows["Hospital"].asDict())["Model"] == "Hospital"


def test_dictionary_rows_as_models(spark):
    rows = [{"activity": a, "object_type": o} for a, o in (("A", "X"), ("A", "Y"), ("B", "Y"), ("B", "Z"), ("C", "X"), ("C", "Z"))]
    r = Pipeline(spark).run(rows, "d").metrics.first()
    assert (r.otc, r.aorc, r.oid, r.composite) == (3, 6, 1.0, 0.9167)


def test_bands_and_charts(spark, models):
    m = metrics.metrics(models)
    assert {r.model: r.level for r in compare.bands(m).collect()}["star"] == "Very High"
    assert charts.bipartite_nodes(models).where("model = 'star'").count() == 4
    assert charts.graph_nodes(models).where("model = 'isolated' and degree = 0").count() == 1
