from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators.cleaning import (
    BANK_RULES,
    align_to,
    clean,
    cleaning_checks,
    json_safe,
    split_features_target,
    to_number,
    to_payload,
)
from plumbline.operators.contract import (
    Contract,
    Field,
    infer_contract,
    json_schema,
    split_valid,
    validate,
    validate_events,
)
from plumbline.operators.drift import output_reference
from plumbline.operators.profile import build_profile, output_shares

SCHEMA = "` age` bigint, job string, duration bigint, pdays bigint, y string"


@pytest.fixture
def raw(spark):
    return spark.createDataFrame([(30, "unknown", 100, 999, "yes"), (40, "admin.", 200, 4, "no")], SCHEMA)


def test_clean(raw):
    rows = clean(raw).orderBy("age").collect()
    assert "duration" not in rows[0].asDict()
    assert [r["y"] for r in rows] == [1, 0]
    assert [(r["pdays_was_999"], r["never_contacted_flag"], r["pdays_clean"]) for r in rows] == [(1, 1, 0), (0, 0, 4)]
    assert rows[0]["job"] == "unknown"


def test_bad_targets(spark, raw):
    bad = raw.unionByName(spark.createDataFrame([(50, "x", 1, 1, "maybe")], SCHEMA))
    with pytest.raises(ValueError):
        clean(bad)
    assert clean(bad, on_bad_target="quarantine").count() == 2
    with pytest.raises(ValueError, match="missing"):
        clean(raw.drop("y"))


def test_checks_and_split(raw):
    cleaned = clean(raw)
    checks = {r["check"]: r["passed"] for r in cleaning_checks(cleaned, BANK_RULES, {"job": "unknown"}).collect()}
    assert len(checks) == 6 and all(checks.values())
    x, y = split_features_target(cleaned, "y")
    assert "y" not in x.columns and y.columns == ["y"]


def test_row_payloads(spark):
    df = spark.createDataFrame([(1, 2.0, None, 25.0), (2, None, "a", 3.0)], "id bigint, `emp.var.rate` double, job string, age double")
    rows = [json.loads(r["payload"]) for r in to_payload(df, integer=("age",), keep=("id",)).collect()]
    assert rows == [{"emp.var.rate": 2.0, "age": 25}, {"job": "a", "age": 3}]
    fields = [{"name": "emp.var.rate", "dtype": "float64"}, {"name": "age", "dtype": "int64"}, {"name": "job", "dtype": "object", "allowed_values": ["a"]}]
    safe = json_safe(align_to(df, ["emp.var.rate", "age", "job"]), fields).collect()
    assert [tuple(r) for r in safe] == [(2.0, 25, "unknown"), (0.0, 3, "a")]
    with pytest.raises(ValueError):
        align_to(df, ["nope"])
    assert [r["job"] for r in to_number(df, "job").collect()] == [None, None]


def test_infer_contract(raw):
    contract = infer_contract(clean(raw))
    assert "y" not in contract.required and "duration" not in contract.required
    job = next(f for f in contract.fields if f.name == "job")
    assert job.allowed_values == ("admin.", "unknown")
    document = json.loads(json_schema(contract))
    assert document["properties"]["job"] == {"type": "string", "enum": ["admin.", "unknown"]}
    assert document["properties"]["pdays_was_999"] == {"type": "integer"}


CONTRACT = Contract((Field("age", "int64"), Field("emp.var.rate", "float64"), Field("job", "object", ("a", "unknown"))))


def errors(spark, *payloads, contract=CONTRACT):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload string")
    return validate(df, contract).orderBy("i").collect()


def test_validate(spark):
    good = '{"age": 1, "emp.var.rate": 2, "job": "a"}'
    rows = errors(
        spark,
        good,
        '{"emp.var.rate": 2.5, "job": "a"}',
        '{"age": 1, "emp.var.rate": 2, "job": "a", "duration": 5, "zzz": 1, "y": 1}',
        '{"age": true, "emp.var.rate": "2", "job": 3}',
        '{"age": 1.0, "emp.var.rate": null, "job": "b"}',
        '{"age": 1',
        '[1]',
        None,
    )
    assert rows[0]["valid"] and rows[0]["clean"].asDict() == {"age": 1, "emp.var.rate": 2.0, "job": "a"}
    assert rows[1]["errors"]["missing"] == ["age"] and not rows[1]["valid"]
    assert rows[2]["errors"]["unknown"] == ["duration", "y", "zzz"] and rows[2]["errors"]["excluded"] == ["duration", "y"]
    assert rows[3]["errors"]["invalid_types"] == {"age": "expected integer", "emp.var.rate": "expected number", "job": "expected string"}
    assert set(rows[4]["errors"]["invalid_types"]) == {"age", "emp.var.rate"} and rows[4]["errors"]["invalid_values"] == ["job"]
    assert [r["errors"]["malformed"] for r in rows[5:]] == [True, True, True]


def test_long_value_lists_are_checked_by_join(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(30)], "age bigint, name string")
    contract = infer_contract(df, max_enum=10)
    assert contract.fields[1].by_table
    assert json.loads(json_schema(contract)) == json.loads(json_schema(infer_contract(df, max_enum=30)))
    rows = errors(spark, '{"age": 1, "name": "n29"}', '{"age": 1, "name": "n30"}', '{"age": 1, "name": 4}', contract=contract)
    assert [r["valid"] for r in rows] == [True, False, False]
    assert rows[1]["errors"]["invalid_values"] == ["name"]
    assert rows[2]["errors"]["invalid_types"] == {"name": "expected string"}
    good, bad = split_valid(validate(spark.createDataFrame([('{"age": 1, "name": "n2"}',)], "payload string"), contract))
    assert good.first()["name"] == "n2" and bad.count() == 0


def test_many_long_lists_are_looked_up_together(spark, monkeypatch):
    """Three fields, a value that half of the payloads hold, and more unlisted values than are broadcast."""
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *[f"{c}{i}" for c in names]) for i in range(40)], "age bigint, a string, b string, c string")
    contract, plain = infer_contract(df, max_enum=10), infer_contract(df, max_enum=1000)
    payloads = [json.dumps({"age": i, "a": "a7" if i % 2 else f"a{i}", "b": f"b{i % 50}", "c": None if i % 9 == 0 else f"c{i // 2}"}) for i in range(120)]
    rows = spark.createDataFrame([(p,) for p in payloads], "payload string")
    shown = lambda made: sorted((r["payload"], r["valid"], tuple(r["errors"]["invalid_values"]), str(r["errors"]["invalid_types"])) for r in made.collect())
    want = shown(validate(rows, plain))
    assert shown(validate(rows, contract)) == want and {v for _, v, _, _ in want} == {True, False}
    monkeypatch.setattr("plumbline.operators.contract.MAX_BROADCAST_VALUES", 3)
    assert shown(validate(rows, contract)) == want


@pytest.mark.parametrize("labels", [2, 3, 999, 1000, 1001, 3000])
def test_a_target_of_any_number_of_labels(spark, labels):
    """Reference shares of the output bins from all labels one by one."""
    df = spark.range(9000).select((F.col("id") % labels).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    profile = build_profile(df, ["x"], [], "y")
    whole = {r["label"]: r["ref_share"] for r in output_shares(df, "y").collect()}
    assert output_reference(profile.output) == output_reference(whole)
    assert len(profile.output) == 2 and (labels > 2 or profile.output == whole)


def test_event_contract(spark):
    event = {
        "event_id": "e", "emitted_at": "2024-01-01T00:00:00Z", "model_name": "m", "model_version": 3,
        "window_start": "2024-01-01T00:00:00Z", "window_end": "2024-01-01T01:00:00Z", "window_size": 200,
        "previous_severity": "green", "current_severity": "red",
        "top_metrics": [{"feature": "age", "metric": "psi", "value": 1.0, "threshold": 0.2}],
    }
    changes = [{}, {"current_severity": "blue"}, {"model_name": None}, {"top_metrics": event["top_metrics"] * 6}, {"top_metrics": [{"feature": "a", "metric": "ks", "value": 1.0, "threshold": 1.0}]}]
    df = spark.createDataFrame([(i, json.dumps({**event, **c})) for i, c in enumerate(changes)], "i int, payload string")
    rows = validate_events(df).orderBy("i").collect()
    assert [r["event_valid"] for r in rows] == [True, False, False, False, False]
    assert not validate_events(spark.createDataFrame([("{",)], "payload string")).first()["event_valid"]
