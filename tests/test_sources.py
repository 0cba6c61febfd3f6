from __future__ import annotations

import datetime as dt
import hashlib

import pytest

from plumbline.operators.cleaning import clean
from plumbline.plans.reference import get_or_create_reference, recompute_reference
from plumbline.sources.profiles import active_header, load_active
from plumbline.sources.tables import (
    BANK_SCHEMA,
    append,
    file_fingerprints,
    load_delimited,
    newest,
    read_or_none,
    save_json,
    sniff_delimiter,
    table_fingerprint,
)

HEADER = "age;job;marital;education;default;housing;loan;contact;month;day_of_week;duration;campaign;pdays;previous;poutcome;emp.var.rate;cons.price.idx;cons.conf.idx;euribor3m;nr.employed;y"


def bank_rows(n=40):
    jobs = ["admin.", "unknown", "services"]
    return [
        f'{20 + i};"{jobs[i % 3]}";"married";"basic.4y";"no";"no";"no";"telephone";"may";"mon";{i * 7};1;{999 if i % 4 else 3};0;"nonexistent";1.1;93.{900 + i};-36.4;4.{800 + i};5191;"{"yes" if i % 5 == 0 else "no"}"'
        for i in range(n)
    ]


@pytest.fixture
def bank_file(tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text("\n".join([HEADER, *bank_rows()]) + "\n")
    return str(path)


def test_bank_file(spark, bank_file, tmp_path):
    assert sniff_delimiter(spark, bank_file) == ";"
    raw = load_delimited(spark, bank_file, BANK_SCHEMA)
    assert raw.count() == 40 and raw.schema["emp.var.rate"].dataType.simpleString() == "double"
    cleaned = clean(raw)
    assert cleaned.agg({"y": "sum"}).first()[0] == 8
    comma = tmp_path / "comma.csv"
    comma.write_text('a,"b;c",d\n1,2,3\n')
    assert sniff_delimiter(spark, str(comma)) == ","
    with pytest.raises(FileNotFoundError):
        load_delimited(spark, str(tmp_path / "none.csv"))


def test_profile_versions(spark, bank_file, tmp_path):
    raw, root = load_delimited(spark, bank_file, BANK_SCHEMA), str(tmp_path / "profiles")
    assert load_active(spark, root, "bank") is None
    first = get_or_create_reference(spark, raw, root, "bank", "v1", dt.datetime(2024, 1, 1))
    assert first.edges["age"][0] == 20.0 and len(first.edges["age"]) == 11
    assert set(first.categorical) >= {"job", "month"} and first.output == {1: 0.2, 0: 0.8}
    assert sum(first.shares["age"]) == pytest.approx(1.0)
    again = get_or_create_reference(spark, raw, root, "bank", "v1", dt.datetime(2024, 1, 2))
    assert again.edges == first.edges
    newer = recompute_reference(spark, raw.where("age < 50"), root, "bank", "v2", dt.datetime(2024, 2, 1))
    assert active_header(spark, root, "bank")["profile_id"] == newer
    active = load_active(spark, root, "bank")
    assert active.edges["age"][-1] == 49.0 and list(active.edges) == list(first.edges)
    shares = {r["category"]: r["ref_share"] for r in active.categories.where("feature = 'job'").collect()}
    assert sum(shares.values()) == pytest.approx(1.0)


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_or_none(spark, path) is None
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2))], "id int, created_at timestamp")
    append(df, path, day_of="created_at")
    append(df, path, day_of="created_at")
    assert read_or_none(spark, path).count() == 4
    assert {p.name for p in (tmp_path / "log").glob("dt=*")} == {"dt=2024-01-01", "dt=2024-01-02"}
    assert [r["id"] for r in newest(df, 1).collect()] == [2]
    save_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_fingerprints(spark, tmp_path):
    (tmp_path / "model.bin").write_bytes(b"drift")
    row = file_fingerprints(spark, str(tmp_path / "model.bin")).first()
    assert row["md5"] == hashlib.md5(b"drift").hexdigest() and row["sha256"] == hashlib.sha256(b"drift").hexdigest()
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    same = table_fingerprint(a.repartition(3)).first()
    assert same == table_fingerprint(a).first() and same["rows"] == 3
    assert table_fingerprint(a.limit(0)).first()["rows"] == 0
    swapped = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert table_fingerprint(swapped.limit(1)).first() != table_fingerprint(swapped.where("a = 1")).first()
