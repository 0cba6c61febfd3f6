"""Cleaning, contract, sampling and profiling queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import truncated
from plumbline.operators import eda, sketches
from plumbline.operators.cleaning import (
    CleaningRules,
    Sentinel,
    align_to,
    clean,
    cleaning_checks,
    encode_target,
    handle_sentinel,
    json_safe,
    split_bad_targets,
    split_features_target,
    to_number,
    to_payload,
)
from plumbline.operators.contract import (
    Contract,
    Field,
    allowed_values,
    contract_table,
    infer_contract,
    property_table,
    split_valid,
    validate,
    validate_events,
)
from plumbline.operators.sampling import (
    full_shift,
    partial_shift,
    sample_slices,
    seeded_sample,
    split_summary,
    stratified_folds,
    stratified_split,
    train_test_split,
)
from plumbline.sources.folders import fresh_folder
from plumbline.sources.tables import append, load_delimited, newest, table_fingerprint
from plumbline.workloads.adapters import LABELLED_SQL, labelled_documents, stamp
from plumbline.workloads.registry import Tables, query

DISCOUNT = Sentinel("l_discount", 0.0, ("discount_was_0", "full_price_flag"), "discount_clean", -1.0)
ORDER_RULES = CleaningRules("o_orderstatus", {"F": 1, "O": 0}, drop=("o_custkey",))


# --- B: cleaning -------------------------------------------------------------


@query(
    "sentinel_clean",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_discount = 0)::BIGINT AS discount_was_0, (l_discount = 0)::BIGINT AS full_price_flag,
CASE WHEN l_discount = 0 THEN -1.0::DOUBLE ELSE l_discount END AS discount_clean FROM lineitem""",
)
def sentinel_clean(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return handle_sentinel(lines, DISCOUNT).drop("l_discount")


@query(
    "label_encoding",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS o_orderstatus FROM orders""",
)
def label_encoding(t: Tables) -> DataFrame:
    """Status as a 0/1 target; a status outside the map gives null."""
    return encode_target(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ORDER_RULES.labels)


@query(
    "target_quarantine",
    """SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN 'good' ELSE 'quarantined' END AS part, count(*) AS n FROM orders GROUP BY 1""",
)
def target_quarantine(t: Tables) -> DataFrame:
    good, bad = split_bad_targets(label_encoding(t), "o_orderstatus")
    parts = good.select(F.lit("good").alias("part")).unionByName(bad.select(F.lit("quarantined").alias("part")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "numeric_coercion",
    """SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, TRY_CAST(p_type AS DOUBLE) AS type_no FROM part""",
)
def numeric_coercion(t: Tables) -> DataFrame:
    """Text to numbers, with null for text that is not one."""
    parts = t.part.select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand_no"), F.col("p_type").alias("type_no"))
    return to_number(to_number(parts, "brand_no"), "type_no")


@query(
    "clean_orders",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS o_orderstatus, o_totalprice, o_orderpriority,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def clean_orders(t: Tables) -> DataFrame:
    """The whole cleaning recipe, bad targets set aside."""
    cleaned = clean(t.orders, ORDER_RULES, on_bad_target="quarantine")
    return cleaned.withColumn("o_orderdate", stamp("o_orderdate"))


@query(
    "cleaning_checks",
    """SELECT unnest(['o_custkey removed', 'target encoded as 0/1', '1-URGENT preserved in o_orderpriority']) AS "check",
unnest([true, (SELECT count(*) = 0 FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderstatus IS NULL),
(SELECT count(*) > 0 FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT')]) AS passed""",
)
def order_cleaning_checks(t: Tables) -> DataFrame:
    cleaned = clean(t.orders, ORDER_RULES, on_bad_target="quarantine")
    return cleaning_checks(cleaned, ORDER_RULES, {"o_orderpriority": "1-URGENT"})


@query(
    "aligned_rows",
    """SELECT p_size::BIGINT AS p_size, p_retailprice, coalesce(p_type, 'unknown') AS p_type, p_partkey FROM part""",
)
def aligned_rows(t: Tables) -> DataFrame:
    """Serving fields in contract order, nulls filled and dtypes enforced."""
    fields = [
        {"name": "p_size", "dtype": "int64"},
        {"name": "p_retailprice", "dtype": "float64"},
        {"name": "p_type", "dtype": "object", "allowed_values": []},
        {"name": "p_partkey", "dtype": "int64"},
    ]
    return json_safe(align_to(t.part, [f["name"] for f in fields]), fields)


@query(
    "row_payloads",
    """SELECT o_orderkey, to_json({'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority})::VARCHAR AS payload FROM orders""",
)
def row_payloads(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return to_payload(orders, integer=("o_custkey",), keep=("o_orderkey",))


@query(
    "display_rows",
    """SELECT p_partkey AS part, CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 8) || '...' END AS name,
coalesce(nullif(p_type, 'SMALL'), '—') AS kind FROM part""",
)
def display_rows(t: Tables) -> DataFrame:
    """Table view: long names shortened, a dash for what is missing."""
    return t.part.select(
        F.col("p_partkey").alias("part"),
        truncated(F.col("p_name"), 8).alias("name"),
        truncated(F.nullif("p_type", F.lit("SMALL")), 100).alias("kind"),
    )


# --- C: contract -------------------------------------------------------------


@query(
    "infer_schema",
    """SELECT * FROM (VALUES ('o_orderkey', 'int64', true, 'integer', NULL::BIGINT), ('o_custkey', 'int64', true, 'integer', NULL),
('o_totalprice', 'float64', true, 'number', NULL)) v(field, dtype, required, json_type, n_allowed)
UNION ALL SELECT 'o_orderpriority', 'object', true, 'string', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderstatus', 'object', true, 'string', count(DISTINCT o_orderstatus) FROM orders""",
)
def infer_schema(t: Tables) -> DataFrame:
    return contract_table(t.orders, target="o_orderdate")


@query(
    "allowed_values",
    """SELECT DISTINCT 'c_mktsegment' AS field, c_mktsegment AS value FROM customer
UNION ALL SELECT DISTINCT 'c_name', c_name FROM customer""",
)
def customer_allowed_values(t: Tables) -> DataFrame:
    """Allowed values in long form; a name per customer would not fit a list."""
    return allowed_values(t.customer, ["c_mktsegment", "c_name"])


@query(
    "json_schema_properties",
    """SELECT 'o_orderkey' AS field, '{"type":"integer"}' AS property UNION ALL SELECT 'o_custkey', '{"type":"integer"}'
UNION ALL SELECT 'o_totalprice', '{"type":"number"}'
UNION ALL SELECT 'o_orderstatus', '{"type":"string","enum":' || to_json(list_sort(list(DISTINCT o_orderstatus)))::VARCHAR || '}' FROM orders
UNION ALL SELECT 'o_orderpriority', '{"type":"string","enum":' || to_json(list_sort(list(DISTINCT o_orderpriority)))::VARCHAR || '}' FROM orders""",
)
def json_schema_properties(t: Tables) -> DataFrame:
    return property_table(t.orders, infer_contract(t.orders, target="o_orderdate"))


@query(
    "fallback_schema",
    """WITH head AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)
SELECT 'o_orderkey' AS field, '{"type":"integer"}' AS property UNION ALL SELECT 'o_custkey', '{"type":"integer"}'
UNION ALL SELECT 'o_totalprice', '{"type":"number"}'
UNION ALL SELECT 'o_orderstatus', '{"type":"string","enum":' || to_json(list_sort(list(DISTINCT o_orderstatus)))::VARCHAR || '}' FROM head
UNION ALL SELECT 'o_orderpriority', '{"type":"string","enum":' || to_json(list_sort(list(DISTINCT o_orderpriority)))::VARCHAR || '}' FROM head""",
)
def fallback_schema(t: Tables) -> DataFrame:
    """Contract from the first 100 orders, as when no artifact is at hand."""
    from plumbline.operators.contract import infer_fallback_contract

    return property_table(t.orders, infer_fallback_contract(t.orders, [F.col("o_orderkey")], "o_orderdate"))


EVENT_CONTRACT = Contract(
    (
        Field("k", "int64"),
        Field("value", "float64"),
        Field("event_type", "object", ("click", "error", "purchase", "view")),
    ),
    target="prediction",
    excluded=("duration",),
)

# Payloads with every kind of mistake, chosen by the row's own value.
PAYLOAD_RULES = {
    "value < 5": """'{"k": ' || k || '}'""",
    "value < 10": """'{"k": "' || k || '", "value": true, "event_type": "' || event_type || '"}'""",
    "value < 15": """'{"k": ' || k || '.0, "value": ' || k || ', "event_type": "' || event_type || '"}'""",
    "value < 20": """'{"k": ' || k || ', "value": 1.5, "event_type": "' || event_type || '", "duration": 3}'""",
    "value < 25": """'{"k": ' || k || ', "value": 2.5, "event_type": 7, "extra": null, "prediction": 1}'""",
    "value < 30": """'{"k": ' || k || ', "value": '""",
    "value < 35": """'[' || k || ']'""",
}
GOOD_PAYLOAD = """'{"k": ' || k || ', "value": ' || k || '.5, "event_type": "' || event_type || '"}'"""
PAYLOAD_SQL = (
    "CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p in PAYLOAD_RULES.items()) + f" ELSE {GOOD_PAYLOAD} END"
)


def event_payloads(events: DataFrame) -> DataFrame:
    """(event_id, ts, payload) with payload text built from each event."""
    rows = events.withColumn("k", F.get_json_object("props", "$.k"))
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(PAYLOAD_SQL).alias("payload"))


CHECKED_SQL = f"""
payloads AS (
  SELECT event_id, {PAYLOAD_SQL} AS payload FROM (SELECT event_id, value, event_type, json_extract_string(props, '$.k') AS k FROM events)),
parsed AS (
  SELECT event_id, payload, CASE WHEN json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload ELSE '0' END) = 'OBJECT' THEN payload END AS doc FROM payloads),
keyed AS (
  SELECT event_id, payload, doc, coalesce(json_keys(doc), []) AS keys, json_type(doc, '$.k') AS tk, json_type(doc, '$.value') AS tv,
         json_type(doc, '$.event_type') AS te, json_extract_string(doc, '$.event_type') AS et FROM parsed),
checked AS (
  SELECT event_id, doc, doc IS NULL AS malformed,
    CASE WHEN doc IS NULL THEN '' ELSE array_to_string(list_filter(['k', 'value', 'event_type'], lambda x: NOT list_contains(keys, x)), ',') END AS missing,
    array_to_string(list_sort(list_filter(keys, lambda x: NOT list_contains(['k', 'value', 'event_type'], x))), ',') AS unknown,
    array_to_string(list_sort(list_filter(keys, lambda x: list_contains(['duration', 'prediction'], x))), ',') AS excluded,
    array_to_string(list_filter([CASE WHEN tk IS NOT NULL AND tk NOT IN ('BIGINT', 'UBIGINT') THEN 'k' END,
      CASE WHEN tv IS NOT NULL AND tv NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'value' END,
      CASE WHEN te IS NOT NULL AND te <> 'VARCHAR' THEN 'event_type' END], lambda x: x IS NOT NULL), ',') AS invalid_types,
    CASE WHEN te = 'VARCHAR' AND et NOT IN ('click', 'error', 'purchase', 'view') THEN 'event_type' ELSE '' END AS invalid_values
  FROM keyed)"""


@query(
    "validate_payloads",
    f"WITH {CHECKED_SQL} SELECT event_id, malformed, missing, unknown, excluded, invalid_types, invalid_values FROM checked",
)
def validate_payloads(t: Tables) -> DataFrame:
    checked = validate(event_payloads(t.events), EVENT_CONTRACT)
    e = F.col("errors")
    return checked.select(
        "event_id",
        e["malformed"].alias("malformed"),
        *[F.array_join(e[n], ",").alias(n) for n in ("missing", "unknown", "excluded")],
        F.array_join(F.map_keys(e["invalid_types"]), ",").alias("invalid_types"),
        F.array_join(e["invalid_values"], ",").alias("invalid_values"),
    )


@query(
    "accepted_payloads",
    f"""WITH {CHECKED_SQL} SELECT event_id, (doc->>'$.k')::BIGINT AS k, (doc->>'$.value')::DOUBLE AS value, doc->>'$.event_type' AS event_type
FROM checked WHERE NOT malformed AND missing || unknown || excluded || invalid_types || invalid_values = ''""",
)
def accepted_payloads(t: Tables) -> DataFrame:
    """Typed rows of the payloads that keep the contract."""
    good, _ = split_valid(validate(event_payloads(t.events), EVENT_CONTRACT))
    return good.select("event_id", "k", "value", "event_type")


# --- D: sampling, splitting, shifting ----------------------------------------


@query(
    "stratified_split_summary",
    """WITH c AS (SELECT quality AS y, count(*) AS n FROM labels GROUP BY 1), s AS (SELECT sum(n) AS n FROM c),
q AS (SELECT y, c.n, floor(s.n * 0.6)::BIGINT AS k, floor(s.n * 0.6)::BIGINT * c.n / s.n AS x FROM c, s),
b AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY floor(x) - x, y) <= k - sum(floor(x)) OVER ())::INT AS train FROM q),
r AS (SELECT y, n, train, n - train AS rest, ceil(sum(n - train) OVER () * 0.5) AS k2, sum(n - train) OVER () AS left_n FROM b),
d AS (SELECT *, k2 * rest / left_n AS x2 FROM r),
e AS (SELECT *, floor(x2) + (row_number() OVER (ORDER BY floor(x2) - x2, y) <= k2 - sum(floor(x2)) OVER ())::INT AS test FROM d),
p AS (SELECT 'train' AS split, y, train AS m FROM e UNION ALL SELECT 'validation', y, rest - test FROM e UNION ALL SELECT 'test', y, test FROM e)
SELECT split, sum(m)::BIGINT AS rows, sum(m * y)::BIGINT AS positives, round(100.0::DOUBLE * sum(m * y) / sum(m), 2)::DOUBLE AS positive_rate FROM p GROUP BY split""",
)
def stratified_split_summary(t: Tables) -> DataFrame:
    return split_summary(stratified_split(t.labels, "quality", "doc_id"), "quality")


@query(
    "two_way_split_summary",
    """WITH c AS (SELECT quality AS y, count(*) AS n FROM labels GROUP BY 1), s AS (SELECT sum(n) AS n FROM c),
q AS (SELECT y, c.n, (s.n - ceil(s.n * 0.3))::BIGINT AS k, (s.n - ceil(s.n * 0.3)) * c.n / s.n AS x FROM c, s),
b AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY floor(x) - x, y) <= k - sum(floor(x)) OVER ())::INT AS train FROM q),
p AS (SELECT 'train' AS split, y, train AS m FROM b UNION ALL SELECT 'test', y, n - train FROM b)
SELECT split, sum(m)::BIGINT AS rows, sum(m * y)::BIGINT AS positives, round(100.0::DOUBLE * sum(m * y) / sum(m), 2)::DOUBLE AS positive_rate FROM p GROUP BY split""",
)
def two_way_split_summary(t: Tables) -> DataFrame:
    return split_summary(train_test_split(t.labels, "quality", "doc_id", test=0.30), "quality")


# Classes of very different sizes, some of them with a single row.
PART_CLASS_SQL = "p_brand || '/' || (p_size // 5)"


def part_classes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws("/", "p_brand", F.floor(F.col("p_size") / 5)).alias("y"))


@query(
    "stratified_split_many_classes",
    f"""WITH c AS (SELECT {PART_CLASS_SQL} AS y, count(*) AS n FROM part GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS n FROM c),
q AS (SELECT y, c.n, floor(s.n * 0.6)::BIGINT AS k, (floor(s.n * 0.6)::BIGINT * c.n // s.n)::BIGINT AS w, (floor(s.n * 0.6)::BIGINT * c.n % s.n)::BIGINT AS m FROM c, s),
b AS (SELECT *, w + (row_number() OVER (ORDER BY m DESC, '=' || y) <= k - sum(w) OVER ())::INT AS train FROM q),
r AS (SELECT y, n, train, n - train AS rest, ceil(sum(n - train) OVER () * 0.5)::BIGINT AS k2, (sum(n - train) OVER ())::BIGINT AS left_n FROM b),
d AS (SELECT *, (k2 * rest // left_n)::BIGINT AS w2, (k2 * rest % left_n)::BIGINT AS m2 FROM r),
e AS (SELECT *, w2 + (row_number() OVER (ORDER BY m2 DESC, '=' || y) <= k2 - sum(w2) OVER ())::INT AS test FROM d),
p AS (SELECT y, 'train' AS split, train AS m FROM e UNION ALL SELECT y, 'validation', rest - test FROM e UNION ALL SELECT y, 'test', test FROM e)
SELECT y, split, m::BIGINT AS rows FROM p WHERE m > 0""",
)
def stratified_split_many_classes(t: Tables) -> DataFrame:
    """Rows per class and part of a three-way split over many classes."""
    split = stratified_split(part_classes(t), "y", "p_partkey")
    return split.groupBy("y", "split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "two_way_split_many_classes",
    """WITH c AS (SELECT l_suppkey AS y, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS n FROM c),
q AS (SELECT y, c.n, (s.n - ceil(s.n * 0.2))::BIGINT AS k, ((s.n - ceil(s.n * 0.2))::BIGINT * c.n // s.n)::BIGINT AS w, ((s.n - ceil(s.n * 0.2))::BIGINT * c.n % s.n)::BIGINT AS m FROM c, s),
b AS (SELECT *, w + (row_number() OVER (ORDER BY m DESC, '=' || y) <= k - sum(w) OVER ())::INT AS train FROM q),
p AS (SELECT y, 'train' AS split, train AS m FROM b UNION ALL SELECT y, 'test', n - train FROM b)
SELECT y, split, m::BIGINT AS rows FROM p WHERE m > 0""",
)
def two_way_split_many_classes(t: Tables) -> DataFrame:
    """Rows per supplier and part of a two-way split of all lines."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("y"))
    split = train_test_split(lines, "y", ["l_orderkey", "l_linenumber"])
    return split.groupBy("y", "split").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "kfold_summary",
    """WITH c AS (SELECT (event_type = 'click')::INT AS y, count(*) AS n FROM events GROUP BY 1)
SELECT f AS fold, y AS label, (ceil((f + 1) * n / 5.0) - ceil(f * n / 5.0))::BIGINT AS rows FROM c, (SELECT unnest(range(0, 5))::INT AS f)""",
)
def kfold_summary(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("event_type") == "click").cast("int").alias("label"))
    folds = stratified_folds(rows, "label", "event_id", 5)
    return folds.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "seeded_sample",
    """SELECT least(500, count(*))::BIGINT AS rows, least(500, count(*))::BIGINT AS distinct_keys, true AS all_known FROM events""",
)
def seeded_sample_summary(t: Tables) -> DataFrame:
    """Size and key check of a 500-row sample (a sampling operator; which rows depends on the hash)."""
    sample = seeded_sample(t.events, "event_id", 500)
    known = t.events.select("event_id", F.lit(True).alias("known"))
    return sample.join(known, "event_id", "left").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("event_id").alias("distinct_keys"),
        F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"),
    )


@query(
    "sample_slices",
    """WITH s AS (SELECT least(250, count(*)) AS a, greatest(least(250, count(*) - 250), 0) AS b FROM events)
SELECT 'normal' AS part, a AS rows, a AS distinct_keys FROM s UNION ALL SELECT 'shifted', b, b FROM s UNION ALL SELECT 'both', a + b, a + b FROM s""",
)
def sample_slices_summary(t: Tables) -> DataFrame:
    """Two disjoint slices of 250 rows each, the second one shifted."""
    normal, rest = sample_slices(t.events.select("event_id", "value", "event_type"), "event_id", [250, 250])
    shifted = full_shift(rest, add={"value": 3.0}, overwrite={"event_type": "signup"})
    both = normal.withColumn("part", F.lit("normal")).unionByName(shifted.withColumn("part", F.lit("shifted")))
    both = both.unionByName(both.withColumn("part", F.lit("both")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("distinct_keys"))


@query(
    "sample_repeated_keys",
    """WITH n AS (SELECT count(*) AS n, (count(*) * 2 // 5)::BIGINT AS m FROM lineitem)
SELECT 'sample' AS part, m AS rows, m AS known, 0::BIGINT AS beyond FROM n UNION ALL SELECT 'first', m, m, 0 FROM n
UNION ALL SELECT 'rest', n - m, n - m, 0 FROM n UNION ALL SELECT 'both', n, n, 0 FROM n""",
)
def repeated_keys_sample(t: Tables) -> DataFrame:
    """Two fifths of the lines by a key that has three values, and the slices before and behind that cut.

    Every row is found again in the table, and none more often than it stands there.
    """
    names = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax"]
    lines = t.lineitem.select(*names)
    n = lines.count()
    size = n * 2 // 5
    first, rest = sample_slices(lines, "l_returnflag", [size, n])
    parts = {"sample": seeded_sample(lines, "l_returnflag", size), "first": first, "rest": rest, "both": first.unionByName(rest)}
    table = lines.groupBy(*names).agg(F.count(F.lit(1)).alias("there"))
    out = None
    for part, rows in parts.items():
        counted = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("taken")).join(table, names, "left")
        summary = counted.agg(
            F.sum("taken").alias("rows"),
            F.sum(F.when(F.col("there").isNotNull(), F.col("taken")).otherwise(0)).alias("known"),
            F.sum((F.col("taken") > F.col("there")).cast("long")).alias("beyond"),
        ).select(F.lit(part).alias("part"), "rows", "known", "beyond")
        out = summary if out is None else out.unionByName(summary)
    return out


@query("full_shift", "SELECT event_id, value + 3.0 AS value, 'signup' AS event_type FROM events")
def shifted_events(t: Tables) -> DataFrame:
    return full_shift(t.events.select("event_id", "value", "event_type"), {"value": 3.0}, {"event_type": "signup"})


@query(
    "drift_injection",
    """SELECT event_id, strength, CASE WHEN hit THEN value + delta ELSE value END AS value, CASE WHEN hit THEN 'signup' ELSE event_type END AS event_type, hit
FROM (SELECT *, row_number() OVER (PARTITION BY strength ORDER BY event_id) <= greatest(1, floor(share * count(*) OVER (PARTITION BY strength))) AS hit
  FROM events, (VALUES ('Mild', 0.35::DOUBLE, 0.8::DOUBLE), ('Medium', 0.65::DOUBLE, 1.6::DOUBLE), ('Strong', 1.0::DOUBLE, 3.0::DOUBLE)) v(strength, share, delta))""",
)
def drift_injection(t: Tables) -> DataFrame:
    """The three shift profiles applied to the events in key order."""
    out = None
    for strength in ("Mild", "Medium", "Strong"):
        rows = partial_shift(
            t.events.select("event_id", "value", "event_type"), F.col("event_id"), "value", "event_type", "signup", strength, "hit"
        ).withColumn("strength", F.lit(strength))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- E: profiling ------------------------------------------------------------


def overview_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{d}' AS dtype, count(*) - count({c}) AS missing_count,
round((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS missing_percent,
count(DISTINCT {c}) + (count(*) > count({c}))::INT AS unique_count FROM {table}"""
        for c, d in columns.items()
    )


LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
PART_TYPES = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double",
}


@query("column_overview", overview_sql("part", PART_TYPES))
def part_overview(t: Tables) -> DataFrame:
    return eda.column_overview(t.part)


@query("column_overview_large", overview_sql("lineitem", LINE_TYPES))
def line_overview(t: Tables) -> DataFrame:
    return eda.column_overview(t.lineitem)


@query(
    "missing_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({e}) AS missing_count,
round((count(*) - count({e}))::DOUBLE / count(*) * 100, 6) AS missing_percent FROM orders"""
        for c, e in {"o_orderkey": "o_orderkey", "status": "nullif(o_orderstatus, 'P')", "cheap": "CASE WHEN o_totalprice < 100000 THEN o_totalprice END"}.items()
    ),
)
def order_missing(t: Tables) -> DataFrame:
    """Missing counts after open and costly orders are blanked."""
    orders = t.orders.select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.when(F.col("o_totalprice") < 100000, F.col("o_totalprice")).alias("cheap"),
    )
    rows = eda.missing_summary(orders)
    return rows.withColumn("missing_percent", F.round("missing_percent", 6))


DUPLICATE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]


@query(
    "duplicate_summary",
    f"""WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY {", ".join(DUPLICATE_COLUMNS)})
SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_count, round(sum(n - 1)::DOUBLE / sum(n) * 100, 6) AS duplicate_percent FROM g""",
)
def line_duplicates(t: Tables) -> DataFrame:
    rows = eda.duplicate_summary(t.lineitem.select(*DUPLICATE_COLUMNS))
    return rows.withColumn("duplicate_percent", F.round("duplicate_percent", 6))


@query(
    "duplicate_documents",
    """WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text, lang)
SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_count, round(sum(n - 1)::DOUBLE / sum(n) * 100, 6) AS duplicate_percent FROM g""",
)
def document_duplicates(t: Tables) -> DataFrame:
    """Equal documents, by whole text."""
    rows = eda.duplicate_summary(t.documents.select("text", "lang"))
    return rows.withColumn("duplicate_percent", F.round("duplicate_percent", 6))


@query(
    "quality_summary",
    """WITH o AS (SELECT nullif(o_orderstatus, 'P') AS s, o_orderpriority AS p FROM orders), g AS (SELECT count(*) AS n FROM o GROUP BY s, p)
SELECT (SELECT sum(n) FROM g)::BIGINT AS row_count, (SELECT sum(n - 1) FROM g)::BIGINT AS duplicate_rows, (SELECT count(*) FROM o WHERE s IS NULL) AS missing_cells""",
)
def order_quality(t: Tables) -> DataFrame:
    return eda.quality_summary(t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_orderpriority").alias("p")))


@query("table_shape", "SELECT count(*) AS rows, 6 AS columns, 3 AS numeric_features, 2 AS categorical_features FROM orders")
def order_shape(t: Tables) -> DataFrame:
    return eda.shape(t.orders, target="o_orderstatus")


@query(
    "category_target_rate",
    f"""WITH {LABELLED_SQL}, l AS (SELECT 'lang' AS "column", lang AS category, quality FROM labelled UNION ALL SELECT 'source', source, quality FROM labelled),
g AS (SELECT "column", category, count(quality) AS count, round(avg(quality) * 100, 6) AS target_yes_percent FROM l GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY "column") AS cardinality FROM g""",
)
def document_target_rate(t: Tables) -> DataFrame:
    rows = eda.category_target_rate(labelled_documents(t), ["lang", "source"], "quality")
    return rows.withColumn("target_yes_percent", F.round("target_yes_percent", 6))


@query(
    "target_rate_min_count",
    f"""WITH {LABELLED_SQL} SELECT source AS category, count(*) AS count, round(avg(quality) * 100, 2) AS yes_rate FROM labelled
GROUP BY source HAVING count(*) >= 20 ORDER BY yes_rate DESC, category LIMIT 12""",
)
def source_target_rate(t: Tables) -> DataFrame:
    """The twelve sources with the best quality rate, of those with 20 documents or more."""
    return eda.target_rate_table(labelled_documents(t), "source", "quality", 20, 12)


def summary_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 5)::DOUBLE AS mean, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS median,
min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(skewness({c}), 6) AS skew FROM {table}"""
        for c in columns
    )


LINE_NUMBERS = [c for c, d in LINE_TYPES.items() if d not in ("string", "timestamp_ntz")]


@query("numeric_summary", summary_sql("lineitem", LINE_NUMBERS))
def line_numeric_summary(t: Tables) -> DataFrame:
    rows = eda.numeric_summary(t.lineitem)
    return rows.select("column", F.round("mean", 5).alias("mean"), F.round("median", 6).alias("median"), "min", "max", F.round("skew", 6).alias("skew"))


@query(
    "describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 5)::DOUBLE AS mean, round(stddev_samp({c}), 5) AS std, min({c})::DOUBLE AS min,
round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q25, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS q50, round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q75, max({c})::DOUBLE AS max FROM customer"""
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    ),
)
def customer_describe(t: Tables) -> DataFrame:
    rows = eda.describe_numeric(t.customer)
    return rows.select(
        "column", "count", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min",
        *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")], "max",
    )


@query(
    "token_summary",
    """SELECT * FROM (
SELECT 'lang' AS "column", count(*) FILTER (lang = 'en') AS token_count, round(count(*) FILTER (lang = 'en')::DOUBLE / count(*) * 100, 2) AS token_percent, count(DISTINCT lang) AS unique_count FROM documents
UNION ALL SELECT 'text', count(*) FILTER (text = 'en'), round(count(*) FILTER (text = 'en')::DOUBLE / count(*) * 100, 2), count(DISTINCT text) FROM documents
UNION ALL SELECT 'source', count(*) FILTER (source = 'en'), round(count(*) FILTER (source = 'en')::DOUBLE / count(*) * 100, 2), count(DISTINCT source) FROM documents) WHERE token_count > 0""",
)
def document_tokens(t: Tables) -> DataFrame:
    return eda.token_summary(t.documents, "en")


@query(
    "numeric_target_corr",
    f"""WITH {LABELLED_SQL} SELECT 'doc_id' AS "column", round(corr(doc_id, quality), 6) AS correlation FROM labelled
UNION ALL SELECT 'n_chars', round(corr(n_chars, quality), 6) FROM labelled UNION ALL SELECT 'toxic', round(corr(toxic, quality), 6) FROM labelled
UNION ALL SELECT 'score', round(corr(score, quality), 6) FROM labelled""",
)
def document_correlation(t: Tables) -> DataFrame:
    rows = eda.target_correlation(labelled_documents(t), "quality")
    return rows.withColumn("correlation", F.round("correlation", 6))


PRICE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"""SELECT '{a}' AS "left", '{b}' AS "right", round(corr({a}, {b}), 6) AS correlation FROM lineitem"""
        for a in PRICE_COLUMNS
        for b in PRICE_COLUMNS
    ),
)
def line_correlations(t: Tables) -> DataFrame:
    rows = eda.correlation_matrix(t.lineitem, PRICE_COLUMNS)
    return rows.withColumn("correlation", F.round("correlation", 6))


@query(
    "value_counts_pct",
    """SELECT event_type AS value, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM events) * 100, 2) AS percent FROM events GROUP BY 1""",
)
def event_counts(t: Tables) -> DataFrame:
    return eda.value_counts(t.events, "event_type")


@query(
    "value_counts_top",
    """SELECT l_partkey AS value, count(*) AS count, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem) * 100, 2) AS percent FROM lineitem
GROUP BY 1 ORDER BY count DESC, value LIMIT 10""",
)
def part_counts(t: Tables) -> DataFrame:
    """The ten parts sold most often."""
    return eda.value_counts(t.lineitem, "l_partkey", 10)


@query(
    "group_share",
    """WITH c AS (SELECT l_discount = 0 AS "group", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT "group", value, round(n::DOUBLE / sum(n) OVER (PARTITION BY "group") * 100, 2) AS percent FROM c""",
)
def flag_share(t: Tables) -> DataFrame:
    """Return flags among lines with and without the sentinel discount."""
    return eda.group_share(t.lineitem, F.col("l_discount") == 0, "l_returnflag")


@query("class_counts", "SELECT quality AS class, count(*) AS n FROM labels GROUP BY 1")
def label_class_counts(t: Tables) -> DataFrame:
    return t.labels.groupBy(F.col("quality").alias("class")).agg(F.count(F.lit(1)).alias("n"))


BANDS_SQL = """WITH n AS (SELECT {v}, row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM {table})
SELECT greatest(1, ceil(10 * i / (n - 1)))::INT AS band, count(*) AS rows, {means} FROM n GROUP BY 1"""


@query(
    "order_bands",
    BANDS_SQL.format(
        v="value, json_extract_string(props, '$.k')::DOUBLE AS k, (event_type = 'click')::INT AS c", order="ts, event_id", table="events",
        means="round(avg(value), 3) AS value, round(avg(k), 3) AS k, round(avg(c) * 100, 3) AS click_rate",
    ),
)
def event_bands(t: Tables) -> DataFrame:
    """Ten equal bands of the events in time order."""
    micros: Column = F.unix_micros(F.col("ts").cast("timestamp"))
    return eda.order_bands(
        t.events, micros, F.col("event_id"),
        {
            "value": F.col("value"),
            "k": F.get_json_object("props", "$.k").cast("double"),
            "click_rate": (F.col("event_type") == "click").cast("int") * 100,
        },
    )


@query(
    "order_bands_ties",
    BANDS_SQL.format(
        v="l_quantity, l_discount", order="l_linenumber, l_orderkey * 10 + l_linenumber", table="(SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, 0 AS l_quantity, 0 AS l_discount FROM lineitem)",
        means="round(avg(l_quantity), 3)::DOUBLE AS quantity, round(avg(l_discount), 3)::DOUBLE AS discount",
    ),
)
def line_bands(t: Tables) -> DataFrame:
    """Bands over a key with a handful of values, so that the tie-break decides."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    zero = F.lit(0)
    return eda.order_bands(
        lines, F.col("l_linenumber").cast("long"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), {"quantity": zero, "discount": zero}
    )


HIST_SQL = """WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}),
b AS (SELECT {k} least(floor(({c} - lo) / ((hi - lo) / {n}))::INT + 1, {n}) AS bin, (hi - lo) / {n} AS w, lo FROM {t}, r)"""


@query(
    "histogram_bins",
    HIST_SQL.format(c="o_totalprice", t="orders", k="", n=30)
    + """ SELECT 'o_totalprice' AS "column", bin, round(lo + w * (bin - 1), 6) AS lower, round(lo + w * bin, 6) AS upper, count(*) AS n,
round(count(*)::DOUBLE / sum(count(*)) OVER () / w, 12) AS density FROM b GROUP BY bin, lo, w""",
)
def price_histogram(t: Tables) -> DataFrame:
    rows = eda.histogram(t.orders, ["o_totalprice"], 30)
    return rows.select("column", "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n", F.round("density", 12).alias("density"))


@query(
    "histogram_by_class",
    HIST_SQL.format(c="value", t="events", k="event_type AS class,", n=40)
    + """ SELECT 'value' AS "column", class, bin, round(lo + w * (bin - 1), 6) AS lower, round(lo + w * bin, 6) AS upper, count(*) AS n,
round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY class) / w, 10) AS density FROM b GROUP BY class, bin, lo, w""",
)
def value_histogram(t: Tables) -> DataFrame:
    rows = eda.histogram(t.events, ["value"], 40, by="event_type")
    return rows.select("column", "class", "bin", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n", F.round("density", 10).alias("density"))


# --- A: sources --------------------------------------------------------------


@query("table_fingerprint")
def fingerprints(t: Tables) -> DataFrame:
    """Order-free fingerprints of all relational tables."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    out = None
    for name in names:
        row = table_fingerprint(getattr(t, name)).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "newest_rows",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderstatus FROM orders ORDER BY orders.o_orderdate DESC, orders.o_orderkey DESC LIMIT 25""",
)
def newest_orders(t: Tables) -> DataFrame:
    """The newest 25 rows of a log."""
    rows = newest(t.orders, 25, "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", stamp("o_orderdate").alias("o_orderdate"), "o_orderstatus")


SKETCHED = ["l_quantity", "l_extendedprice", "l_discount"]
SKETCH_FRACTIONS = [0.1, 0.25, 0.5, 0.75, 0.9]
YEARS = [(1992, 1998), (1995, 1995), (1994, 1996)]


@query(
    "stored_sketches",
    " UNION ALL ".join(
        f"""SELECT '{a}-{b}' AS years, '{c}' AS "column", {f}::DOUBLE AS fraction, count(*) AS rows, count(*) - count({c}) AS nulls, min({c}) AS low, max({c}) AS high,
true AS within_bound, true AS distinct_within_bound FROM lineitem WHERE year(l_shipdate) BETWEEN {a} AND {b} HAVING count({c}) > 0"""
        for a, b in YEARS
        for c in SKETCHED
        for f in SKETCH_FRACTIONS
    ),
)
def stored_sketches(t: Tables) -> DataFrame:
    """Lines sketched day by day and stored; ranges of years merged from the stored rows alone.

    Counts and limits are exact. The approximate numbers are held against the exact ones with the bound that the sketches promise.
    """
    root = fresh_folder(t.spark)
    append(sketches.daily_sketches(t.lineitem, F.to_date("l_shipdate"), SKETCHED), root)
    stored = t.spark.read.parquet(root)
    out = None
    for a, b in YEARS:
        rows = sketches.merged(stored, F.year("day").between(a, b))
        found = sketches.approximate_quantiles(rows, SKETCH_FRACTIONS).select("column", "fraction", "value")
        facts = rows.select("column", "rows", "nulls", "low", "high", F.hll_sketch_estimate("distinct").alias("distinct"))
        # What the answers are worth, from the lines themselves.
        lines = t.lineitem.where(F.year("l_shipdate").between(a, b))
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in SKETCHED])
        long = lines.select(F.inline(cells)).where("v IS NOT NULL").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        exact = long.groupBy("column").agg(F.count(F.lit(1)).alias("exact"), F.sum("n").alias("all"))
        # A few answers per column.
        ranks = long.join(F.broadcast(found), "column").groupBy("column", "fraction").agg(
            F.sum(F.when(F.col("v") < F.col("value"), F.col("n")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("v") <= F.col("value"), F.col("n")).otherwise(0)).alias("upto"),
        )
        error = sketches.rank_error()
        good = (F.col("below") / F.col("all") - error <= F.col("fraction")) & (F.col("fraction") <= F.col("upto") / F.col("all") + error)
        near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), sketches.distinct_error() * F.col("exact"))
        part = ranks.join(exact, "column").join(facts, "column").select(
            F.lit(f"{a}-{b}").alias("years"), "column", "fraction", "rows", "nulls", "low", "high", good.alias("within_bound"), near.alias("distinct_within_bound")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "delimited_orders",
    """SELECT 'features' AS part, count(*) AS rows, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderpriority) AS kinds FROM orders
UNION ALL SELECT 'labels', count(*), sum(o_custkey % 2)::DOUBLE, count(DISTINCT o_custkey % 2) FROM orders""",
)
def delimited_orders(t: Tables) -> DataFrame:
    """Orders written as a semicolon file, read back by its header, brought into the wanted order and split into features and target."""
    root = fresh_folder(t.spark)
    odd = (F.col("o_custkey") % 2).alias(" odd")
    t.orders.select("o_orderkey", F.col("o_totalprice").alias(" o_totalprice "), "o_orderpriority", odd).write.option("sep", ";").option("header", True).csv(root)
    raw = load_delimited(t.spark, root, "o_orderkey bigint, o_totalprice double, o_orderpriority string, odd int")
    features, labels = split_features_target(align_to(raw, ["odd", "o_orderpriority", "o_totalprice"]), "odd")
    left = features.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_orderpriority").alias("kinds"))
    right = labels.agg(F.count(F.lit(1)).alias("rows"), F.sum("odd").cast("double").alias("total"), F.count_distinct("odd").alias("kinds"))
    return left.select(F.lit("features").alias("part"), "*").unionByName(right.select(F.lit("labels").alias("part"), "*"))


#: What is wrong with a drift event message, by the remainder of the event's id.
EVENT_FAULTS = ["none", "unknown severity", "no model name", "six metrics", "unknown metric", "not JSON", "no threshold", "no window size", "no time", "no previous severity"]


@query(
    "drift_events_of_every_kind",
    f"""SELECT {[*EVENT_FAULTS]}[(event_id % {len(EVENT_FAULTS)} + 1)::INT] AS fault, count(*) AS messages,
count(*) FILTER (event_id % {len(EVENT_FAULTS)} = 0) AS valid FROM events GROUP BY 1""",
)
def drift_events_of_every_kind(t: Tables) -> DataFrame:
    """A drift event message per event, nine tenths of them broken in one of nine ways, judged by the consumer's contract."""
    kind = F.col("event_id") % len(EVENT_FAULTS)
    metric = F.struct(
        F.lit("value").alias("feature"),
        F.when(kind == 4, "ks").otherwise("psi").alias("metric"),
        F.col("value").alias("value"),
        F.when(kind != 6, 0.2).alias("threshold"),
    )
    message = F.struct(
        F.concat(F.lit("e-"), "event_id").alias("event_id"),
        F.when(kind == 8, "yesterday").otherwise("2024-02-01T00:00:00Z").alias("emitted_at"),
        F.when(kind != 2, "monitored-model").alias("model_name"),
        F.lit(3).alias("model_version"),
        F.lit("2024-01-31T00:00:00Z").alias("window_start"),
        F.lit("2024-02-01T00:00:00Z").alias("window_end"),
        F.when(kind != 7, 200).alias("window_size"),
        F.when(kind != 9, "green").alias("previous_severity"),
        F.when(kind == 1, "blue").otherwise("red").alias("current_severity"),
        F.array_repeat(metric, F.when(kind == 3, 6).otherwise(2)).alias("top_metrics"),
    )
    payload = F.when(kind == 5, "{").otherwise(F.to_json(message)).alias("payload")
    fault = F.get(F.array(*[F.lit(x) for x in EVENT_FAULTS]), kind.cast("int")).alias("fault")
    judged = validate_events(t.events.select(fault, payload))
    return judged.groupBy("fault").agg(F.count(F.lit(1)).alias("messages"), F.count_if("event_valid").alias("valid"))
