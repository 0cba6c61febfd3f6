"""Registry, promotion, audit, event-log and job queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import truncated, version_number
from plumbline.operators import eventlog, registry
from plumbline.plans.promotion import promote
from plumbline.workloads.adapters import stamp
from plumbline.workloads.registry import Tables, query

# --- the given tables as registry tables -------------------------------------


def versions(t: Tables) -> DataFrame:
    """A model version per supplier; the model is the supplier's nation."""
    stage = F.when(F.col("s_acctbal") > 7000, "Production").when(F.col("s_acctbal") < 1000, "Archived").otherwise("Staging")
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("model_name"),
        F.col("s_suppkey").cast("string").alias("version"),
        stage.alias("stage"),
        F.concat(F.lit("s3://models/"), "s_name").alias("source"),
        F.concat(F.lit("run-"), F.col("s_suppkey")).alias("run_id"),
        F.timestamp_seconds(F.floor("s_acctbal") + 1_000_000).alias("updated_at"),
        F.map_from_arrays(F.array(F.lit("lifecycle_status"), F.lit("owner")), F.array(F.lit("candidate"), F.col("s_name"))).alias("tags"),
    )


VERSIONS_SQL = """
versions AS (
  SELECT n_name AS model_name, s_suppkey::VARCHAR AS version,
         CASE WHEN s_acctbal > 7000 THEN 'Production' WHEN s_acctbal < 1000 THEN 'Archived' ELSE 'Staging' END AS stage,
         'run-' || s_suppkey AS run_id, s_suppkey, floor(s_acctbal) AS updated_at, s_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def aliases(t: Tables) -> DataFrame:
    """Production alias for nations of region 1, Default alias for those of region 2."""
    rows = versions(t).join(t.nation.select(F.col("n_name").alias("model_name"), "n_regionkey"), "model_name")
    chosen = rows.where(F.col("n_regionkey").isin(1, 2)).groupBy("model_name", "n_regionkey")
    return chosen.agg(F.min(F.col("version").cast("int")).cast("string").alias("version")).select(
        "model_name", F.when(F.col("n_regionkey") == 1, "Production").otherwise("Default").alias("alias"), "version"
    )


ALIASES_SQL = """
aliases AS (
  SELECT model_name, CASE n_regionkey WHEN 1 THEN 'Production' ELSE 'Default' END AS alias, min(s_suppkey)::VARCHAR AS version
  FROM versions JOIN nation ON n_name = model_name WHERE n_regionkey IN (1, 2) GROUP BY model_name, n_regionkey)"""


def runs(t: Tables) -> DataFrame:
    """Run metrics per supplier, aggregated from its lines; F1 is kept as a tag."""
    facts = t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.avg((F.col("l_linestatus") == "O").cast("int")) + 0.3, 6).alias("auc"),
        F.round(F.avg((F.col("l_quantity") > 12).cast("int")), 6).alias("recall"),
        F.round(F.avg("l_tax") * 10, 6).alias("f1"),
    )
    return facts.select(
        F.concat(F.lit("run-"), F.col("l_suppkey")).alias("run_id"),
        F.map_from_arrays(F.array(F.lit("test_auc"), F.lit("recall")), F.array("auc", "recall")).alias("metrics"),
        F.map_from_arrays(
            F.array(F.lit("test_f1"), F.lit("owner")), F.array(F.col("f1").cast("string"), F.lit("run"))
        ).alias("tags"),
    )


RUNS_SQL = """
runs AS (
  SELECT 'run-' || l_suppkey AS run_id, round(avg((l_linestatus = 'O')::INT) + 0.3, 6) AS auc,
         round(avg((l_quantity > 12)::INT), 6) AS recall, round(avg(l_tax) * 10, 6) AS f1
  FROM lineitem GROUP BY l_suppkey)"""


def artifacts(t: Tables) -> DataFrame:
    """Artifact files per run: every line of a supplier says which file it wrote, or none (a null path)."""
    kinds = F.create_map(F.lit("A"), F.lit("schema.json"), F.lit("N"), F.lit("threshold.json"), F.lit("R"), F.lit("card.md"))
    wrote = (F.col("l_quantity") >= 48) & (F.col("l_discount") >= 0.05)
    run = F.concat(F.lit("run-"), F.col("l_suppkey")).alias("run_id")
    return t.lineitem.select(run, F.when(wrote, kinds[F.col("l_returnflag")]).alias("path"))


ARTIFACTS_SQL = """
artifacts AS (
  SELECT DISTINCT 'run-' || l_suppkey AS run_id,
         CASE WHEN l_quantity < 48 OR l_discount < 0.05 THEN NULL
              WHEN l_returnflag = 'A' THEN 'schema.json' WHEN l_returnflag = 'N' THEN 'threshold.json' ELSE 'card.md' END AS path
  FROM lineitem),
missing AS (
  SELECT model_name, version, array_to_string(list_filter(['schema.json', 'threshold.json', 'card.md'],
         lambda p: NOT list_contains(coalesce(a.found, []), p)), ',') AS missing
  FROM versions v LEFT JOIN (SELECT run_id, list(path) AS found FROM artifacts GROUP BY run_id) a USING (run_id))"""


def requests(t: Tables) -> DataFrame:
    """A promotion request per line; the lines of an order share a request id."""
    models = versions(t).select(F.col("version").alias("v"), "model_name")
    lines = t.lineitem.withColumn("v", F.col("l_suppkey").cast("string")).join(models, "v")
    version = F.when(F.col("l_discount") == 0, F.concat(F.lit("x"), "v")).otherwise(F.col("v"))
    yes = F.lit(True)
    return lines.select(
        F.concat(F.lit("req-"), F.col("l_orderkey")).alias("request_id"),
        "model_name",
        version.alias("version"),
        (F.col("l_quantity") > 3).alias("hil_approved"),
        (F.col("l_tax") < 0.08).alias("tests_passed"),
        yes.alias("schema_compatible"),
        yes.alias("metrics_available"),
        F.when(F.col("l_extendedprice") > 2000, yes).alias("rollback_plan_exists"),
        yes.alias("artifact_triple_exists"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        "l_linenumber",
        "l_extendedprice",
    )


REQUEST_ORDER = ("created_at", "l_linenumber", "l_extendedprice")
REQUESTS_SQL = """
requests AS (
  SELECT 'req-' || l_orderkey AS request_id, model_name,
         CASE WHEN l_discount = 0 THEN 'x' || l_suppkey ELSE l_suppkey::VARCHAR END AS version,
         array_to_string(list_filter([CASE WHEN l_quantity > 3 THEN NULL ELSE 'hil_approved' END,
           CASE WHEN l_tax < 0.08 THEN NULL ELSE 'tests_passed' END,
           CASE WHEN l_extendedprice > 2000 THEN NULL ELSE 'rollback_plan_exists' END], lambda x: x IS NOT NULL), ',') AS failed,
         l_shipdate AS created_at, l_linenumber, l_extendedprice
  FROM lineitem JOIN versions v ON v.version = l_suppkey::VARCHAR),
firsts AS (
  SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY created_at, l_linenumber, l_extendedprice) = 1)"""

PRODUCTION_SQL = """
production AS (
  SELECT model_name, arg_min(version, (p, -s)) AS production_version FROM (
    SELECT model_name, version, 1 AS p, version::INT AS s FROM aliases WHERE alias = 'Production'
    UNION ALL SELECT model_name, version, 2, s_suppkey FROM versions WHERE stage = 'Production') GROUP BY model_name),
fallback AS (
  SELECT v.model_name, arg_max(v.version, (v.updated_at, v.s_suppkey, (v.stage = 'Archived')::INT)) AS fallback_version
  FROM versions v LEFT JOIN production p ON p.model_name = v.model_name AND p.production_version = v.version
  WHERE v.stage <> 'Production' AND p.model_name IS NULL GROUP BY v.model_name)"""

REGISTRY_SQL = f"WITH {VERSIONS_SQL}, {ALIASES_SQL}, {PRODUCTION_SQL}"
GATE_SQL = f"""{REGISTRY_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, {RUNS_SQL}, {ARTIFACTS_SQL}, {REQUESTS_SQL},
metrics AS (SELECT model_name, version, auc, recall, f1 FROM versions JOIN runs USING (run_id)),
alone AS (
  SELECT f.*, m.auc, m.f1, m.recall,
    CASE WHEN f.failed <> '' THEN 'promotion checklist failed'
      WHEN v.version IS NULL THEN 'model version not found'
      WHEN a.missing <> '' THEN 'missing artifacts'
      WHEN m.recall IS NULL THEN 'promotion metrics unavailable'
      WHEN m.recall < 0.75 THEN 'candidate recall is below the required operating floor' END AS error
  FROM firsts f LEFT JOIN versions v ON v.model_name = f.model_name AND v.version = f.version
  LEFT JOIN missing a ON a.model_name = f.model_name AND a.version = f.version
  LEFT JOIN metrics m ON m.model_name = f.model_name AND m.version = f.version),
eligible AS (
  SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY created_at, l_linenumber, l_extendedprice, request_id) AS n FROM alone WHERE error IS NULL),
turns AS (
  SELECT DISTINCT e.model_name, 0::BIGINT AS n, NULL::VARCHAR AS request_id, NULL::VARCHAR AS base, false AS worse,
         p.production_version AS live, q.auc, q.f1, q.recall
  FROM eligible e LEFT JOIN production p ON p.model_name = e.model_name
  LEFT JOIN metrics q ON q.model_name = p.model_name AND q.version = p.production_version
  UNION ALL
  SELECT model_name, n, request_id, base, worse, CASE WHEN worse THEN base ELSE version END, CASE WHEN worse THEN pa ELSE auc END,
         CASE WHEN worse THEN pf ELSE f1 END, CASE WHEN worse THEN pr ELSE recall END
  FROM (SELECT e.model_name, e.n, e.request_id, e.version, e.auc, e.f1, e.recall, t.live AS base, t.auc AS pa, t.f1 AS pf, t.recall AS pr,
               coalesce(t.live IS NOT NULL AND (e.auc < t.auc - 0.02::DOUBLE OR e.f1 < t.f1 - 0.02::DOUBLE OR e.recall < t.recall), false) AS worse
        FROM turns t JOIN eligible e ON e.model_name = t.model_name AND e.n = t.n + 1)),
judged AS (
  SELECT a.request_id, a.model_name, a.version, a.created_at, a.failed, t.base AS production_version, t.n AS position,
    CASE WHEN a.error IS NOT NULL THEN a.error WHEN t.worse THEN 'candidate metrics regress against current Production' END AS error_message
  FROM alone a LEFT JOIN turns t ON t.request_id = a.request_id)"""


def production(t: Tables) -> DataFrame:
    return registry.current_production(versions(t), aliases(t))


@query("registry_current", f"{REGISTRY_SQL} SELECT model_name, production_version, 'registry' AS source FROM production")
def registry_current(t: Tables) -> DataFrame:
    return production(t)


@query(
    "registry_current_with_mirror",
    f"""{REGISTRY_SQL}, mirror AS (
  SELECT c_mktsegment AS model_name, c_custkey::VARCHAR AS version, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0)
SELECT model_name, production_version, 'registry' AS source FROM production
UNION ALL SELECT model_name, arg_max(version, (floor(c_acctbal), c_custkey)), 'mirror' FROM mirror GROUP BY model_name""",
)
def registry_with_mirror(t: Tables) -> DataFrame:
    """Models the registry does not know come from the mirror table."""
    mirror = t.customer.select(
        F.col("c_mktsegment").alias("model_name"), F.col("c_custkey").cast("string").alias("version"),
        (F.col("c_acctbal") > 0).alias("is_production"), F.timestamp_seconds(F.floor("c_acctbal")).alias("promoted_at"),
    )
    return registry.current_production(versions(t), aliases(t), mirror)


@query("registry_fallback", f"{REGISTRY_SQL} SELECT model_name, fallback_version FROM fallback")
def registry_fallback(t: Tables) -> DataFrame:
    return registry.fallback_version(versions(t), production(t))


@query(
    "registry_default_candidate",
    f"""{REGISTRY_SQL} SELECT coalesce(a.model_name, f.model_name) AS model_name, coalesce(a.version, f.fallback_version) AS candidate_version
FROM (SELECT * FROM aliases WHERE alias = 'Default') a FULL OUTER JOIN fallback f ON f.model_name = a.model_name""",
)
def registry_default(t: Tables) -> DataFrame:
    return registry.default_candidate(versions(t), aliases(t), production(t))


@query(
    "serving_version",
    f"""{REGISTRY_SQL} SELECT n_name AS model_name, coalesce(p.production_version, f.fallback_version, 'v1') AS serving_version,
CASE WHEN p.production_version IS NOT NULL THEN 'production' WHEN f.fallback_version IS NOT NULL THEN 'fallback' ELSE 'local' END AS origin
FROM nation LEFT JOIN production p ON p.model_name = n_name LEFT JOIN fallback f ON f.model_name = n_name""",
)
def serving(t: Tables) -> DataFrame:
    models = t.nation.select(F.col("n_name").alias("model_name"))
    return registry.serving_version(models, versions(t), production(t))


@query(
    "version_lookup",
    f"""WITH {VERSIONS_SQL}, {REQUESTS_SQL}, w AS (SELECT DISTINCT model_name, version FROM requests)
SELECT w.model_name, w.version, v.version IS NOT NULL AS "exists", 'models:/' || w.model_name || '/' || w.version AS model_uri
FROM w LEFT JOIN versions v ON v.model_name = w.model_name AND v.version = w.version""",
)
def version_lookup(t: Tables) -> DataFrame:
    wanted = requests(t).select("model_name", "version").distinct()
    return registry.existing_versions(wanted, versions(t)).select("model_name", "version", "exists", "model_uri")


@query("required_artifacts", f"WITH {VERSIONS_SQL}, {ARTIFACTS_SQL} SELECT model_name, version, missing FROM missing")
def required_artifacts(t: Tables) -> DataFrame:
    rows = registry.missing_artifacts(versions(t), artifacts(t))
    return rows.select("model_name", "version", F.array_join("missing", ",").alias("missing"))


@query(
    "version_metadata",
    f"""WITH {VERSIONS_SQL}, {RUNS_SQL} SELECT model_name, version, auc AS test_auc, f1 AS test_f1, recall AS test_recall, s_name AS owner
FROM versions LEFT JOIN runs USING (run_id)""",
)
def metadata(t: Tables) -> DataFrame:
    """Metrics found by name in run metrics and tags; a version tag wins over a run tag."""
    merged = registry.version_metadata(versions(t), runs(t))
    owners = merged.select("model_name", "version", F.try_element_at("tags", F.lit("owner")).alias("owner"))
    return registry.metric_columns(merged).join(owners, ["model_name", "version"])


def gate_round(t: Tables) -> dict[str, DataFrame]:
    return promote(requests(t), versions(t), aliases(t), runs(t), artifacts(t), order=REQUEST_ORDER)


@query(
    "promotion_gate",
    f"""{GATE_SQL} SELECT request_id, model_name, version, CASE WHEN error_message IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
error_message, failed AS failed_items FROM judged""",
)
def promotion_gate(t: Tables) -> DataFrame:
    judged = gate_round(t)["judged"]
    return judged.select("request_id", "model_name", "version", "status", "error_message", F.array_join("failed_items", ",").alias("failed_items"))


@query(
    "promotion_lifecycle",
    f"""{GATE_SQL}, ok AS (SELECT * FROM judged WHERE error_message IS NULL),
life AS (
  SELECT model_name, version, 'production' AS s, created_at, position FROM ok
  UNION ALL SELECT model_name, production_version, 'archived', created_at, position FROM ok WHERE production_version <> version)
SELECT model_name, version, arg_max(s, (created_at, position, s = 'production')) AS lifecycle_status, strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS since
FROM life GROUP BY model_name, version""",
)
def promotion_lifecycle(t: Tables) -> DataFrame:
    """State of every version after the round's promotions are appended."""
    state = registry.lifecycle_state(gate_round(t)["lifecycle"])
    return state.withColumn("since", stamp("since"))


@query(
    "promotion_mirror",
    f"""{GATE_SQL} SELECT j.model_name, j.version, 'models:/' || j.model_name || '/' || j.version AS model_uri, count(*) AS promotions,
any_value(m.auc) AS test_auc, any_value(m.f1) AS test_f1, any_value(m.recall) AS test_recall
FROM judged j JOIN metrics m ON m.model_name = j.model_name AND m.version = j.version WHERE error_message IS NULL GROUP BY ALL""",
)
def promotion_mirror(t: Tables) -> DataFrame:
    rows = gate_round(t)["mirror"]
    return rows.groupBy("model_name", "version", "model_uri").agg(
        F.count(F.lit(1)).alias("promotions"), *[F.first(m).alias(m) for m in ("test_auc", "test_f1", "test_recall")]
    )


@query(
    "audit_dedupe",
    f"""{GATE_SQL} SELECT r.request_id, count(*) AS sent, any_value(CASE WHEN j.error_message IS NULL THEN 'accepted' ELSE 'rejected' END) AS status,
any_value(CASE WHEN j.error_message IS NULL THEN j.version END) AS production_version_after
FROM requests r JOIN judged j USING (request_id) GROUP BY r.request_id""",
)
def audit_dedupe(t: Tables) -> DataFrame:
    """Repeated requests get the stored answer of the first one."""
    answers = registry.responses(requests(t).select("request_id"), gate_round(t)["audit"])
    return answers.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("sent"),
        F.max("status").alias("status"),
        F.max("production_version_after").alias("production_version_after"),
    )


@query(
    "audit_replay",
    f"""WITH {VERSIONS_SQL}, {REQUESTS_SQL} SELECT count(*) AS new_requests FROM firsts
WHERE request_id NOT IN (SELECT request_id FROM requests WHERE created_at < TIMESTAMP '1998-01-01')""",
)
def audit_replay(t: Tables) -> DataFrame:
    """Requests still to be judged when everything sent before 1998 is in the audit log."""
    rows = requests(t)
    audit = rows.where(F.col("created_at") < F.lit("1998-01-01").cast("timestamp"))
    return registry.first_requests(rows, audit, REQUEST_ORDER).agg(F.count(F.lit(1)).alias("new_requests"))


@query(
    "registry_history",
    f"""{GATE_SQL} SELECT CASE WHEN length(request_id) <= 8 THEN request_id ELSE substr(request_id, 1, 8) || '...' END AS request_id,
CASE WHEN error_message IS NULL THEN 'accepted' ELSE 'rejected' END AS status, model_name AS model, version,
coalesce(CASE WHEN length(error_message) <= 20 THEN error_message ELSE substr(error_message, 1, 20) || '...' END, '—') AS error,
strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created FROM (SELECT * FROM judged ORDER BY judged.created_at DESC, judged.request_id DESC LIMIT 50)""",
)
def registry_history(t: Tables) -> DataFrame:
    """The newest fifty audit entries as displayed."""
    rows = registry.newest(gate_round(t)["judged"], 50, "created_at", "request_id")
    return rows.select(
        truncated(F.col("request_id"), 8).alias("request_id"), "status", F.col("model_name").alias("model"), "version",
        truncated(F.col("error_message"), 20).alias("error"), stamp("created_at").alias("created"),
    )


@query(
    "mark_candidates",
    f"""{REGISTRY_SQL}, newest AS (SELECT model_name, arg_max(version, (updated_at, s_suppkey)) AS version FROM versions GROUP BY model_name)
SELECT model_name, 'Default' AS alias, version FROM newest
UNION ALL SELECT model_name, 'Production', version FROM newest WHERE model_name NOT IN (SELECT model_name FROM production)""",
)
def candidate_marks(t: Tables) -> DataFrame:
    fresh = versions(t).withColumnRenamed("updated_at", "created_at")
    rows, _ = registry.mark_candidates(fresh, production(t))
    return rows


@query(
    "newest_non_production",
    f"WITH {VERSIONS_SQL} SELECT model_name, version FROM versions WHERE stage <> 'Production' ORDER BY updated_at DESC, version LIMIT 1",
)
def newest_candidate(t: Tables) -> DataFrame:
    mirror = versions(t).select("model_name", "version", (F.col("stage") == "Production").alias("is_production"), F.col("updated_at").alias("created_at"))
    return registry.newest_non_production(mirror).select("model_name", "version")


@query(
    "version_numbers",
    """SELECT p_brand, TRY_CAST(regexp_replace(replace(p_brand, 'Brand#', 'v'), '^[vV]+', '') AS INT) AS version, 0 AS bad, count(*) AS n FROM part GROUP BY ALL""",
)
def version_numbers(t: Tables) -> DataFrame:
    """Version labels to numbers; 0 when there is none."""
    label = F.replace("p_brand", F.lit("Brand#"), F.lit("v"))
    return t.part.groupBy("p_brand", version_number(label).alias("version"), version_number(F.col("p_brand")).alias("bad")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- the given tables as event and job logs ----------------------------------


def state_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("key"), F.col("props").alias("payload"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )


@query("latest_state", "SELECT user_id AS id, event_type AS key, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY 1, 2")
def latest_state(t: Tables) -> DataFrame:
    return eventlog.latest_state(state_log(t), order=("ts", "event_id"))


@query(
    "merged_state",
    """WITH l AS (SELECT user_id AS id, event_type AS key, arg_max(props, (ts, event_id)) AS payload FROM events GROUP BY 1, 2)
SELECT id, max(payload) FILTER (key = 'click') AS click, max(payload) FILTER (key = 'error') AS error, count(*) FILTER (key IN ('click', 'error'))::INT AS keys
FROM l GROUP BY id HAVING count(*) FILTER (key IN ('click', 'error')) > 0""",
)
def merged_state(t: Tables) -> DataFrame:
    """One state document per key, later writes replacing earlier ones."""
    state = eventlog.merged_state(state_log(t), ["click", "error"], order=("ts", "event_id"))
    s = F.col("state")
    return state.select("id", *[F.try_element_at(s, F.lit(k)).alias(k) for k in ("click", "error")], F.size(s).alias("keys"))


NODES = {"click": "triage", "view": "action", "error": "awaiting_hil", "purchase": "done", "signup": "comms"}


def investigations(t: Tables) -> DataFrame:
    """One investigation per user: node of the newest event, drift event from the user's totals."""
    log = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    newest = F.struct("ts", "event_id")
    rows = log.groupBy("user_id").agg(
        F.max_by("event_type", newest).alias("kind"),
        F.max_by(F.get_json_object("props", "$.k").cast("int"), newest).alias("k"),
        F.count(F.lit(1)).alias("n"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )
    node = F.create_map(*[F.lit(x) for pair in NODES.items() for x in pair])[F.col("kind")]
    colour = F.when(F.col("k") >= 66, "red").when(F.col("k") >= 33, "yellow").otherwise("green")
    action = (
        F.when(F.col("k") < 20, "replay").when(F.col("k") < 40, "retrain").when(F.col("k") < 60, "rollback").when(F.col("k") < 80, "no_action")
    )
    return rows.select(
        F.col("user_id").cast("string").alias("id"),
        node.alias("current_node"),
        F.struct(
            F.lit("credit").alias("model_name"), F.col("k").alias("model_version"), F.lit("green").alias("previous_severity"),
            colour.alias("current_severity"), F.col("n").alias("window_size"),
        ).alias("drift_event"),
        F.when(F.col("k") < 10, action).alias("recommended_action"),
        action.alias("triage_action"),
        F.lit(None).cast("string").alias("comms_summary"),
        "created_at",
        "updated_at",
    )


INVESTIGATIONS_SQL = """
inv AS (
  SELECT user_id::VARCHAR AS id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(json_extract_string(props, '$.k')::INT, (ts, event_id)) AS k,
         count(*) AS n, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id),
investigations AS (
  SELECT *, CASE kind WHEN 'click' THEN 'triage' WHEN 'view' THEN 'action' WHEN 'error' THEN 'awaiting_hil' WHEN 'purchase' THEN 'done' ELSE 'comms' END AS current_node,
    CASE WHEN k >= 66 THEN 'red' WHEN k >= 33 THEN 'yellow' ELSE 'green' END AS colour,
    CASE WHEN k < 20 THEN 'replay' WHEN k < 40 THEN 'retrain' WHEN k < 60 THEN 'rollback' WHEN k < 80 THEN 'no_action' END AS triage_action FROM inv)"""


@query(
    "investigation_summary",
    f"""WITH {INVESTIGATIONS_SQL} SELECT id AS investigation_id, current_node,
'credit v' || k || ': green -> ' || colour || ' (' || n || ' predictions)' AS drift_event_summary,
CASE WHEN k < 10 THEN triage_action END AS recommended_action, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM investigations""",
)
def investigation_summary(t: Tables) -> DataFrame:
    rows = eventlog.summaries(investigations(t))
    return rows.drop("comms_summary").withColumns({c: stamp(c) for c in ("created_at", "updated_at")})


@query(
    "investigation_state_by_id",
    f"""WITH {INVESTIGATIONS_SQL} SELECT id, current_node, triage_action FROM investigations
WHERE id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def states_by_id(t: Tables) -> DataFrame:
    """States of the investigations whose ids are asked for (machinery customers)."""
    asked = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").cast("string").alias("id"))
    return eventlog.states_by_id(investigations(t), asked).select("id", "current_node", "triage_action")


@query(
    "investigation_counts",
    f"WITH {INVESTIGATIONS_SQL} SELECT count(*) AS total, count(*) FILTER (current_node = 'awaiting_hil') AS awaiting_hil, count(*) FILTER (current_node = 'done') AS done FROM investigations",
)
def investigation_counts(t: Tables) -> DataFrame:
    return eventlog.node_counts(investigations(t))


@query(
    "review_inbox",
    f"""WITH {INVESTIGATIONS_SQL} SELECT id, upper(coalesce(CASE WHEN k < 10 THEN triage_action END, triage_action, 'unknown')) AS action FROM investigations WHERE current_node = 'awaiting_hil'""",
)
def review_inbox(t: Tables) -> DataFrame:
    return eventlog.review_inbox(investigations(t), ("recommended_action", "triage_action")).select("id", "action")


@query(
    "next_step",
    f"""WITH {INVESTIGATIONS_SQL} SELECT id, CASE WHEN current_node IN ('done', 'awaiting_hil') THEN 'end' WHEN current_node = 'comms' THEN 'comms'
WHEN triage_action IS NULL THEN 'triage' WHEN triage_action = 'no_action' THEN 'comms' ELSE 'action' END AS next_step,
CASE WHEN k < 50 AND current_node NOT IN ('awaiting_hil', 'done', 'stale') THEN 'awaiting_hil' ELSE current_node END AS shown_node FROM investigations""",
)
def next_step(t: Tables) -> DataFrame:
    pending = F.col("drift_event.model_version") < 50
    return investigations(t).select(
        "id",
        eventlog.next_step(F.col("current_node"), F.col("triage_action")).alias("next_step"),
        eventlog.surfaced_node(F.col("current_node"), pending).alias("shown_node"),
    )


@query(
    "open_investigations",
    """SELECT count(*) AS opened, count(DISTINCT event_id) AS ids, min('triage') AS current_node FROM events WHERE event_type = 'error'""",
)
def opened(t: Tables) -> DataFrame:
    """A fresh investigation per error event."""
    errors = t.events.where(F.col("event_type") == "error").withColumn("event_id", F.col("event_id").cast("string"))
    rows = eventlog.open_investigations(errors, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return rows.agg(F.count(F.lit(1)).alias("opened"), F.count_distinct("id").alias("ids"), F.min("current_node").alias("current_node"))


def job_results(t: Tables) -> DataFrame:
    """Orders as job results: finished orders succeeded, open ones failed, pending ones are undated."""
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.concat_ws(":", F.col("o_custkey"), F.lit("replay"), F.col("o_orderkey")).alias("job_id"),
        F.when(status != "P", F.lit("replay")).alias("function"),
        F.when(F.col("o_orderpriority") != "5-LOW", status == "F").alias("success"),
        F.when(status == "O", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("finish_time"),
        F.substring("o_orderpriority", 1, 1).alias("job_try"),
        F.concat(F.lit("RuntimeError: "), "o_orderpriority").alias("result"),
    )


@query(
    "dlq_list",
    """SELECT o_custkey || ':replay:' || o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'replay' END AS function,
o_custkey::VARCHAR AS investigation_id, 'RuntimeError: ' || o_orderpriority AS last_error,
CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.000000' END AS failed_at, substr(o_orderpriority, 1, 1)::INT AS attempts
FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F'""",
)
def dlq_list(t: Tables) -> DataFrame:
    return eventlog.dead_letters(job_results(t)).withColumn("failed_at", stamp("failed_at"))


@query(
    "job_dedupe_24h",
    """WITH RECURSIVE jobs AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
kept AS (
  SELECT user_id, min(ts) AS ts FROM jobs GROUP BY user_id
  UNION ALL
  SELECT k.user_id, (SELECT min(j.ts) FROM jobs j WHERE j.user_id = k.user_id AND j.ts > k.ts + INTERVAL 24 HOUR) AS ts
  FROM kept k WHERE k.ts IS NOT NULL)
SELECT user_id::VARCHAR AS user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM kept JOIN jobs USING (user_id, ts)""",
)
def job_dedupe(t: Tables) -> DataFrame:
    """Jobs accepted when a user's repeats are refused for 24 hours after the last accepted one."""
    kept = eventlog.accept_jobs(t.events, "user_id", "ts", "event_id", 24)
    return kept.withColumn("ts", stamp("ts"))


@query(
    "incremental_events",
    """SELECT event_type, count(*) AS n FROM events
WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND value > 100) GROUP BY 1""",
)
def incremental_events(t: Tables) -> DataFrame:
    """Events newer than the newest one already seen (the log of large sign-ups)."""
    events = t.events.withColumn("emitted_at", F.col("ts").cast("timestamp"))
    seen = events.where((F.col("event_type") == "signup") & (F.col("value") > 100))
    fresh = eventlog.events_since(events, eventlog.cursor(seen, F.col("emitted_at")))
    return fresh.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
