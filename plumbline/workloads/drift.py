"""Reference profile and drift queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import DriftConfig
from plumbline.operators.contract import validate_events
from plumbline.operators.drift import (
    categorical_chi2,
    contract_colour,
    drift_metrics,
    event_payload,
    numeric_psi,
    output_psi,
    overall_severity,
    top_metrics,
    window_facts,
)
from plumbline.functions.text import metrics_block, version_number
from plumbline.operators.profile import bins_table, build_profile, stats_table
from plumbline.plans.drift_check import (
    ALERTS,
    REPORTS,
    alerts_with_reports,
    check_drift,
    check_window,
    newest_rows,
    period_alerts,
    period_reports,
    result_tables,
)
from plumbline.sources.folders import fresh_folder
from plumbline.sources.profiles import load_active, save_profile
from plumbline.sources.tables import append, as_of, newest
from plumbline.workloads.adapters import (
    CATEGORICAL,
    LOG_SQL,
    NUMERIC,
    current_part,
    prediction_log,
    reference_part,
    stamp,
)
from plumbline.workloads.registry import Tables, query

CFG = DriftConfig()
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORICAL = ["l_returnflag", "l_linestatus"]


# --- SQL building blocks -----------------------------------------------------


def long_sql(source: str, columns: list[str], keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {lead}'{c}' AS feature, {c}::DOUBLE AS v FROM {source}" for c in columns)


def edges_sql(rlong: str = "rlong") -> str:
    """Decile edges per feature from (feature, v)."""
    return f"""
packed AS (SELECT feature, list(v ORDER BY v) AS a, count(v) AS n FROM {rlong} WHERE v IS NOT NULL GROUP BY feature),
spots AS (SELECT feature, a, n, i, (n - 1) * (i * 0.1::DOUBLE) AS h FROM packed, (SELECT unnest(range(0, 11)) AS i)),
quant AS (
  SELECT feature, i, a[floor(h)::BIGINT + 1] AS lo, a[least(floor(h)::BIGINT + 2, n)] AS hi, h - floor(h) AS t,
         a[1] AS mn, a[n] AS mx FROM spots),
points AS (SELECT feature, mn, mx, CASE WHEN t < 0.5 THEN lo + (hi - lo) * t ELSE hi - (hi - lo) * (1 - t) END AS e FROM quant),
edges AS (
  SELECT feature, CASE WHEN len(es) < 2 THEN [mn, mx + 1] ELSE es END AS es
  FROM (SELECT feature, mn, mx, list_sort(list_distinct(list(e))) AS es FROM points GROUP BY feature, mn, mx)),
inner_edges AS (SELECT feature, es, es[2:len(es) - 1] AS ie, len(es) - 1 AS n_bins FROM edges),
ref_counts AS (
  SELECT r.feature, len(list_filter(i.ie, lambda x: x <= r.v)) AS bin, count(*) AS n
  FROM {rlong} r JOIN inner_edges i USING (feature) WHERE r.v IS NOT NULL GROUP BY ALL),
grid AS (SELECT feature, n_bins, unnest(range(0, n_bins)) AS bin FROM inner_edges),
ref_shares AS (
  SELECT g.feature, g.n_bins, g.bin, coalesce(c.n, 0)::DOUBLE / sum(coalesce(c.n, 0)) OVER (PARTITION BY g.feature) AS share
  FROM grid g LEFT JOIN ref_counts c ON c.feature = g.feature AND c.bin = g.bin)"""


def psi_sql(clong: str = "clong", key: str = "") -> str:
    """psi([key,] feature, n_bins, psi) from ref_shares / inner_edges and (key, feature, v)."""
    k = f"{key}, " if key else ""
    lead = f"c.{key}, " if key else ""
    on = f"AND c.{key} = p.{key}" if key else ""
    plead = f"p.{key}, " if key else ""
    return f"""
cur_totals AS (SELECT {k}feature, count(v) AS total FROM {clong} GROUP BY ALL),
cur_counts AS (
  SELECT {lead}c.feature, len(list_filter(i.ie, lambda x: x <= c.v)) AS bin, count(*) AS n
  FROM {clong} c JOIN inner_edges i USING (feature) WHERE c.v IS NOT NULL GROUP BY ALL),
cells AS (
  SELECT {plead}p.feature, r.n_bins, p.total, least(greatest(r.share, 1e-6), 1.0) AS rp,
         least(greatest(coalesce(c.n, 0)::DOUBLE / greatest(p.total, 1), 1e-6), 1.0) AS cp
  FROM cur_totals p JOIN ref_shares r ON r.feature = p.feature
  LEFT JOIN cur_counts c ON c.feature = p.feature AND c.bin = r.bin {on}),
psi AS (
  SELECT {k}feature, n_bins, CASE WHEN total = 0 THEN 0.0 ELSE sum((cp - rp) * ln(cp / rp)) END AS psi
  FROM cells GROUP BY {k}feature, n_bins, total)"""


def severity_sql(value: str) -> str:
    return (
        f"CASE WHEN {value} >= 0.3 THEN 'high' WHEN {value} >= 0.2 THEN 'medium' "
        f"WHEN {value} >= 0.1 THEN 'low' ELSE 'none' END"
    )


OUTPUT_SEVERITY_SQL = (
    "CASE WHEN psi >= 0.2 THEN 'medium' WHEN psi >= 0.3 THEN 'high' WHEN psi >= 0.1 THEN 'low' ELSE 'none' END"
)


def output_sql(source: str = "win", key: str = "") -> str:
    """out([key,] psi) from ref.prediction and a source with prediction."""
    k = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
out_ref AS (
  SELECT prediction AS bin, greatest(floor(count(*)::DOUBLE / (SELECT count(*) FROM ref) * 1000), 1) AS w
  FROM ref GROUP BY prediction),
out_shares AS (
  SELECT b.bin, coalesce(r.w, 0) / (SELECT sum(w) FROM out_ref) AS rp
  FROM (SELECT unnest([0, 1]) AS bin) b LEFT JOIN out_ref r USING (bin)),
out_cur AS (
  SELECT {k}count(*) AS n, count(*) FILTER (prediction = 0) AS n0, count(*) FILTER (prediction = 1) AS n1
  FROM {source} {group}),
out_cells AS (
  SELECT {k}least(greatest(rp, 1e-6), 1.0) AS rp,
         least(greatest((CASE WHEN bin = 0 THEN n0 ELSE n1 END)::DOUBLE / greatest(n, 1), 1e-6), 1.0) AS cp
  FROM out_cur, out_shares),
out AS (SELECT {k}sum((cp - rp) * ln(cp / rp)) AS psi FROM out_cells {group})"""


def chi2_sql(ref: str, cur: str, columns: list[str], key: str = "") -> str:
    """chi([key,] feature, n_cells, chi2, pvalue)."""
    k = f"{key}, " if key else ""
    tk = f"t.{key}, " if key else ""
    same = f"AND c.{key} = e.{key}" if key else ""
    using = f"({key}, feature, category)" if key else "(feature, category)"
    return f"""
cat_ref AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce({c}, 'nan') AS category FROM {ref}" for c in columns)}),
cat_cur AS ({" UNION ALL ".join(f"SELECT {k}'{c}' AS feature, coalesce({c}, 'nan') AS category FROM {cur}" for c in columns)}),
cat_shares AS (
  SELECT feature, category, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY feature) AS share
  FROM cat_ref GROUP BY feature, category),
cat_counts AS (SELECT {k}feature, category, count(*)::DOUBLE AS n FROM cat_cur GROUP BY ALL),
cat_totals AS (SELECT {k}feature, sum(n) AS total FROM cat_counts GROUP BY ALL),
cat_expected AS (SELECT {tk}t.feature, s.category, s.share FROM cat_totals t JOIN cat_shares s USING (feature)),
cat_cells AS (
  SELECT {k}feature, category, coalesce(c.n, 0) AS o, coalesce(e.share, 0) AS share
  FROM cat_counts c FULL OUTER JOIN cat_expected e USING {using}),
cat_exp AS (
  SELECT c.*, greatest(c.share * greatest(t.total, 1), 1e-6) AS e0, t.total
  FROM cat_cells c JOIN cat_totals e ON e.feature = c.feature {same} JOIN cat_totals t
    ON t.feature = c.feature {same.replace('e.', 't.')}),
cat_fit AS (
  SELECT {k}feature, o, e0 * total / sum(e0) OVER (PARTITION BY {k}feature) AS e FROM cat_exp),
chi_stat AS (
  SELECT {k}feature, count(*) AS n_cells, sum((o - e) * (o - e) / e) AS chi2 FROM cat_fit GROUP BY ALL),
chi AS (
  SELECT {k}feature, n_cells, chi2,
    CASE WHEN n_cells < 2 THEN NULL WHEN chi2 <= 0 THEN 1.0 WHEN chi2 / 2 > 700 THEN 0.0
      ELSE greatest(0.0, 1.0 - list_sum(list_transform(range(0, 3000), lambda j:
        exp(((n_cells - 1) / 2.0 + j) * ln(chi2 / 2) - chi2 / 2 - lgamma((n_cells - 1) / 2.0 + j + 1))))) END AS pvalue
  FROM chi_stat)"""


WINDOW_SQL = (
    f"WITH {LOG_SQL}, rlong AS ({long_sql('ref', NUMERIC)}), clong AS ({long_sql('win', NUMERIC)}), "
    f"{edges_sql()}, {psi_sql()}, {chi2_sql('ref', 'win', CATEGORICAL)}, {output_sql('win')}"
)
METRICS_SQL = f"""{WINDOW_SQL},
metrics AS (
  SELECT 0 AS src, feature, 'psi' AS metric, psi AS value, NULL AS pvalue, n_bins::INT AS n_bins, 0.2::DOUBLE AS threshold,
         {severity_sql('psi')} AS severity, NULL AS drifted FROM psi
  UNION ALL SELECT 1, feature, 'chi2', chi2, pvalue, n_cells::INT, 0.05::DOUBLE, NULL, coalesce(pvalue < 0.05, false) FROM chi
  UNION ALL SELECT 2, 'prediction', 'output_dist', psi, NULL, 2, 0.2::DOUBLE, {OUTPUT_SEVERITY_SQL}, NULL FROM out)"""
OVERALL_SQL = f"""{METRICS_SQL},
signals AS (
  SELECT max(list_position(['none', 'low', 'medium', 'high'], severity)) AS worst,
         count(*) FILTER (metric = 'psi') AS n_numeric, count(*) FILTER (drifted) AS n_cat FROM metrics),
overall AS (
  SELECT ['none', 'low', 'medium', 'high'][greatest(worst,
           CASE WHEN n_cat >= 4 THEN 4 WHEN n_cat >= 2 THEN 3 WHEN n_cat = 1 THEN 2 ELSE 1 END)] AS severity,
         n_numeric, n_cat FROM signals)"""


# --- Spark -------------------------------------------------------------------


def event_profile(t: Tables):
    return build_profile(reference_part(prediction_log(t.events)), NUMERIC, CATEGORICAL, "prediction")


def event_window(t: Tables) -> DataFrame:
    return newest_rows(prediction_log(t.events), CFG.window_size)


def line_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = t.lineitem
    start = F.lit("1997-01-01").cast("timestamp_ntz")
    current = lines.where(F.col("l_shipdate") >= start).withColumn("yr", F.year("l_shipdate"))
    return lines.where(F.col("l_shipdate") < start), current


@query(
    "reference_profile",
    f"""WITH {LOG_SQL}, rlong AS ({long_sql('ref', NUMERIC)}), {edges_sql()}
SELECT r.feature, r.bin::INT AS bin, round(e.es[r.bin + 1], 6) AS lower, round(e.es[r.bin + 2], 6) AS upper,
       round(r.share, 6) AS ref_share FROM ref_shares r JOIN edges e USING (feature)""",
)
def reference_profile(t: Tables) -> DataFrame:
    log = prediction_log(t.events)
    table = bins_table(t.spark, build_profile(reference_part(log), NUMERIC, []))
    return table.select("feature", "bin", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "ref_share")])


@query(
    "reference_profile_large",
    f"""WITH rlong AS ({long_sql('lineitem', LINE_NUMERIC)}), {edges_sql()}
SELECT r.feature, r.bin::INT AS bin, round(e.es[r.bin + 1], 6) AS lower, round(e.es[r.bin + 2], 6) AS upper,
       round(r.share, 6) AS ref_share FROM ref_shares r JOIN edges e USING (feature)""",
)
def reference_profile_large(t: Tables) -> DataFrame:
    table = bins_table(t.spark, build_profile(t.lineitem, LINE_NUMERIC, []))
    return table.select("feature", "bin", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "ref_share")])


@query(
    "reference_stats",
    f"""WITH {LOG_SQL}, rlong AS ({long_sql('ref', NUMERIC)})
SELECT feature, count(v) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max FROM rlong GROUP BY feature""",
)
def reference_stats(t: Tables) -> DataFrame:
    profile = build_profile(reference_part(prediction_log(t.events)), NUMERIC, [])
    return stats_table(t.spark, profile).select("feature", "n", F.round("mean", 6).alias("mean"), "min", "max")


@query(
    "reference_category_shares",
    """SELECT feature, category, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY feature), 6) AS ref_share
FROM (SELECT 'o_orderstatus' AS feature, o_orderstatus AS category FROM orders
      UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY feature, category""",
)
def reference_category_shares(t: Tables) -> DataFrame:
    profile = build_profile(t.orders, [], ["o_orderstatus", "o_orderpriority"])
    return profile.categories.select("feature", "category", "n", F.round("ref_share", 6).alias("ref_share"))


@query(
    "reference_output_shares",
    f"""WITH {LOG_SQL} SELECT prediction AS label, round(count(*)::DOUBLE / (SELECT count(*) FROM ref), 6) AS ref_share
FROM ref GROUP BY prediction""",
)
def reference_output_shares(t: Tables) -> DataFrame:
    from plumbline.operators.profile import output_shares

    log = reference_part(prediction_log(t.events))
    return output_shares(log, "prediction").select("label", F.round("ref_share", 6).alias("ref_share"))


@query(
    "drift_numeric_psi",
    f"{WINDOW_SQL} SELECT feature, n_bins::INT AS n_bins, round(psi, 6) AS psi, {severity_sql('psi')} AS severity FROM psi",
)
def drift_numeric_psi(t: Tables) -> DataFrame:
    profile = build_profile(reference_part(prediction_log(t.events)), NUMERIC, [])
    rows = numeric_psi(event_window(t), profile, CFG)
    return rows.select("feature", "n_bins", F.round("value", 6).alias("psi"), "severity")


@query(
    "drift_numeric_psi_large",
    f"""WITH lref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
lcur AS (SELECT *, year(l_shipdate)::INT AS yr FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'),
rlong AS ({long_sql('lref', LINE_NUMERIC)}), clong AS ({long_sql('lcur', LINE_NUMERIC, 'yr')}),
{edges_sql()}, {psi_sql('clong', 'yr')}
SELECT yr, feature, n_bins::INT AS n_bins, round(psi, 6) AS psi, {severity_sql('psi')} AS severity FROM psi""",
)
def drift_numeric_psi_large(t: Tables) -> DataFrame:
    reference, current = line_parts(t)
    profile = build_profile(reference, LINE_NUMERIC, [])
    rows = numeric_psi(current, profile, CFG, ("yr",))
    return rows.select("yr", "feature", "n_bins", F.round("value", 6).alias("psi"), "severity")


@query(
    "drift_categorical_chi2",
    f"""{WINDOW_SQL} SELECT feature, n_cells::INT AS n_categories, round(chi2, 5) AS chi2, round(pvalue, 6) AS pvalue,
coalesce(pvalue < 0.05, false) AS drifted FROM chi""",
)
def drift_categorical_chi2(t: Tables) -> DataFrame:
    profile = build_profile(reference_part(prediction_log(t.events)), [], CATEGORICAL)
    return chi2_result(categorical_chi2(event_window(t), profile, CFG))


def chi2_result(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys,
        "feature",
        F.col("n_bins").alias("n_categories"),
        F.round("value", 5).alias("chi2"),
        F.round("pvalue", 6).alias("pvalue"),
        "drifted",
    )


@query(
    "drift_categorical_chi2_large",
    f"""WITH lref AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
lcur AS (SELECT *, year(l_shipdate)::INT AS yr FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'),
{chi2_sql('lref', 'lcur', LINE_CATEGORICAL, 'yr')}
SELECT yr, feature, n_cells::INT AS n_categories, round(chi2, 5) AS chi2, round(pvalue, 6) AS pvalue,
coalesce(pvalue < 0.05, false) AS drifted FROM chi""",
)
def drift_categorical_chi2_large(t: Tables) -> DataFrame:
    reference, current = line_parts(t)
    profile = build_profile(reference, [], LINE_CATEGORICAL)
    return chi2_result(categorical_chi2(current, profile, CFG, ("yr",)), "yr")


@query(
    "drift_categorical_chi2_orders",
    f"""WITH oref AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
ocur AS (SELECT *, o_orderstatus AS st FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
{chi2_sql('oref', 'ocur', ['o_orderpriority'], 'st')}
SELECT st, feature, n_cells::INT AS n_categories, round(chi2, 5) AS chi2, round(pvalue, 6) AS pvalue,
coalesce(pvalue < 0.05, false) AS drifted FROM chi""",
)
def drift_categorical_chi2_orders(t: Tables) -> DataFrame:
    """Order priorities since 1998 against earlier ones, one report per order status."""
    start = F.lit("1998-01-01").cast("timestamp_ntz")
    profile = build_profile(t.orders.where(F.col("o_orderdate") < start), [], ["o_orderpriority"])
    current = t.orders.where(F.col("o_orderdate") >= start).withColumn("st", F.col("o_orderstatus"))
    return chi2_result(categorical_chi2(current, profile, CFG, ("st",)), "st")


@query(
    "drift_output_psi",
    f"WITH {LOG_SQL}, {output_sql('win')} SELECT 'prediction' AS feature, round(psi, 6) AS psi, {OUTPUT_SEVERITY_SQL} AS severity FROM out",
)
def drift_output_psi(t: Tables) -> DataFrame:
    profile = build_profile(reference_part(prediction_log(t.events)), [], [], "prediction")
    rows = output_psi(event_window(t), profile, CFG)
    return rows.select("feature", F.round("value", 6).alias("psi"), "severity")


@query(
    "drift_metrics",
    f"""{METRICS_SQL} SELECT feature, metric, round(value, 5) AS value, round(pvalue, 6) AS pvalue, n_bins, threshold,
severity, drifted FROM metrics""",
)
def drift_all_metrics(t: Tables) -> DataFrame:
    """Every signal of the newest 200 records against the reference."""
    rows = drift_metrics(event_window(t), event_profile(t), CFG)
    return rows.select(
        "feature", "metric", F.round("value", 5).alias("value"), F.round("pvalue", 6).alias("pvalue"),
        "n_bins", "threshold", "severity", "drifted",
    )


@query(
    "drift_overall_report",
    f"""{OVERALL_SQL} SELECT severity, n_numeric, n_cat AS n_categorical_drifted,
(SELECT count(*) FROM win) AS window_size, (SELECT strftime(min(created_at), '%Y-%m-%d %H:%M:%S.%f') FROM win) AS window_start,
(SELECT strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') FROM win) AS window_end,
(SELECT model_version FROM win ORDER BY created_at DESC, id DESC LIMIT 1) AS model_version FROM overall""",
)
def drift_overall_report(t: Tables) -> DataFrame:
    window = event_window(t)
    overall = overall_severity(drift_metrics(window, event_profile(t), CFG))
    whole = overall.select(F.struct("severity", "n_numeric", "n_categorical_drifted")).scalar()
    return window_facts(window).withColumn("o", whole).select(
        "o.*", "window_size", stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "model_version"
    )


@query(
    "drift_top_metrics",
    f"""{METRICS_SQL} SELECT (row_number() OVER (ORDER BY value DESC, src, feature))::INT AS rank, feature, metric,
round(value, 5) AS value, threshold FROM metrics QUALIFY rank <= 5""",
)
def drift_top_metrics(t: Tables) -> DataFrame:
    top = top_metrics(drift_metrics(event_window(t), event_profile(t), CFG))
    return top.select("rank", "feature", "metric", F.round("value", 5).alias("value"), "threshold")


@query(
    "drift_result_table",
    f"""{WINDOW_SQL} SELECT (row_number() OVER (ORDER BY psi DESC, feature))::INT AS line, feature, round(psi, 6) AS psi,
{severity_sql('psi')} AS severity FROM psi""",
)
def drift_result_table(t: Tables) -> DataFrame:
    """Numeric results as displayed, largest first."""
    numeric, _ = result_tables(drift_metrics(event_window(t), event_profile(t), CFG))
    return numeric.select(
        # A few rows: one per numeric feature.
        F.expr("row_number() over (order by psi desc, feature)").alias("line"), "feature", F.round("psi", 6).alias("psi"), "severity"
    )


@query(
    "drift_event_message",
    f"""{OVERALL_SQL} SELECT 'monitored-model' AS model_name,
(SELECT substr(model_version, 2)::INT FROM win ORDER BY created_at DESC, id DESC LIMIT 1) AS model_version,
(SELECT count(*) FROM win) AS window_size, 'green' AS previous_severity,
CASE severity WHEN 'medium' THEN 'yellow' WHEN 'high' THEN 'red' ELSE 'green' END AS current_severity,
(SELECT count(*) FROM (SELECT * FROM metrics ORDER BY value DESC LIMIT 5)) AS n_metrics,
(SELECT string_agg(feature || ':' || metric, ',' ORDER BY value DESC, src, feature)
 FROM (SELECT * FROM metrics ORDER BY value DESC, src, feature LIMIT 5)) AS metrics, true AS event_valid FROM overall""",
)
def drift_event_message(t: Tables) -> DataFrame:
    """The JSON event of the check, read back through the consumer's contract."""
    check = check_window(event_window(t), event_profile(t), CFG, None, as_of("2024-02-01 00:00:00"))
    from plumbline.operators.drift import top_metrics_array

    top = top_metrics_array(top_metrics(check.metrics.drop("report_id"))).scalar()
    message = check.report.withColumn("top_metrics", top).select(
        event_payload(F.lit("e-1"), F.col("created_at"), F.col("previous_severity"), F.col("severity")).alias("payload")
    )
    e = F.col("event")
    return validate_events(message).select(
        "event.model_name", "event.model_version", "event.window_size", "event.previous_severity", "event.current_severity",
        F.size("event.top_metrics").cast("long").alias("n_metrics"),
        F.array_join(F.transform(e["top_metrics"], lambda m: F.concat_ws(":", m["feature"], m["metric"])), ",").alias("metrics"),
        "event_valid",
    )


DAYS_SQL = "SELECT *, strftime(created_at, '%Y-%m-%d') AS day FROM cur"
PERIOD_SQL = f"""WITH {LOG_SQL},
days AS ({DAYS_SQL}),
facts AS (SELECT day, count(*) AS window_size, max_by(model_version, (created_at, id)) AS model_version FROM days GROUP BY day HAVING count(*) >= 50),
rlong AS ({long_sql('ref', NUMERIC)}), clong AS ({long_sql('days', NUMERIC, 'day')}),
{edges_sql()}, {psi_sql('clong', 'day')}, {chi2_sql('ref', 'days', CATEGORICAL, 'day')}, {output_sql('days', 'day')},
metrics AS (
  SELECT day, 0 AS src, feature, 'psi' AS metric, psi AS value, {severity_sql('psi')} AS severity, NULL AS drifted FROM psi
  UNION ALL SELECT day, 1, feature, 'chi2', chi2, NULL, coalesce(pvalue < 0.05, false) FROM chi
  UNION ALL SELECT day, 2, 'prediction', 'output_dist', psi, {OUTPUT_SEVERITY_SQL}, NULL FROM out),
signals AS (
  SELECT day, max(list_position(['none', 'low', 'medium', 'high'], severity)) AS worst, count(*) FILTER (drifted) AS n_cat
  FROM metrics GROUP BY day),
overall AS (
  SELECT day, ['none', 'low', 'medium', 'high'][greatest(worst,
    CASE WHEN n_cat >= 4 THEN 4 WHEN n_cat >= 2 THEN 3 WHEN n_cat = 1 THEN 2 ELSE 1 END)] AS severity FROM signals),
reports AS (
  SELECT f.day, f.window_size, f.model_version, o.severity, lag(o.severity) OVER (ORDER BY f.day) AS previous_severity
  FROM facts f JOIN overall o USING (day)),
alerts AS (
  SELECT * FROM reports WHERE severity IN ('medium', 'high', 'critical') AND severity IS DISTINCT FROM previous_severity)"""


def daily(t: Tables) -> tuple[DataFrame, DataFrame]:
    log = current_part(prediction_log(t.events)).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return period_reports(log, event_profile(t), CFG, "day")


# The current part in periods of three days, named by their first day: the first is as it was, then values double (twice), then they
# move a little and half of the events change their type, then all is as before.
SHIFTED_SQL = """
  SELECT * EXCLUDE (value, event_type, prediction, p), value, event_type, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS prediction,
         '2024-01-' || lpad((3 * p)::VARCHAR, 2, '0') AS day
  FROM (SELECT * EXCLUDE (value, event_type), CASE WHEN p IN (6, 7) THEN value * 2 + 20 WHEN p = 8 THEN value + 12 ELSE value END AS value,
               CASE WHEN p = 8 AND id % 2 = 0 THEN 'click' ELSE event_type END AS event_type
        FROM (SELECT *, day(created_at) // 3 AS p FROM cur))"""
SHIFTED_PERIOD_SQL = PERIOD_SQL.replace(DAYS_SQL, SHIFTED_SQL)


def shifted(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Reports and metrics of the shifted periods."""
    log = current_part(prediction_log(t.events)).withColumn("p", F.floor(F.dayofmonth("created_at") / 3))
    p, value = F.col("p"), F.col("value")
    log = log.withColumns(
        {
            "value": F.when(p.isin(6, 7), value * 2 + 20).when(p == 8, value + 12).otherwise(value),
            "event_type": F.when((p == 8) & (F.col("id") % 2 == 0), "click").otherwise(F.col("event_type")),
            "day": F.concat(F.lit("2024-01-"), F.lpad((3 * p).cast("string"), 2, "0")),
        }
    )
    log = log.withColumn("prediction", (value >= 50).cast("int")).drop("p")
    return period_reports(log, event_profile(t), CFG, "day")


@query(
    "drift_alert_transitions",
    f"""{PERIOD_SQL} SELECT day, window_size, severity, previous_severity,
severity IN ('medium', 'high', 'critical') AND severity IS DISTINCT FROM previous_severity AS alert,
CASE severity WHEN 'medium' THEN 'yellow' WHEN 'high' THEN 'red' ELSE 'green' END AS colour,
substr(model_version, 2)::INT AS version FROM reports""",
)
def drift_alert_transitions(t: Tables) -> DataFrame:
    """Daily severity history and which days raise an alert."""
    return alert_transitions_of(*daily(t))


def alert_transitions_of(reports: DataFrame, _: DataFrame) -> DataFrame:
    from plumbline.operators.drift import raises_alert

    return reports.select(
        "day", "window_size", "severity", "previous_severity",
        raises_alert(F.col("severity"), F.col("previous_severity")).alias("alert"),
        contract_colour(F.col("severity")).alias("colour"),
        version_number(F.col("model_version")).alias("version"),
    )


@query(
    "drift_alert_messages",
    f"""{PERIOD_SQL},
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY day ORDER BY value DESC, src, feature) AS r FROM metrics m JOIN alerts a USING (day))
SELECT a.day, a.severity, string_agg('  - ' || feature || ' (' || metric || '): ' || printf('%.4f', value) || ' (threshold ' ||
  CASE metric WHEN 'chi2' THEN '0.0500' ELSE '0.2000' END || ')', chr(10) ORDER BY r) AS metrics_block
FROM alerts a JOIN ranked r USING (day) WHERE r.r <= 5 GROUP BY a.day, a.severity""",
)
def drift_alert_messages(t: Tables) -> DataFrame:
    """Alert days with their five largest signals as message text."""
    return alert_messages_of(*daily(t))


def alert_messages_of(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    alerts = period_alerts(reports, metrics, "day")
    return alerts.select("day", "severity", metrics_block(F.col("top_metrics")).alias("metrics_block"))


@query(
    "alerts_with_reports",
    f"""{PERIOD_SQL} SELECT a.day AS report_id, a.severity, r.window_size, r.previous_severity, r.model_version
FROM alerts a JOIN reports r USING (day)""",
)
def alert_report_join(t: Tables) -> DataFrame:
    return alert_report_join_of(*daily(t))


def alert_report_join_of(reports: DataFrame, metrics: DataFrame) -> DataFrame:
    rows = reports.withColumn("report_id", F.col("day")).withColumn("model_name", F.lit(CFG.model_name))
    alerts = period_alerts(reports, metrics, "day").select(F.col("day").alias("report_id"), "severity")
    return alerts_with_reports(alerts, rows).select("report_id", "severity", "window_size", "previous_severity", "model_version")


@query(
    "drift_alert_transitions_shifted",
    f"""{SHIFTED_PERIOD_SQL} SELECT day, window_size, severity, previous_severity,
severity IN ('medium', 'high', 'critical') AND severity IS DISTINCT FROM previous_severity AS alert,
CASE severity WHEN 'medium' THEN 'yellow' WHEN 'high' THEN 'red' ELSE 'green' END AS colour,
substr(model_version, 2)::INT AS version FROM reports""",
)
def drift_alert_transitions_shifted(t: Tables) -> DataFrame:
    return alert_transitions_of(*shifted(t))


@query(
    "drift_alert_messages_shifted",
    f"""{SHIFTED_PERIOD_SQL},
ranked AS (SELECT m.*, row_number() OVER (PARTITION BY day ORDER BY value DESC, src, feature) AS r FROM metrics m JOIN alerts a USING (day))
SELECT a.day, a.severity, string_agg('  - ' || feature || ' (' || metric || '): ' || printf('%.4f', value) || ' (threshold ' ||
  CASE metric WHEN 'chi2' THEN '0.0500' ELSE '0.2000' END || ')', chr(10) ORDER BY r) AS metrics_block
FROM alerts a JOIN ranked r USING (day) WHERE r.r <= 5 GROUP BY a.day, a.severity""",
)
def drift_alert_messages_shifted(t: Tables) -> DataFrame:
    return alert_messages_of(*shifted(t))


@query(
    "alerts_with_reports_shifted",
    f"""{SHIFTED_PERIOD_SQL} SELECT a.day AS report_id, a.severity, r.window_size, r.previous_severity, r.model_version
FROM alerts a JOIN reports r USING (day)""",
)
def alert_report_join_shifted(t: Tables) -> DataFrame:
    return alert_report_join_of(*shifted(t))


@query(
    "recent_reports",
    f"{PERIOD_SQL} SELECT day, window_size, severity, previous_severity FROM reports ORDER BY day DESC LIMIT 10",
)
def recent_daily_reports(t: Tables) -> DataFrame:
    """The ten newest daily reports."""
    reports, _ = daily(t)
    return newest(reports, 10, "day", "day").select("day", "window_size", "severity", "previous_severity")


# Checks one after another over the stored log, each with what happened to the newest records before it: too few of them for a check, as
# they are, far off, just as far off, off in their types only, a little lower (twice), and as they are again.
CHECKS = [
    ("2024-02-01", 40, "value", "event_type"),
    ("2024-02-02", 200, "value", "event_type"),
    ("2024-02-03", 200, "value * 2 + 20", "event_type"),
    ("2024-02-04", 200, "value * 2 + 20", "event_type"),
    ("2024-02-05", 200, "value", "CASE WHEN id % 3 > 0 THEN 'click' ELSE event_type END"),
    ("2024-02-06", 200, "value - 9", "event_type"),
    ("2024-02-07", 200, "value - 10", "event_type"),
    ("2024-02-08", 200, "value", "event_type"),
]


def _check_sql(day: str, size: int, value: str, kind: str) -> str:
    window = f"""win AS (SELECT * EXCLUDE (value, event_type, prediction), {value} AS value, {kind} AS event_type,
  CASE WHEN {value} >= 50 THEN 1 ELSE 0 END AS prediction FROM (SELECT * FROM log ORDER BY created_at DESC, id DESC LIMIT {size}))"""
    plain = "win AS (SELECT * FROM log ORDER BY created_at DESC, id DESC LIMIT 200)"
    return f"""SELECT * FROM ({OVERALL_SQL.replace(plain, window)}
SELECT '{day}' AS day, severity, (SELECT count(*) FROM win) AS window_size FROM overall)"""


@query(
    "stored_drift_checks",
    f"""WITH checks AS ({' UNION ALL '.join(_check_sql(*c) for c in CHECKS)}),
reports AS (SELECT *, lag(severity) OVER (ORDER BY day) AS previous_severity FROM checks WHERE window_size >= 50)
SELECT day, window_size, severity, previous_severity, CASE WHEN severity IN ('medium', 'high', 'critical') AND severity IS DISTINCT FROM previous_severity
  THEN CASE severity WHEN 'medium' THEN 'yellow' ELSE 'red' END END AS alert FROM reports""",
)
def stored_drift_checks(t: Tables) -> DataFrame:
    """Checks against the stored profile, with the stored log, the stored report before, and alerts as they were stored."""
    root = fresh_folder(t.spark)
    profile = build_profile(reference_part(prediction_log(t.events)), NUMERIC, CATEGORICAL, "prediction")
    save_profile(t.spark, f"{root}/profiles", profile, CFG.model_name, "v1", "events", dt.datetime(2024, 1, 16))
    append(prediction_log(t.events), f"{root}/log", day_of="created_at")
    stored = load_active(t.spark, f"{root}/profiles", CFG.model_name)
    for day, size, value, kind in CHECKS:
        log = t.spark.read.parquet(f"{root}/log")
        log = log.withColumns({"value": F.expr(value), "event_type": F.expr(kind)}).withColumn("prediction", (F.col("value") >= 50).cast("int"))
        check_drift(t.spark, log, stored, f"{root}/checks", DriftConfig(window_size=size), as_of(f"{day} 00:00:00"))
    reports, alerts = (t.spark.read.parquet(f"{root}/checks/{name}") for name in (REPORTS, ALERTS))
    colour = F.get_json_object("payload", "$.current_severity").alias("alert")
    joined = reports.join(alerts.select("report_id", colour), "report_id", "left")
    return joined.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "window_size", "severity", "previous_severity", "alert")
