"""Validation, column rules, quality metrics, alert states."""

from pyspark.sql import functions as F

from quotemill.operators import quality as Q
from quotemill.operators.ordered import Series
from quotemill.operators.rolling import newest_per_key
from quotemill.plans.market import TICK_SERIES, TICKS
from quotemill.plans.registry import R, query, rounded

def checks():
    return [
        Q.required("price"),
        Q.typed("symbol", "double"),
        *Q.limits("price", 5, 150, 10, 100),
        Q.outlier("volume", 50, 15),
        Q.one_of("exchange", ["v0", "v1", "v2"]),
        Q.pattern("symbol", "^[a-z]+$"),
    ]


@query("validation_issues", f"""WITH {TICKS} SELECT tie, 'symbol' AS field, 'type' AS issue, 'error' AS severity FROM ticks
UNION ALL SELECT tie, 'price', 'range', 'error' FROM ticks WHERE price < 5 OR price > 150
UNION ALL SELECT tie, 'price', 'range', 'warning' FROM ticks WHERE price BETWEEN 5 AND 150 AND (price < 10 OR price > 100)
UNION ALL SELECT tie, 'volume', 'outlier', 'warning' FROM ticks WHERE abs(volume - 50) / 15 > 3
UNION ALL SELECT tie, 'exchange', 'enum', 'error' FROM ticks WHERE exchange = 'v3'""")
def _issues(t):
    return Q.issue_rows(Q.validate(t.ticks, checks()), ["tie"]).select("tie", "field", "issue", "severity")


@query("validation_split", f"""WITH {TICKS} SELECT CASE WHEN price BETWEEN 10 AND 100 AND volume > 0 THEN 'valid' ELSE 'invalid' END AS part, count(*) AS n FROM ticks GROUP BY 1""")
def _split(t):
    good, bad = Q.split(Q.validate(t.ticks, [Q.in_range("price", 10, 100), Q.in_range("volume", 1, None)]))
    return good.select(F.lit("valid").alias("part")).unionByName(bad.select(F.lit("invalid").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("statistical_outliers", f"WITH {TICKS}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS sd FROM ticks) SELECT tie, price FROM ticks, s WHERE abs(price - m) / sd > 2")
def _outliers(t):
    s = t.ticks.agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("sd")).first()
    v = Q.validate(t.ticks, [Q.outlier("price", s["m"], s["sd"], 2.0)])
    return v.filter(F.size("issues") > 0).select("tie", "price")


@query("json_schema_validation", """SELECT event_id, NOT (value < 10 OR event_type NOT IN ('click', 'view', 'purchase')) AS valid FROM events""")
def _schema(t):
    schema = {"required": ["event_id", "value"], "properties": {"value": {"type": "number", "minimum": 10}, "event_id": {"type": "integer"},
                                                                 "event_type": {"type": "string", "enum": ["click", "view", "purchase"]}}}
    return Q.validate(t.events, Q.schema_checks(schema)).select("event_id", "valid")


# Every tenth event keeps its text; the others carry one fault each, or a nested object.
PAYLOADS = ["props", "'{\"k\": \"' || k || '\"}'", "'{\"k\": ' || k", "'{}'", "'{\"k\": null}'", "'{\"k\": ' || k || ', \"user\": {\"id\": \"x\"}}'",
            "'{\"k\": ' || k || ', \"user\": {\"id\": 7, \"tags\": [\"a\", 1]}}'", "'{\"k\": 2' || lpad(k, 2, '0') || '}'",
            "'{\"k\": ' || k || ', \"user\": {\"id\": 7, \"tags\": []}, \"side\": \"hold\"}'", "'[1, 2]'"]
PAYLOAD_SQL = "CASE " + " ".join(f"WHEN event_id % 10 = {i} THEN {p}" for i, p in enumerate(PAYLOADS)) + " END"
PAYLOAD_SCHEMA = {"type": "object", "required": ["k"], "properties": {
    "k": {"type": "integer", "minimum": 0, "maximum": 99}, "side": {"type": "string", "enum": ["buy", "sell"]},
    "user": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}}}


@query("json_text_validation", f"""WITH e AS (SELECT event_id, props, json_extract_string(props, '$.k') AS k FROM events),
p AS (SELECT event_id, {PAYLOAD_SQL} AS payload FROM e), d AS (SELECT *, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload ELSE '{{}}' END AS d, json_valid(payload) AS ok,
  CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END AS obj FROM p),
t AS (SELECT *, json_type(d, '$.k') AS tk, json_type(d, '$.user') AS tu, json_type(d, '$.user.id') AS ti, json_type(d, '$.side') AS ts,
  CASE WHEN json_type(d, '$.user.tags') = 'ARRAY' THEN len(list_filter(CAST(json_extract(d, '$.user.tags') AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) ELSE 0 END AS odd FROM d)
SELECT event_id, array_to_string(list_sort(list_filter([
  CASE WHEN NOT ok THEN 'payload:json' END, CASE WHEN ok AND NOT obj THEN 'payload:type' END, CASE WHEN obj AND NOT json_exists(d, '$.k') THEN 'k:missing' END,
  CASE WHEN json_exists(d, '$.k') AND tk NOT IN ('UBIGINT', 'BIGINT') THEN 'k:type' END,
  CASE WHEN tk IN ('UBIGINT', 'BIGINT') AND NOT CAST(json_extract_string(d, '$.k') AS BIGINT) BETWEEN 0 AND 99 THEN 'k:range' END,
  CASE WHEN ts = 'VARCHAR' AND json_extract_string(d, '$.side') NOT IN ('buy', 'sell') THEN 'side:enum' END,
  CASE WHEN tu = 'OBJECT' AND NOT json_exists(d, '$.user.id') THEN 'user.id:missing' END,
  CASE WHEN ti NOT IN ('UBIGINT', 'BIGINT') THEN 'user.id:type' END, CASE WHEN odd > 0 THEN 'user.tags:items' END], lambda x: x IS NOT NULL)), ',') AS issues FROM t""")
def _json_text(t):
    """Issues of JSON texts, each fault planted on a tenth of the events."""
    texts = t.events.select("event_id", "props", F.get_json_object("props", "$.k").alias("k")).select("event_id", F.expr(PAYLOAD_SQL).alias("payload"))
    found = Q.validate(texts, Q.json_checks(PAYLOAD_SCHEMA))
    names = F.transform("issues", lambda x: F.concat(x["field"], F.lit(":"), x["issue"]))
    return found.select("event_id", F.array_join(F.array_sort(names), ",").alias("issues"))


@query("tick_schema_validation", f"WITH {TICKS} SELECT count(*) FILTER (price >= 0 AND volume >= 0) AS valid, count(*) FILTER (NOT (price >= 0 AND volume >= 0)) AS invalid FROM ticks")
def _tick_schema(t):
    v = Q.validate(t.ticks, Q.schema_checks(Q.TICK_SCHEMA))
    return v.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


@query("column_rules", """SELECT r.rule, r."column", CAST(failures AS BIGINT) AS failures, n AS rows, failures = 0 AS passed FROM (
  SELECT count(*) AS n, count(*) FILTER (o_custkey IS NULL) AS a, 0 AS b, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) AS c,
    count(o_custkey) - count(DISTINCT o_custkey) AS d, count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]')) AS e, count(*) FILTER (NOT (o_totalprice > 50000 OR o_orderstatus = 'F')) AS f FROM orders) s,
  LATERAL (VALUES ('not_null', 'o_custkey', a), ('data_type', 'o_totalprice', b), ('in_range', 'o_totalprice', c), ('unique', 'o_custkey', d), ('regex', 'o_orderpriority', e), ('custom', 'o_totalprice', f)) r(rule, "column", failures)""")
def _rules(t):
    return Q.check_rules(t.orders, [("not_null", "o_custkey"), ("data_type", "o_totalprice", "double"), ("in_range", "o_totalprice", 1000, 400000), ("unique", "o_custkey"),
                                    ("regex", "o_orderpriority", "^[1-4]"), ("custom", "o_totalprice", "o_totalprice > 50000 OR o_orderstatus = 'F'")])


METRICS = """mt AS (SELECT 'completeness' AS metric, 'o_custkey' AS "column", count(o_custkey) * 1.0 / count(*) AS value FROM orders
UNION ALL SELECT 'completeness', 'o_orderstatus', count(nullif(o_orderstatus, 'P')) * 1.0 / count(*) FROM orders
UNION ALL SELECT 'uniqueness', 'o_custkey', count(DISTINCT o_custkey) * 1.0 / count(*) FROM orders
UNION ALL SELECT 'timeliness', 'o_orderdate', epoch_us(TIMESTAMP '2002-01-01' - CAST(max(o_orderdate) AS TIMESTAMP)) / 3.6e9 FROM orders
UNION ALL SELECT 'consistency', 'o_orderpriority', (SELECT -sum(p * ln(p)) FROM (SELECT count(*) * 1.0 / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY o_orderpriority)))"""


def metrics(t):
    o = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    now = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    return Q.metric_rows(o, ["o_custkey", "o_orderstatus"], ["o_custkey"], "o_orderdate", now).unionByName(Q.consistency_rows(o, ["o_orderpriority"]))


@query("quality_metrics", f"WITH {METRICS} SELECT metric, \"column\", {R('value')} AS value FROM mt")
def _metrics(t):
    return rounded(metrics(t))


STATUS = METRICS + """, j AS (SELECT *, CASE metric WHEN 'completeness' THEN CASE WHEN value < 0.9 THEN 'error' WHEN value < 0.95 THEN 'warning' ELSE 'ok' END
  WHEN 'uniqueness' THEN CASE WHEN value < 0.95 THEN 'error' WHEN value < 0.99 THEN 'warning' ELSE 'ok' END
  WHEN 'timeliness' THEN CASE WHEN value > 48 THEN 'error' WHEN value > 24 THEN 'warning' ELSE 'ok' END
  ELSE CASE WHEN value < 0.1 THEN 'error' WHEN value < 0.5 THEN 'warning' ELSE 'ok' END END AS status,
  CASE metric WHEN 'completeness' THEN 0.4 WHEN 'uniqueness' THEN 0.3 WHEN 'timeliness' THEN 0.2 ELSE 0.1 END AS weight FROM mt)"""


@query("quality_status", f"WITH {STATUS} SELECT metric, \"column\", status FROM j")
def _status(t):
    return Q.judged(metrics(t)).select("metric", "column", "status")


@query("quality_score", f"WITH {STATUS} SELECT {R('''sum(CASE status WHEN 'ok' THEN 1.0 WHEN 'warning' THEN 0.5 ELSE 0 END * weight) / sum(weight)''')} AS score, count(*) FILTER (status = 'error') AS failed, sum(CASE status WHEN 'ok' THEN 1.0 WHEN 'warning' THEN 0.5 ELSE 0 END * weight) / sum(weight) >= 0.8 AS passed FROM j")
def _score(t):
    return rounded(Q.quality_score(Q.judged(metrics(t))))


@query("quality_report", f"WITH {STATUS} SELECT metric, count(*) AS checks, count(*) FILTER (status = 'error') AS failed, {R('avg(value)')} AS mean_value, coalesce(string_agg(CASE WHEN status = 'error' THEN \"column\" END, ',' ORDER BY \"column\"), '') AS failed_columns FROM j GROUP BY 1")
def _report(t):
    return rounded(Q.quality_report(Q.judged(metrics(t))))


@query("threshold_kinds", "SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'error' WHEN o_totalprice < 20000 THEN 'warning' ELSE 'ok' END AS lower_status, CASE WHEN o_totalprice NOT BETWEEN 1000 AND 400000 THEN 'error' WHEN o_totalprice NOT BETWEEN 20000 AND 300000 THEN 'warning' ELSE 'ok' END AS range_status, CASE WHEN o_orderstatus NOT IN ('O', 'F', 'X') THEN 'error' WHEN o_orderstatus NOT IN ('O') THEN 'warning' ELSE 'ok' END AS category_status FROM orders")
def _kinds(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", Q.status(p, "lower", 20000, 1000).alias("lower_status"), Q.status(p, "range", (20000, 300000), (1000, 400000)).alias("range_status"),
                           Q.status(F.col("o_orderstatus"), "categorical", ["O"], ["O", "F", "X"]).alias("category_status"))


@query("default_metrics", "SELECT metric, columns, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('completeness', 6), ('consistency', 2), ('timeliness', 1)) v(metric, columns)")
def _defaults(t):
    d = Q.default_metrics(t.orders)
    size = t.orders.agg(F.count(F.lit(1)).alias("rows"))
    return size.select("rows", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(len(v)).alias("columns")) for k, v in d.items()])).alias("x")).select("x.*", "rows")


@query("missing_and_repeated", """WITH m AS (SELECT 'missing' AS metric, 'x' AS "column", count(*) FILTER (l_discount > 0.08) * 1.0 / count(*) AS value FROM lineitem
UNION ALL SELECT 'missing', 'l_tax', 0.0 FROM (SELECT 1) UNION ALL SELECT 'duplicate', 'l_orderkey,l_linenumber', 1 - count(DISTINCT (l_orderkey, l_linenumber)) * 1.0 / count(*) FROM lineitem)
SELECT metric, "column", """ + R("value") + """ AS value, CASE WHEN value > 0.2 THEN 'high' WHEN value > 0.05 THEN 'medium' WHEN value > 0 THEN 'low' ELSE 'none' END AS severity FROM m""")
def _missing(t):
    li = t.lineitem.withColumn("x", F.when(F.col("l_discount") <= 0.08, F.col("l_discount")))
    return rounded(Q.missing_and_repeated(li, ["x", "l_tax"], ["l_orderkey", "l_linenumber"]), 6, "value")


HOURLY = TICKS + """, hist AS (SELECT symbol AS metric, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(price) AS value FROM ticks GROUP BY 1, 2)"""
HISTORY_SERIES = Series(keys=("metric",), ts="ts", tie=())


def history(t):
    return t.ticks.groupBy(F.col("symbol").alias("metric"), F.window("ts", "1 hour")["start"].alias("ts")).agg(F.avg("price").alias("value"))


@query("metric_history", f"WITH {HOURLY} SELECT metric, ts, {R('value')} AS value FROM hist WHERE metric = 'view' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-15'")
def _history(t):
    return rounded(Q.metric_history(history(t), "view", "2024-01-05", "2024-01-15"))


@query("metric_history_newest", f"WITH {HOURLY} SELECT metric, ts, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) AS rank FROM hist QUALIFY rank <= 5")
def _newest(t):
    return newest_per_key(history(t), HISTORY_SERIES, 5).select("metric", "ts", "rank")


@query("alert_states", f"""WITH {HOURLY}, o AS (SELECT *, value > 55 AS is_on, CASE WHEN lag(value > 55) OVER (PARTITION BY metric ORDER BY ts) IS DISTINCT FROM (value > 55) THEN 1 ELSE 0 END AS turn FROM hist),
g AS (SELECT *, sum(turn) OVER (PARTITION BY metric ORDER BY ts) AS run FROM o), b AS (SELECT *, min(ts) OVER (PARTITION BY metric, run) AS since FROM g)
SELECT metric, ts, CASE WHEN NOT is_on THEN 'ok' WHEN epoch_us(ts - since) / 1e6 >= 7200 THEN 'triggered' ELSE 'pending' END AS state FROM b""")
def _alerts(t):
    return Q.alert_states(history(t), HISTORY_SERIES, F.col("value") > 55, 7200).select("metric", "ts", "state")


@query("order_violations", f"""WITH {TICKS}, o AS (SELECT symbol, tie, ts, max(ts) OVER (PARTITION BY symbol ORDER BY d, tie) AS newest FROM
  (SELECT *, ts + CASE WHEN volume > 90 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END AS d FROM ticks)) SELECT symbol, tie FROM o WHERE ts < newest""")
def _violations(t):
    late = t.ticks.withColumn("arrived", F.when(F.col("volume") > 90, F.col("ts") + F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")))
    return Q.order_violations(late, TICK_SERIES, ["arrived", "tie"]).select("symbol", "tie")


@query("composite_quality_check")
def _composite(t):
    li = t.lineitem
    cols = ["l_quantity", "l_extendedprice"]
    return Q.composite_check(li.filter("l_shipdate >= DATE'1996-01-01'"), li.filter("l_shipdate < DATE'1996-01-01'"), cols, ["l_orderkey", "l_linenumber"])
