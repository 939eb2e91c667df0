"""Record validation, column rules, quality metrics and scores, alert states."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.operators.ordered import Panel, Series, cumulative, epoch_us, index_rows
from quotemill.schemas import TICK

c = F.col

# -- record checks ---------------------------------------------------------------------------------------


def issue(when: Column, field: str, kind: str, severity: str, text: str) -> Column:
    return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("issue"), F.lit(severity).alias("severity"), F.lit(text).alias("message")))


def required(field: str) -> Column:
    return issue(c(field).isNull(), field, "missing", "error", f"{field} is required")


def typed(field: str, kind: str) -> Column:
    bad = c(field).isNotNull() & c(field).cast("string").try_cast(kind).isNull()
    return issue(bad, field, "type", "error", f"{field} is not {kind}")


def in_range(field: str, low=None, high=None, severity: str = "error") -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c(field) < low)
    if high is not None:
        bad = bad | (c(field) > high)
    return issue(bad, field, "range", severity, f"{field} outside [{low}, {high}]")


def limits(field: str, low=None, high=None, warn_low=None, warn_high=None) -> list[Column]:
    """Hard bounds are errors; values between a warning bound and the hard bound are warnings."""
    hard = in_range(field, low, high)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (c(field) >= low)
    if high is not None:
        inside = inside & (c(field) <= high)
    soft = F.lit(False)
    if warn_low is not None:
        soft = soft | (c(field) < warn_low)
    if warn_high is not None:
        soft = soft | (c(field) > warn_high)
    return [hard, issue(inside & soft, field, "range", "warning", f"{field} near its limit")]


def outlier(field: str, mean: float, std: float, limit: float = 3.0) -> Column:
    """Distance from the mean in deviations; with a deviation of 0 (or unknown) no row is an outlier."""
    return issue(F.coalesce(F.try_divide(F.abs(c(field) - F.lit(mean)), F.lit(std)) > limit, F.lit(False)), field, "outlier", "warning", f"{field} is more than {limit} deviations off")


def one_of(field: str, values: Sequence[str]) -> Column:
    return issue(c(field).isNotNull() & ~c(field).isin(list(values)), field, "enum", "error", f"{field} has an unknown value")


def pattern(field: str, regex: str) -> Column:
    return issue(c(field).isNotNull() & ~c(field).rlike(regex), field, "pattern", "error", f"{field} does not match")


def validate(df: DataFrame, checks: Sequence[Column]) -> DataFrame:
    """Adds ``issues`` (array) and ``valid`` (no error among them)."""
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    out = df.withColumn("issues", found)
    return out.withColumn("valid", ~F.exists("issues", lambda x: x["severity"] == "error"))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.filter("valid"), validated.filter("NOT valid")


def issue_rows(validated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return validated.select(*keys, F.explode("issues").alias("x")).select(*keys, "x.*")


# JSON-schema draft 7 subset: type, required, enum, minimum, maximum, pattern.
_JSON_TYPES = {"number": "double", "integer": "bigint", "string": "string", "boolean": "boolean"}


def schema_checks(schema: Mapping) -> list[Column]:
    checks = [required(f) for f in schema.get("required", [])]
    for field, spec in schema.get("properties", {}).items():
        if "type" in spec and spec["type"] != "string":
            checks.append(typed(field, _JSON_TYPES[spec["type"]]))
        if "enum" in spec:
            checks.append(one_of(field, spec["enum"]))
        if "minimum" in spec or "maximum" in spec:
            checks.append(in_range(field, spec.get("minimum"), spec.get("maximum")))
        if "pattern" in spec:
            checks.append(pattern(field, spec["pattern"]))
    return checks


# How a JSON value's type shows in the schema text of a parsed value.
_JSON_KINDS = {"string": "^STRING", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "integer": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN",
               "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def json_checks(schema: Mapping, text: str = "payload") -> list[Column]:
    """Checks of a JSON text as it stands: broken text, types (strings too), nested objects, items of lists, and bounds.

    ``schema`` uses type, required, properties, items, enum, minimum, maximum, pattern, minLength and maxLength.  A field is
    named by its path.  A null text is missing; a field that holds JSON null is there, and of type null.
    """
    doc = F.try_parse_json(c(text))
    return [required(text), issue(c(text).isNotNull() & doc.isNull(), text, "json", "error", f"{text} is not JSON"), *_value_issues(doc, schema, "", text)]


def _is(value: Column, kind: str) -> Column:
    fits = F.schema_of_variant(value).rlike(_JSON_KINDS[kind])
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        return fits & (number == F.floor(number))
    return fits


def _value_faults(value: Column, spec: Mapping) -> list[tuple[str, Column]]:
    """What can be wrong with one value itself; a value that is not there has no faults."""
    faults, number, string = [], F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    kinds = spec.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if kinds:
        fits = F.lit(False)
        for kind in kinds:
            fits = fits | F.coalesce(_is(value, kind), F.lit(False))
        faults.append(("type", ~fits))
    is_text, is_number = _is(value, "string"), _is(value, "number")
    if "enum" in spec:
        texts, numbers = [x for x in spec["enum"] if isinstance(x, str)], [float(x) for x in spec["enum"] if not isinstance(x, str)]
        known = (is_text & string.isin(texts) if texts else F.lit(False)) | (is_number & number.isin(numbers) if numbers else F.lit(False))
        faults.append(("enum", ~known))
    low, high = spec.get("minimum"), spec.get("maximum")
    if low is not None or high is not None:
        out = (number < low if low is not None else F.lit(False)) | (number > high if high is not None else F.lit(False))
        faults.append(("range", is_number & out))
    if "pattern" in spec:
        faults.append(("pattern", is_text & ~string.rlike(spec["pattern"])))
    if "minLength" in spec or "maxLength" in spec:
        faults.append(("length", is_text & ~F.length(string).between(spec.get("minLength", 0), spec.get("maxLength", 2**31 - 1))))
    return [(kind, value.isNotNull() & F.coalesce(bad, F.lit(False))) for kind, bad in faults]


def _value_issues(value: Column, spec: Mapping, path: str, name: str) -> list[Column]:
    where = path or name
    out = [issue(bad, where, kind, "error", f"{where} fails {kind}") for kind, bad in _value_faults(value, spec)]
    inside = F.coalesce(_is(value, "object"), F.lit(False))
    for field, below in spec.get("properties", {}).items():
        child = F.try_variant_get(value, f"$['{field}']", "variant")
        at = f"{path}.{field}" if path else field
        if field in spec.get("required", []):
            out.append(issue(inside & child.isNull(), at, "missing", "error", f"{at} is required"))
        out += _value_issues(child, below, at, name)
    for field in spec.get("required", []):
        if field not in spec.get("properties", {}):
            at = f"{path}.{field}" if path else field
            out.append(issue(inside & F.try_variant_get(value, f"$['{field}']", "variant").isNull(), at, "missing", "error", f"{at} is required"))
    if "items" in spec:
        def wrong(item: Column) -> Column:
            bad = item.isNull()
            for _, fault in _value_faults(item, spec["items"]):
                bad = bad | fault
            return bad

        items = F.try_variant_get(value, "$", "array<variant>")
        out.append(issue(F.coalesce(F.exists(items, wrong), F.lit(False)), where, "items", "error", f"{where} has wrong items"))
    return out


# The default checks of a tick.
TICK_SCHEMA = {
    "required": ["symbol", "price", "volume", "ts"],
    "properties": {"price": {"type": "number", "minimum": 0}, "volume": {"type": "number", "minimum": 0}},
}
TICK_FIELDS = [f.name for f in TICK.fields]

# -- column rules ----------------------------------------------------------------------------------------

RULES: dict[str, Callable[..., Column]] = {
    "not_null": lambda col: F.count_if(c(col).isNull()),
    "data_type": lambda col, kind: F.count_if(c(col).isNotNull() & c(col).cast("string").try_cast(kind).isNull()),
    "in_range": lambda col, low, high: F.count_if((c(col) < low) | (c(col) > high)),
    "unique": lambda col: F.count(c(col)) - F.count_distinct(c(col)),
    "regex": lambda col, regex: F.count_if(c(col).isNotNull() & ~c(col).rlike(regex)),
    "custom": lambda col, expr: F.count_if(~F.expr(expr)),
}


def register_rule(name: str, failures: Callable[..., Column]) -> None:
    """Add a rule: a function of the column name (and arguments) giving the number of failures as an aggregate."""
    RULES[name] = failures


def check_rules(df: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """All (rule, column, *args) in one aggregate: rule, column, failures, rows, passed."""
    n = F.count(F.lit(1))
    wide = df.agg(*[F.struct(F.lit(r).alias("rule"), F.lit(col).alias("column"), RULES[r](col, *args).alias("failures"), n.alias("rows")).alias(f"_{k}")
                    for k, (r, col, *args) in enumerate(rules)])
    out = wide.select(F.explode(F.array(*[f"_{k}" for k in range(len(rules))])).alias("x")).select("x.*")
    return out.withColumn("passed", c("failures") == 0)


def missing_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    return sorted(set(expected) - set(df.columns))


# -- metrics ---------------------------------------------------------------------------------------------


def metric_rows(df: DataFrame, cols: Sequence[str], keys: Sequence[str], ts: str, now: Column) -> DataFrame:
    """completeness per column, uniqueness of the key, age of the newest row in hours: (metric, column, value)."""
    n = F.count(F.lit(1))
    parts = [F.struct(F.lit("completeness").alias("metric"), F.lit(x).alias("column"), (F.count(x) / n).alias("value")) for x in cols]
    parts.append(F.struct(F.lit("uniqueness").alias("metric"), F.lit(",".join(keys)).alias("column"),
                          (F.count_distinct(F.struct(*keys)) / n).alias("value")))
    age = F.max(epoch_us(ts))
    parts.append(F.struct(F.lit("timeliness").alias("metric"), F.lit(ts).alias("column"), ((epoch_us(now) - age) / F.lit(3.6e9)).alias("value")))
    wide = df.agg(*[p.alias(f"_{k}") for k, p in enumerate(parts)])
    return wide.select(F.explode(F.array(*[f"_{k}" for k in range(len(parts))])).alias("x")).select("x.*")


def consistency_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Entropy of each categorical column as a metric row."""
    from quotemill.operators.stats import entropy

    out = None
    for x in cols:
        row = entropy(df, x).select(F.lit("consistency").alias("metric"), F.lit(x).alias("column"), c("entropy").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def status(value: Column, kind: str, warning, error) -> Column:
    """Threshold check: lower, upper, range ((low, high) pairs) or categorical (allowed values)."""
    if kind == "lower":
        bad, near = value < error, value < warning
    elif kind == "upper":
        bad, near = value > error, value > warning
    elif kind == "range":
        bad, near = ~value.between(*error), ~value.between(*warning)
    elif kind == "categorical":
        bad, near = ~value.isin(list(error)), ~value.isin(list(warning))
    else:
        raise ValueError(f"unknown threshold {kind!r}")
    return F.when(bad, "error").when(near, "warning").otherwise("ok")


# Thresholds (kind, warning, error) and weights of the default metrics.
DEFAULT_THRESHOLDS = {
    "completeness": ("lower", 0.95, 0.9, 0.4),
    "uniqueness": ("lower", 0.99, 0.95, 0.3),
    "timeliness": ("upper", 24.0, 48.0, 0.2),
    "consistency": ("lower", 0.5, 0.1, 0.1),
}


def judged(metrics: DataFrame) -> DataFrame:
    """Adds status and weight by metric name."""
    st, w = F.lit("ok"), F.lit(0.0)
    for name, (kind, warn, err, weight) in DEFAULT_THRESHOLDS.items():
        st = F.when(c("metric") == name, status(c("value"), kind, warn, err)).otherwise(st)
        w = F.when(c("metric") == name, weight).otherwise(w)
    return metrics.withColumns({"status": st, "weight": w})


def quality_score(judged_rows: DataFrame, pass_at: float = 0.8) -> DataFrame:
    """Weighted share of full points (ok 1, warning 1/2, error 0) and the verdict."""
    points = F.when(c("status") == "ok", 1.0).when(c("status") == "warning", 0.5).otherwise(0.0)
    out = judged_rows.agg((F.sum(points * c("weight")) / F.sum("weight")).alias("score"), F.count_if(c("status") == "error").alias("failed"))
    return out.withColumn("passed", c("score") >= pass_at)


def quality_report(judged_rows: DataFrame) -> DataFrame:
    """Per metric type: number of metrics, failures, mean value and the failing columns."""
    return judged_rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(c("status") == "error").alias("failed"), F.avg("value").alias("mean_value"),
        F.array_join(F.array_sort(F.collect_list(F.when(c("status") == "error", c("column")))), ",").alias("failed_columns"))


def report_history(log: DataFrame, newest: int = 5, order: str = "batch") -> DataFrame:
    """The reports of the ``newest`` batches of a metric log: per metric and batch the checks, failures and failing columns.

    A log has a row per batch and metric, so its distinct batches are few.
    """
    batches = log.select(order).distinct().orderBy(F.desc(order)).limit(newest)
    kept = log.join(F.broadcast(batches), order)
    failed = F.when(c("status") == "error", c("column"))
    return kept.groupBy(order, "metric").agg(
        F.count(F.lit(1)).alias("checks"), F.count(failed).alias("failed"), F.avg("value").alias("mean_value"),
        F.array_join(F.array_sort(F.collect_list(failed)), ",").alias("failed_columns"))


def default_metrics(df: DataFrame) -> dict[str, list[str]]:
    """Which metrics apply to which columns, by type."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return {"completeness": list(kinds), "consistency": [n for n, t in kinds.items() if t == "string"],
            "timeliness": [n for n, t in kinds.items() if t.startswith("timestamp")]}


# Share bounds of missing values and repeated rows, and their severities.
MISSING_BANDS = ((0.2, "high"), (0.05, "medium"), (0.0, "low"))


def missing_and_repeated(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Missing share per column and share of repeated keys, with severities."""
    n = F.count(F.lit(1))
    parts = [F.struct(F.lit("missing").alias("metric"), F.lit(x).alias("column"), (F.count_if(c(x).isNull()) / n).alias("value")) for x in cols]
    parts.append(F.struct(F.lit("duplicate").alias("metric"), F.lit(",".join(keys)).alias("column"), (1 - F.count_distinct(F.struct(*keys)) / n).alias("value")))
    wide = df.agg(*[p.alias(f"_{k}") for k, p in enumerate(parts)])
    out = wide.select(F.explode(F.array(*[f"_{k}" for k in range(len(parts))])).alias("x")).select("x.*")
    sev = F.lit("none")
    for bound, name in reversed(MISSING_BANDS):
        sev = F.when(c("value") > bound, name).otherwise(sev)
    return out.withColumn("severity", sev)


def metric_history(history: DataFrame, metric: str, start=None, end=None) -> DataFrame:
    out = history.filter(c("metric") == metric)
    if start is not None:
        out = out.filter(c("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(c("ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def alert_states(history: DataFrame, s: Series, condition: Column, alert_after: float) -> DataFrame:
    """State per observation: ok, pending, or triggered once the condition has held for ``alert_after`` seconds."""
    p = Panel(history.withColumn("_on", condition), s)
    p.add("_turn", F.coalesce((F.lag("_on").over(p.w) != c("_on")).cast("int"), F.lit(1)), back=1)
    d = p.done(keep_index=True).withColumn("_since_here", F.when(c("_turn") == 1, epoch_us(s.ts)))
    d = cumulative(d, s, {"_since": ("last", "_since_here")}, indexed=True)
    held = (epoch_us(s.ts) - c("_since")) / F.lit(1e6)
    state = F.when(~c("_on"), "ok").when(held >= alert_after, "triggered").otherwise("pending")
    return d.withColumn("state", state).drop("_on", "_turn", "_since_here", "_since", "_i")


def order_violations(df: DataFrame, s: Series, arrival: Sequence[str]) -> DataFrame:
    """Rows whose timestamp is earlier than the newest timestamp that arrived before, per key."""
    by = s.with_(ts=arrival[0], tie=tuple(arrival[1:]))
    seen = cumulative(index_rows(df, by), by, {"_newest": ("max", s.ts)}, indexed=True)
    return seen.filter(c(s.ts) < c("_newest")).drop("_newest", "_i")


def composite_check(df: DataFrame, ref: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Missing and repeated shares, KS and stability index of each column, and the anomaly ratio, in one table."""
    from quotemill.operators import drift as D

    base = missing_and_repeated(df, cols, keys).select("metric", "column", "value")
    o = D.order_statistics(ref, df, cols).select(F.lit("ks").alias("metric"), c("feature").alias("column"), c("ks").alias("value"))
    b = D.binned_measures(D.shared_histogram(ref, df, cols)).select(F.lit("psi").alias("metric"), c("feature").alias("column"), c("psi").alias("value"))
    a = D.anomaly_ratio(ref, df, cols).select(F.lit("anomaly_ratio").alias("metric"), F.lit(",".join(cols)).alias("column"), c("ratio").alias("value"))
    return base.unionByName(o).unionByName(b).unionByName(a)

