"""Streams over the event table; update-mode results are compared with the batch answer in SQL."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quotemill.operators import quality as Q
from quotemill.operators.ordered import Series
from quotemill.plans.market import TICKS, ticks
from quotemill.plans.bars_queries import OHLCV_COLS, SUMMARY
from quotemill.plans.micro_queries import DELTAS, deltas
from quotemill.plans.registry import R, kolmogorov, query, rnd, rounded
from quotemill.schemas import EVENTS
from quotemill.session import scratch
from quotemill.sources import decode, log, store
from quotemill.streaming import jobs, monitor, stateful
from quotemill.streaming.joins import capped_join
from quotemill.streaming.retry import RetryQueue
from quotemill.streaming.spec import from_config

# Four arrivals by event time; each lands as Spark writes it, and a run of the stream takes it in as one batch.
BATCHES = ["ts < TIMESTAMP_NTZ'2024-01-08'", "ts >= TIMESTAMP_NTZ'2024-01-08' AND ts < TIMESTAMP_NTZ'2024-01-15'",
           "ts >= TIMESTAMP_NTZ'2024-01-15' AND ts < TIMESTAMP_NTZ'2024-01-22'", "ts >= TIMESTAMP_NTZ'2024-01-22'"]
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


BATCH_OF = "CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-15' THEN 1 WHEN ts < TIMESTAMP '2024-01-22' THEN 2 ELSE 3 END"


class Arrivals:
    """A landing folder that gets one part after the other, and the stream over it.

    With ``late``, high prices arrive one part after their time.
    """

    def __init__(self, t, late: bool = False, parts=None):
        self.spark, self.path = t.spark, scratch(t.spark, "landing")
        events, slow = t.events, F.col("value") > 80
        self.parts = parts or [events.filter(cond) for cond in BATCHES]
        if late:
            on_time, delayed = [p.filter(~slow) for p in self.parts], [p.filter(slow) for p in self.parts]
            self.parts = [on_time[0], *[now.unionByName(before) for now, before in zip(on_time[1:], delayed)]]
            self.parts[-1] = self.parts[-1].unionByName(delayed[-1])
        self._land(0)

    def _land(self, k: int) -> None:
        self.parts[k].write.mode("append").parquet(f"{self.path}/all")

    def stream(self):
        return ticks(store.stream_table(self.spark, f"{self.path}/*", EVENTS))

    def run(self, df, handler, checkpoint: str, mode: str = "append") -> None:
        """Run the stream once per part; state goes from run to run through the checkpoint.

        A batch without data, which a run adds to move its watermark on, is left to the last run.
        """
        before = self.spark.conf.get(NO_DATA)
        try:
            for k in range(len(self.parts)):
                if k:
                    self._land(k)
                self.spark.conf.set(NO_DATA, before if k == len(self.parts) - 1 else "false")
                jobs.start(df, handler, checkpoint, mode).awaitTermination()
        finally:
            self.spark.conf.set(NO_DATA, before)

    def table(self, df, label: str, mode: str = "append", handler=jobs.batch_writer):
        path = scratch(self.spark, label)
        self.run(df, handler(f"{path}/data"), f"{path}/checkpoint", mode)
        return self.spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")


@query("stream_tumbling", f"""WITH {TICKS} SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, symbol, {SUMMARY} FROM ticks GROUP BY 1, 2, 3""")
def _tumbling(t):
    a = Arrivals(t)
    out = a.table(jobs.tumbling(a.stream(), "5 minutes"), "tumbling", "update")
    return rounded(jobs.latest(out, ["window_start", "window_end", "symbol"]), 6, "avg_price", "vwap", "price_stddev")


@query("stream_sliding", f"""WITH {TICKS}, s AS (SELECT *, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS w FROM ticks)
SELECT w AS window_start, w + INTERVAL 10 MINUTE AS window_end, symbol, {SUMMARY} FROM s GROUP BY 1, 2, 3""")
def _sliding(t):
    a = Arrivals(t)
    out = a.table(jobs.sliding(a.stream(), "10 minutes", "5 minutes"), "sliding", "update")
    return rounded(jobs.latest(out, ["window_start", "window_end", "symbol"]), 6, "avg_price", "vwap", "price_stddev")


@query("stream_sessions", f"""WITH {TICKS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, tie) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM ticks),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, tie) AS session_id FROM g), f AS (SELECT user_id, session_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n, {R('sum(price)', 4)} AS total FROM n GROUP BY 1, 2)
SELECT user_id, start_ts, end_ts, n, total FROM f WHERE end_ts < (SELECT max(ts) FROM ticks) - INTERVAL 5 MINUTE""")
def _sessions(t):
    """Append mode: sessions the final watermark has closed."""
    a = Arrivals(t)
    out = a.table(jobs.sessions(a.stream(), "30 minutes"), "sessions", "append").drop("batch")
    return out.select("user_id", "start_ts", "end_ts", "n", rnd("total", 4).alias("total"))


@query("stream_join", f"""WITH {TICKS} SELECT l.tie AS l_tie, r.tie AS r_tie FROM ticks l JOIN ticks r ON l.user_id = r.user_id AND l.symbol = 'click' AND r.symbol = 'view' AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 2 HOUR""")
def _join(t):
    a = Arrivals(t)
    left = a.stream().filter("symbol = 'click'").select("user_id", F.col("tie").alias("l_tie"), F.col("ts").alias("l_ts"))
    right = a.stream().filter("symbol = 'view'").select("user_id", F.col("tie").alias("r_tie"), F.col("ts").alias("r_ts"))
    return a.table(jobs.windowed_join(left, right, ["user_id"], "2 hours"), "join").select("l_tie", "r_tie")


@query("stream_left_join", f"""WITH {TICKS}, m AS (SELECT l.tie AS l_tie, l.ts, r.tie AS r_tie FROM ticks l LEFT JOIN ticks r ON l.user_id = r.user_id AND r.symbol = 'purchase' AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 2 HOUR WHERE l.symbol = 'click')
SELECT l_tie, coalesce(r_tie, -1) AS r_tie FROM m WHERE r_tie IS NOT NULL OR ts < (SELECT least(max(ts) FILTER (symbol = 'click'), max(ts) FILTER (symbol = 'purchase')) - INTERVAL 5 MINUTE FROM ticks)""")
def _left_join(t):
    a = Arrivals(t)
    left = a.stream().filter("symbol = 'click'").select("user_id", F.col("tie").alias("l_tie"), F.col("ts").alias("l_ts"))
    right = a.stream().filter("symbol = 'purchase'").select("user_id", F.col("tie").alias("r_tie"), F.col("ts").alias("r_ts"))
    out = a.table(jobs.windowed_join(left, right, ["user_id"], "2 hours", how="left_outer"), "left-join")
    return out.select("l_tie", F.coalesce("r_tie", F.lit(-1)).alias("r_tie"))  # rows without a match come out once the watermark has passed them


@query("stream_full_join", f"""WITH {TICKS}, b AS (SELECT least(max(ts) FILTER (symbol = 'click'), max(ts) FILTER (symbol = 'purchase')) - INTERVAL 5 MINUTE AS wm FROM ticks),
l AS (SELECT * FROM ticks WHERE symbol = 'click'), r AS (SELECT * FROM ticks WHERE symbol = 'purchase'),
m AS (SELECT l.tie AS l_tie, l.ts AS l_ts, r.tie AS r_tie, r.ts AS r_ts FROM l FULL JOIN r ON l.user_id = r.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL 2 HOUR)
SELECT coalesce(l_tie, -1) AS l_tie, coalesce(r_tie, -1) AS r_tie FROM m, b WHERE (l_tie IS NOT NULL AND r_tie IS NOT NULL) OR l_ts < wm OR r_ts + INTERVAL 2 HOUR < wm""")
def _full_join(t):
    a = Arrivals(t)
    left = a.stream().filter("symbol = 'click'").select("user_id", F.col("tie").alias("l_tie"), F.col("ts").alias("l_ts"))
    right = a.stream().filter("symbol = 'purchase'").select("user_id", F.col("tie").alias("r_tie"), F.col("ts").alias("r_ts"))
    return a.table(jobs.windowed_join(left, right, ["user_id"], "2 hours", how="full_outer"), "full-join").select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("l_tie", "r_tie")])


@query("stream_capped_join", f"""WITH {TICKS}, s AS (SELECT user_id, tie, ts, CASE symbol WHEN 'click' THEN 0 ELSE 1 END AS side FROM ticks WHERE symbol IN ('click', 'purchase')),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY ts, tie) AS rn, count(*) FILTER (side = 0) OVER w AS n0, count(*) FILTER (side = 1) OVER w AS n1
  FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, tie, side ROWS UNBOUNDED PRECEDING)),
m AS (SELECT a.side, a.tie, b.tie AS other FROM o a LEFT JOIN o b ON a.user_id = b.user_id AND b.side = 1 - a.side
  AND b.rn <= CASE a.side WHEN 0 THEN a.n1 ELSE a.n0 END AND b.rn > CASE a.side WHEN 0 THEN a.n1 ELSE a.n0 END - 3 AND b.ts >= a.ts - INTERVAL 36 HOUR)
SELECT coalesce(CASE side WHEN 0 THEN tie ELSE other END, -1) AS l_tie, coalesce(CASE side WHEN 0 THEN other ELSE tie END, -1) AS r_tie FROM m WHERE side = 1 OR other IS NOT NULL""")
def _capped(t):
    """Right join of clicks and purchases of a user: at most three rows of either side are held, for 36 hours."""
    a = Arrivals(t)
    side = lambda name: a.stream().filter(F.col("symbol") == name).select("user_id", "ts", "tie")
    out = a.table(capped_join(side("click"), side("purchase"), ["user_id"], cap=3, expire=36 * 3600, how="right"), "capped-join", "update")
    return out.select(*[F.coalesce(F.col(f"{x}.tie"), F.lit(-1)).alias(f"{x}_tie") for x in ("l", "r")])


@query("stream_count_windows", f"""WITH {TICKS}, i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, tie) - 1 AS i FROM ticks),
w AS (SELECT *, unnest(range(CAST(greatest(ceil((i - 99) / 50), 0) AS BIGINT), CAST(floor(i / 50) + 1 AS BIGINT))) AS window_id FROM i)
SELECT symbol, window_id, {R('avg(price)')} AS avg_price, sum(volume) AS volume FROM w GROUP BY 1, 2 HAVING count(*) = 100""")
def _count(t):
    a = Arrivals(t)
    return rounded(a.table(stateful.count_windows(a.stream(), 100, 50), "count-windows").drop("batch"), 6, "avg_price")


@query("stream_running_state", f"WITH {TICKS} SELECT symbol, count(*) AS n, arg_max(price, (ts, tie)) AS last_price, arg_max(volume, (ts, tie)) AS last_volume, arg_max(tie, (ts, tie)) AS last_tie FROM ticks GROUP BY 1")
def _state(t):
    a = Arrivals(t)
    return jobs.latest(a.table(stateful.running_state(a.stream()), "running", "update"), ["symbol"])


@query("stream_live_book", f"WITH {DELTAS} SELECT symbol, side, price, size FROM levels WHERE size > 0")
def _live_book(t):
    a = Arrivals(t)

    class View:
        ticks = a.stream()

    out = a.table(stateful.live_book(deltas(View), 0.5), "live-book", "update")
    newest = out.groupBy("symbol").agg(F.max("sequence").alias("sequence"))
    return out.join(newest, ["symbol", "sequence"], "left_semi").select("symbol", "side", "price", "size")


@query("stream_deduplicated", f"WITH {TICKS} SELECT tie, symbol, price FROM ticks")
def _dedup(t):
    """Every event lands a second time one batch later, inside the allowed lateness; each comes out once."""
    parts = [t.events.filter(cond) for cond in BATCHES]
    a = Arrivals(t, parts=[parts[0], *[now.unionByName(before) for now, before in zip(parts[1:], parts)], parts[-1]])
    return a.table(jobs.deduplicated(a.stream(), ["tie"], "15 days"), "dedup").select("tie", "symbol", "price")


@query("stream_exactly_once", "SELECT event_type AS symbol, count(*) AS n, " + R("sum(value)", 3) + " AS total FROM events GROUP BY 1")
def _once(t):
    """Two runs on one checkpoint: the second finds nothing new, so no row is counted twice."""
    path = scratch(t.spark, "once")
    source = f"{path}/landing/*"
    for cond in ("ts < TIMESTAMP_NTZ'2024-01-15'", "ts >= TIMESTAMP_NTZ'2024-01-15'"):
        t.events.filter(cond).write.mode("append").parquet(f"{path}/landing/all")
        for _ in range(2):
            s = ticks(store.stream_table(t.spark, source, EVENTS))
            jobs.start(s, jobs.batch_writer(f"{path}/data"), f"{path}/checkpoint").awaitTermination()
    out = t.spark.read.parquet(f"{path}/data")
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("price"), 3).alias("total"))


@query("stream_late_rows", f"""WITH a AS (SELECT event_id, ts, least({BATCH_OF} + CASE WHEN value > 80 THEN 1 ELSE 0 END, 3) AS batch FROM events),
n AS (SELECT batch, max(ts) AS top FROM a GROUP BY 1), l AS (SELECT a.event_id, a.ts < (SELECT max(top) FROM n WHERE n.batch < a.batch) - INTERVAL 1 HOUR AS late FROM a)
SELECT coalesce(late, false) AS is_late, count(*) AS n FROM l GROUP BY 1""")
def _late(t):
    path = scratch(t.spark, "late")
    a = Arrivals(t, late=True)
    a.run(a.stream(), jobs.with_late_rows(f"{path}/out", 3600), f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/out/rows").groupBy("is_late").agg(F.count(F.lit(1)).alias("n"))


@query("stream_incremental_rollup", f"""WITH {TICKS}, m AS (SELECT symbol, exchange, time_bucket(INTERVAL 1 MINUTE, ts) AS b, {OHLCV_COLS.replace(R('sum(price * volume) / nullif(sum(volume), 0)'), 'sum(price * volume) / nullif(sum(volume), 0)')} FROM ticks GROUP BY 1, 2, 3)
SELECT symbol, exchange, time_bucket(INTERVAL 1 HOUR, b) AS bucket, arg_min(open, b) AS open, max(high) AS high, min(low) AS low, arg_max(close, b) AS close, sum(volume) AS volume,
  {R('sum(vwap * volume) / nullif(sum(volume), 0)')} AS vwap, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM m GROUP BY 1, 2, 3""")
def _rollup(t):
    path = scratch(t.spark, "rollup")
    a = Arrivals(t, late=True)
    a.run(a.stream(), jobs.incremental_rollup(f"{path}/bars", f"{path}/ticks"), f"{path}/checkpoint")
    return rounded(jobs.latest(t.spark.read.parquet(f"{path}/bars"), ["symbol", "exchange", "bucket"]), 6, "vwap")


FIRST_WEEK = "ts < TIMESTAMP '2024-01-08'"


@query("stream_drift", f"""WITH {TICKS}, f AS (SELECT ts, 'price' AS feature, price AS v FROM ticks UNION ALL SELECT ts, 'volume', volume FROM ticks),
cells AS (SELECT CAST(b.batch AS INT) AS batch, feature, v, 1 AS r, 0 AS c FROM f, (SELECT unnest(range(4)) AS batch) b WHERE {FIRST_WEEK}
  UNION ALL SELECT CAST({{b}} AS INT), feature, v, 0, 1 FROM f),
k AS (SELECT batch, feature, v, sum(r) AS nr, sum(c) AS nc FROM cells GROUP BY 1, 2, 3),
m AS (SELECT *, sum(nr) OVER w AS cr, sum(nc) OVER w AS cc, sum(nr) OVER (PARTITION BY batch, feature) AS n, sum(nc) OVER (PARTITION BY batch, feature) AS m
  FROM k WINDOW w AS (PARTITION BY batch, feature ORDER BY v)),
d AS (SELECT batch, feature, max(abs(cr / n - cc / m)) AS ks, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM m GROUP BY 1, 2),
l AS (SELECT batch, feature, min(v) AS lo, max(v) AS hi FROM cells GROUP BY 1, 2),
h0 AS (SELECT batch, feature, CAST(least(floor((v - lo) / (hi - lo) * 10), 9) AS INT) AS bin, sum(r) AS nr, sum(c) AS nc FROM cells JOIN l USING (batch, feature) GROUP BY 1, 2, 3),
h AS (SELECT g.batch, g.feature, coalesce(nr, 0) / n + 1e-10 AS p, coalesce(nc, 0) / m + 1e-10 AS q
  FROM (SELECT batch, feature, CAST(unnest(range(10)) AS INT) AS bin FROM l) g LEFT JOIN h0 USING (batch, feature, bin) JOIN d USING (batch, feature)),
i AS (SELECT batch, feature, sum((p - q) * ln(p / q)) AS psi FROM h GROUP BY 1, 2),
a AS (SELECT batch, feature, abs(avg(v) FILTER (c = 1) - avg(v) FILTER (r = 1)) / stddev_samp(v) FILTER (r = 1) AS shift FROM cells GROUP BY 1, 2),
o AS (SELECT *, {kolmogorov('ks * sqrt(n * m / (n + m))')} AS p FROM d JOIN i USING (batch, feature) JOIN a USING (batch, feature))
SELECT batch, feature, {R('ks')} AS ks, n, m, {R('psi')} AS psi, {R('shift')} AS mean_shift, {R('p')} AS p_value, p < 0.05 AS drift FROM o""".replace("{b}", BATCH_OF))
def _drift(t):
    reference = t.ticks.filter("ts < TIMESTAMP_NTZ'2024-01-08'")
    a = Arrivals(t)
    out = a.table(a.stream(), "drift", handler=lambda p: jobs.drift_per_batch(p, reference, ["price", "volume"]))
    return rounded(out, 6, "ks", "psi", "mean_shift", "p_value")


@query("drift_alerts", f"""WITH RECURSIVE {TICKS}, h AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, avg(price) AS score FROM ticks GROUP BY 1, 2),
w AS MATERIALIZED (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM h WHERE {R('score', 4)} > 60),
k AS (SELECT symbol, ts, rn, ts AS last, true AS fired FROM w WHERE rn = 1 UNION ALL
  SELECT w.symbol, w.ts, w.rn, CASE WHEN w.ts - k.last >= INTERVAL 6 HOUR THEN w.ts ELSE k.last END, w.ts - k.last >= INTERVAL 6 HOUR FROM k JOIN w ON w.symbol = k.symbol AND w.rn = k.rn + 1)
SELECT symbol, ts FROM k WHERE fired""")
def _alerts(t):
    scores = t.ticks.groupBy("symbol", F.window("ts", "1 hour")["start"].alias("ts")).agg(F.avg("price").alias("score"))
    s = Series(keys=("symbol",), ts="ts", tie=())
    return stateful.alerts_with_cooldown(scores, s, rnd("score", 4) > 60, 6 * 3600).select("symbol", "ts")


# The reference misses high prices, by symbol to a different degree, so that some keys drift and some do not.
REFERENCE = "ts < TIMESTAMP '2024-01-08' AND price < 40 + 7 * length(symbol)"
RULES = (monitor.AlertRule("high_confidence_drift", "critical", max_p=0.01, cooldown=8 * 86400.0), monitor.AlertRule("moderate_drift", max_p=0.05),
         monitor.AlertRule("large_effect_size", min_statistic=0.25, cooldown=16 * 86400.0))
RULES_SQL = ", ".join(f"('{r.name}', '{r.severity}', {r.max_p or -1!r}, {r.min_statistic or 2!r}, {int(r.cooldown)})" for r in RULES)


@query("stream_drift_monitor", f"""WITH RECURSIVE {TICKS}, f AS (SELECT symbol, 'price' AS feature, ts, tie, price AS v, price FROM ticks UNION ALL SELECT symbol, 'volume', ts, tie, volume, price FROM ticks),
r AS (SELECT symbol, feature, v, count(*) AS n FROM f WHERE {REFERENCE} GROUP BY 1, 2, 3),
run AS (SELECT *, sum(n) OVER (PARTITION BY symbol, feature ORDER BY v) AS cum, sum(n) OVER (PARTITION BY symbol, feature) AS size FROM r),
pts AS (SELECT symbol, feature, v, cum / size AS share, size::DOUBLE AS size FROM run WHERE (cum * 100) // size > ((cum - n) * 100) // size),
arrived AS (SELECT *, {BATCH_OF} AS arrival FROM f),
buf AS (SELECT * FROM (SELECT b.batch, symbol, feature, ts, v, row_number() OVER (PARTITION BY b.batch, symbol, feature ORDER BY ts DESC, tie DESC) AS rn
  FROM arrived JOIN (SELECT unnest(range(4)) AS batch) b ON arrival <= b.batch) WHERE rn <= 300),
have AS (SELECT DISTINCT arrival AS batch, symbol, feature FROM arrived),
m AS (SELECT batch, symbol, feature, count(*)::DOUBLE AS m, max(ts) AS seen FROM buf JOIN have USING (batch, symbol, feature) GROUP BY 1, 2, 3 HAVING count(*) >= 150),
d AS (SELECT batch, symbol, feature, p.v, any_value(share) AS share, any_value(size) AS size, any_value(m) AS m, any_value(seen) AS seen, count(*) FILTER (buf.v <= p.v) AS c
  FROM m JOIN pts p USING (symbol, feature) JOIN buf USING (batch, symbol, feature) GROUP BY 1, 2, 3, 4),
ks AS (SELECT batch, symbol, feature, any_value(seen) AS seen, any_value(m) AS m, any_value(size) AS size, max(abs(c / m - share)) AS statistic FROM d GROUP BY 1, 2, 3),
t AS (SELECT *, {kolmogorov('statistic * sqrt(size * m / (size + m))')} AS p FROM ks),
met AS MATERIALIZED (SELECT t.*, rule, severity, cooldown, row_number() OVER (PARTITION BY symbol, feature, rule ORDER BY seen) AS rn
  FROM t JOIN (VALUES {RULES_SQL}) AS rules(rule, severity, max_p, min_statistic, cooldown) ON p < 0.05 AND (p < max_p OR statistic > min_statistic)),
k AS (SELECT symbol, feature, rule, rn, seen AS last, true AS fired FROM met WHERE rn = 1 UNION ALL
  SELECT met.symbol, met.feature, met.rule, met.rn, CASE WHEN met.seen - k.last >= to_seconds(cooldown) THEN met.seen ELSE k.last END, met.seen - k.last >= to_seconds(cooldown)
  FROM k JOIN met ON met.symbol = k.symbol AND met.feature = k.feature AND met.rule = k.rule AND met.rn = k.rn + 1)
SELECT symbol, feature, rule, severity, seen AS ts, {R('statistic')} AS statistic, {R('p')} AS p_value, CAST(m AS BIGINT) AS samples FROM met JOIN k USING (symbol, feature, rule, rn) WHERE fired""")
def _monitor(t):
    """Alerts of a live monitor on prices and volumes, four batches, against the reference's distribution."""
    a, features = Arrivals(t), ["price", "volume"]
    reference = monitor.reference_points(t.ticks.filter(REFERENCE.replace("TIMESTAMP", "TIMESTAMP_NTZ")), features, 100)
    alerts = monitor.drift_monitor(a.stream(), reference, features, window=300, min_samples=150, rules=RULES)
    return rounded(a.table(alerts, "drift-monitor", "update").drop("batch", "message"), 6, "statistic", "p_value")


def checks():
    return [Q.in_range("price", 10, 90), Q.in_range("volume", 1, None)]


@query("stream_dead_letters", f"""WITH {TICKS} SELECT 'good' AS part, count(*) AS n FROM ticks WHERE price BETWEEN 10 AND 90 AND volume >= 1
UNION ALL SELECT 'recovered', count(*) FROM ticks WHERE volume < 1 AND price BETWEEN 10 AND 90 UNION ALL SELECT 'dead', count(*) FROM ticks WHERE NOT price BETWEEN 10 AND 90""")
def _dead(t):
    path = scratch(t.spark, "dead")
    a = Arrivals(t)
    a.run(a.stream(), jobs.with_dead_letters(path, checks()), f"{path}/checkpoint")
    read = lambda p: t.spark.read.parquet(f"{path}/{p}").drop("batch")
    good, dead, archived = jobs.retry_dead_letters(read("dead"), lambda d: d.withColumn("volume", F.greatest("volume", F.lit(1.0))), checks())
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(read("good"), "good").unionByName(count(good, "recovered")).unionByName(count(dead.unionByName(archived), "dead"))


@query("stream_retry", f"""WITH {TICKS}, d AS (SELECT price BETWEEN 10 AND 90 AS priced, volume >= 1 AS traded FROM ticks)
SELECT 'good' AS part, 0 AS attempts, count(*) AS n FROM d WHERE priced AND traded UNION ALL SELECT 'good', 2, count(*) FROM d WHERE priced AND NOT traded
UNION ALL SELECT 'archive', 3, count(*) FROM d WHERE NOT priced UNION ALL SELECT 'failed', 1, count(*) FROM d WHERE NOT (priced AND traded)
UNION ALL SELECT 'failed', 2, count(*) FROM d WHERE NOT priced UNION ALL SELECT 'recovered', 2, count(*) FROM d WHERE priced AND NOT traded
UNION ALL SELECT 'archived', 3, count(*) FROM d WHERE NOT priced""")
def _retry(t):
    """Failing rows wait a minute between attempts; a missing volume heals at the second one, a wrong price never."""
    a, begin = Arrivals(t), datetime(2024, 2, 1)
    queue = RetryQueue(t.spark, scratch(t.spark, "retry"), checks(), lambda d: d.withColumn("volume", F.when(F.col("volume") < 1, F.col("volume") + F.col("attempts") - 1).otherwise(F.col("volume"))))
    a.run(a.stream(), queue.sink(begin), f"{queue.path}/checkpoint")
    for seconds in (30, 60, 90, 120, 180, 240):  # the first, third and last pass find nothing due
        queue.retry(begin + timedelta(seconds=seconds))
    kept = queue.read("good").select(F.lit("good").alias("part"), "attempts").unionByName(queue.read("archive").select(F.lit("archive").alias("part"), "attempts"))
    tried = queue.read("attempts").select(F.col("outcome").alias("part"), F.col("attempt").alias("attempts"), "n")
    return kept.groupBy("part", "attempts").agg(F.count(F.lit(1)).alias("n")).unionByName(tried)


@query("stream_record_log", f"""WITH {TICKS} SELECT tie, 'ticks' AS topic, CAST(user_id % 4 AS INT) AS "partition", row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, tie) - 1 AS "offset", ts AS message_time, symbol, price FROM ticks""")
def _record_log(t):
    """Ticks go through a message log: written by one stream, read by another that starts anew after every part."""
    path, a = scratch(t.spark, "log"), Arrivals(t)
    out = a.stream().select(F.col("exchange").alias("key"), F.to_json(F.struct("tie", "symbol", "price")).alias("value"), F.col("ts").cast("timestamp").alias("timestamp"), "tie")
    sink = log.log_sink(f"{path}/log", "ticks", partition=F.substring(F.col("key").cast("string"), 2, 1).cast("int"), tie="tie")

    def pass_on(df, batch):
        sink(df, batch)
        messages = log.read_log(t.spark, f"{path}/log", "ticks").withColumn("value", F.col("value").cast("string"))
        ticks_ = decode.decode_json(messages, StructType.fromDDL("tie long, symbol string, price double")).select("tie", decode.message_metadata().alias("m"), "symbol", "price")
        jobs.append_sink(ticks_, f"{path}/table", f"{path}/read-checkpoint", every=None).awaitTermination()

    a.run(out, pass_on, f"{path}/checkpoint")
    table = t.spark.read.parquet(f"{path}/table").select("tie", "m.*", "symbol", "price")
    return table.withColumn("message_time", F.col("message_time").cast("timestamp_ntz"))


@query("stream_upsert", f"WITH {TICKS} SELECT symbol, exchange, max(ts) AS ts, arg_max(price, (ts, tie)) AS price FROM ticks GROUP BY 1, 2")
def _upsert(t):
    path = scratch(t.spark, "stream-upsert")
    a = Arrivals(t)
    s = a.stream().select("symbol", "exchange", "ts", "tie", "price", F.col("symbol").alias("part"))
    a.run(s, jobs.upsert_handler(f"{path}/table", ["symbol", "exchange"], ["ts", "tie"], "part"), f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/table").select("symbol", "exchange", "ts", "price")


@query("stream_feature_sink", f"WITH {TICKS} SELECT symbol AS entity_id, count(*) AS n, {R('sum(price)', 3)} AS total FROM ticks GROUP BY 1")
def _feature_sink(t):
    path = scratch(t.spark, "feature-sink")
    a = Arrivals(t)
    a.run(a.stream(), jobs.feature_handler(path, "price", 1, "symbol", "price"), f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/values").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 3).alias("total"))


@query("stream_alert_attach", f"""WITH {TICKS} SELECT tie, symbol, price > 90 AS high_price, volume = 0 AS no_volume FROM ticks WHERE price > 90 OR volume = 0""")
def _attach(t):
    rules = {"high_price": F.col("price") > 90, "no_volume": F.col("volume") == 0}
    a = Arrivals(t)
    s = a.stream().withColumns(rules).filter("high_price OR no_volume").select("tie", "symbol", *rules)
    return a.table(s, "alert-attach").drop("batch")


@query("stream_alert_table", f"""WITH {TICKS} SELECT tie, symbol, 'high_price' AS rule, 'warning' AS severity FROM ticks WHERE price > 90
UNION ALL SELECT tie, symbol, 'no_volume', 'info' FROM ticks WHERE volume = 0""")
def _alert_table(t):
    """Alerts attached to a stream, a row each."""
    path, a = scratch(t.spark, "alerts"), Arrivals(t)
    rules = {"high_price": (F.col("price") > 90, "warning"), "no_volume": (F.col("volume") == 0, "info")}
    a.run(a.stream(), jobs.with_alerts(path, rules, ["tie", "symbol"]), f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/alerts").select("tie", "symbol", "rule", "severity")


@query("stream_quality_history", f"""WITH {TICKS}, b AS (SELECT *, CAST({BATCH_OF} AS INT) AS batch FROM ticks),
g AS (SELECT batch, count(*)::DOUBLE AS n, count(price) AS p, count(volume) AS v, count(DISTINCT tie) AS u, (epoch_us(TIMESTAMP '2024-01-25') - epoch_us(max(ts))) / 3.6e9 AS age FROM b GROUP BY 1),
m AS (SELECT batch, 'completeness' AS metric, 'price' AS "column", p / n AS value FROM g UNION ALL SELECT batch, 'completeness', 'volume', v / n FROM g
  UNION ALL SELECT batch, 'uniqueness', 'tie', u / n FROM g UNION ALL SELECT batch, 'timeliness', 'ts', age FROM g),
j AS (SELECT *, CASE metric WHEN 'timeliness' THEN value > 48 WHEN 'uniqueness' THEN value < 0.95 ELSE value < 0.9 END AS bad FROM m)
SELECT batch, metric, count(*) AS checks, count(*) FILTER (bad) AS failed, {R('avg(value)')} AS mean_value, coalesce(string_agg(CASE WHEN bad THEN "column" END, ',' ORDER BY "column"), '') AS failed_columns
FROM j WHERE batch > 0 GROUP BY 1, 2""")
def _quality_history(t):
    """Reports of the newest three of four batches from the log of their metrics."""
    path, a = scratch(t.spark, "quality-log"), Arrivals(t)
    now = F.lit("2024-01-25").cast("timestamp_ntz")
    a.run(a.stream(), jobs.with_metric_log(f"{path}/log", lambda d: Q.metric_rows(d, ["price", "volume"], ["tie"], "ts", now)), f"{path}/checkpoint")
    return rounded(Q.report_history(t.spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log"), 3), 6, "mean_value")


@query("stream_progress", "SELECT 4 AS batches, count(*) AS input_rows FROM events")
def _progress(t):
    path = scratch(t.spark, "progress")
    handler = jobs.with_metrics(jobs.batch_writer(f"{path}/data"), f"{path}/metrics")
    a = Arrivals(t)
    a.run(a.stream(), handler, f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/metrics").agg(F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("input_rows"))


@query("stream_from_config", f"""WITH {TICKS} SELECT 'accepted' AS part, count(*) AS n, {R("sum(price * volume)", 2)} AS notional FROM ticks WHERE price BETWEEN 10 AND 90 AND volume >= 1
UNION ALL SELECT 'rejected', count(*), NULL FROM ticks WHERE NOT (price BETWEEN 10 AND 90 AND volume >= 1)""")
def _config(t):
    path = scratch(t.spark, "spec")
    raw = ticks(t.events)
    raw.write.parquet(f"{path}/landing/all")
    spec = from_config({"path": f"{path}/landing/*", "sink": f"{path}/sink", "checkpoint": f"{path}/checkpoint"}, raw.schema, checks(),
                       [lambda d: d.withColumn("notional", F.col("price") * F.col("volume"))])
    spec.run(t.spark).awaitTermination()
    a, r = (t.spark.read.parquet(f"{path}/sink/{p}") for p in ("accepted", "rejected"))
    return a.agg(F.lit("accepted").alias("part"), F.count(F.lit(1)).alias("n"), rnd(F.sum("notional"), 2).alias("notional")).unionByName(
        r.agg(F.lit("rejected").alias("part"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("notional")))
