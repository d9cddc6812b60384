"""Registered queries over the shared tables, each with its oracle SQL where SQL can express it.

The flow view: ``events`` as flow rows, the event type as key, errors as attacks, and a fixed
logistic function of the value as the score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import drift, evaluate, flows, net, order, rangejoin, reshape, stats, validate, windows
from ..streaming import replay

HOUR = 3_600_000_000
NET = net.Network(benign=("10.0.0.0/27",), malicious=("10.0.0.64/26",), exception=("10.0.0.5/32", "10.0.0.70/32"))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("daytime"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_type").alias("label_key"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        (1 / (1 + F.exp(-(F.col("value") - 50) / 25))).alias("score"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "user_id",
    )


FLOW = """flow AS (SELECT event_id AS seq, date_trunc('second', ts)::TIMESTAMP AS daytime, epoch_us(ts) AS us, event_type AS label_key,
 CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, 1 / (1 + exp(-(value - 50) / 25)) AS score, value,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id FROM events)"""
_RATIO = lambda a, b: f"round(CASE WHEN {b} <> 0 THEN ({a}) / ({b})::DOUBLE ELSE 0.0 END, 6)"


def confusion_sql(keys: str, source: str, more: str = "") -> str:
    cells = {"tp": "label = 1 AND score >= 0.5", "fn": "label = 1 AND score < 0.5", "fp": "label = 0 AND score >= 0.5", "tn": "label = 0 AND score < 0.5"}
    p = "least(greatest(score, 1e-7), 1 - 1e-7)"
    ratios = {"tp_rate": ("tp", "tp + fn"), "fn_rate": ("fn", "tp + fn"), "fp_rate": ("fp", "fp + tn"), "tn_rate": ("tn", "fp + tn"), "accuracy": ("tp + tn", "flow_num"), "precision": ("tp", "tp + fp"), "f1_score": ("2 * tp", "2 * tp + fp + fn"), "benign_rate": ("tn + fp", "flow_num")}
    return f"""SELECT *, {", ".join(f'{_RATIO(a, b)} AS "{k}"' for k, (a, b) in ratios.items())} FROM (SELECT {keys},
 {", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in cells.items())}, count(*) AS flow_num,
 round(avg(-(label * ln({p}) + (1 - label) * ln(1 - {p}))), 6) AS loss{more} FROM {source} GROUP BY {keys})"""


@query(f"WITH {FLOW} " + confusion_sql("slot", "(SELECT *, date_trunc('day', daytime)::TIMESTAMP AS slot FROM flow)", ", CASE WHEN count(DISTINCT label_key) = 1 THEN min(label_key) ELSE 'mixed:' || count(DISTINCT label_key) END AS keys"))
def flow_eval_buckets(spark, sf_dir):
    """Confusion metrics of daily buckets with their key summary."""
    rows = flow_view(spark, sf_dir).withColumn("slot", F.date_trunc("day", "daytime").cast("timestamp_ntz"))
    return evaluate.confusion(rows, ["slot"], more=[evaluate.key_summary("label_key").alias("keys")])


CADENCE = f"""{FLOW}, s AS (SELECT min(us) AS s FROM flow), b AS (SELECT *, row_number() OVER (ORDER BY us, seq) AS r,
 greatest(0, ceil((us - s) / {HOUR}.0) - 1)::BIGINT AS b FROM flow, s), x AS (SELECT *, (r + least(0, min(b - r) OVER (ORDER BY us, seq ROWS UNBOUNDED PRECEDING)))::BIGINT AS bucket FROM b)"""


def cadenced(spark, sf_dir):
    rows = flow_view(spark, sf_dir)
    start = F.lit(rows.agg(F.min("us")).first()[0])
    return order.cadence(rows, start, HOUR, ["us", "seq"], F.col("us"))


@query(f"WITH {CADENCE} SELECT * FROM (" + confusion_sql("bucket", "x") + ") WHERE bucket < (SELECT max(bucket) FROM x)")
def eval_cadence_lagged(spark, sf_dir):
    """Metrics of lagging hourly evaluations; the trailing bucket isn't flushed."""
    found = evaluate.confusion(cadenced(spark, sf_dir).drop("k"), ["bucket"])
    last = found.agg(F.max("bucket").alias("_last"))
    return found.join(F.broadcast(last), F.col("bucket") < F.col("_last")).drop("_last")  # one row


@query(f"""WITH {FLOW}, m AS (SELECT label_key, date_trunc('day', daytime)::TIMESTAMP AS slot, count(*) AS flow_num, count(*) FILTER (WHERE label = 0) / count(*)::DOUBLE AS benign_rate FROM flow GROUP BY ALL)
 SELECT label_key, slot, flow_num, round(CASE WHEN max(flow_num) OVER w > min(flow_num) OVER w THEN (flow_num - min(flow_num) OVER w) / (max(flow_num) OVER w - min(flow_num) OVER w)::DOUBLE ELSE 0.0 END, 6) AS nmr_fn_rate,
 round(CASE WHEN max(benign_rate) OVER w > min(benign_rate) OVER w THEN (benign_rate - min(benign_rate) OVER w) / (max(benign_rate) OVER w - min(benign_rate) OVER w) ELSE 0.0 END, 6) AS nmr_benign_rate FROM m WINDOW w AS (PARTITION BY label_key)""")  # fmt: skip
def eval_minmax_norm(spark, sf_dir):
    rows = flow_view(spark, sf_dir).groupBy("label_key", F.date_trunc("day", "daytime").cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("flow_num"), (F.count_if(F.col("label") == 0) / F.count("*")).alias("benign_rate"))
    return evaluate.min_max(rows, {"flow_num": "nmr_fn_rate", "benign_rate": "nmr_benign_rate"}, ["label_key"]).drop("benign_rate")


def records(spark, sf_dir):
    """Connection records from events: addresses of user and event number, some times and addresses bad."""
    e = table(spark, sf_dir, "events")
    orig = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    resp = F.when(F.col("event_id") % 11 == 0, "not-an-ip").when(F.col("event_id") % 13 != 0, F.concat(F.lit("10.0.0."), (F.col("event_id") % 256).cast("string")))
    return e.select(F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.col("event_id").cast("string")).alias("ts"), orig.alias("id.orig_h"), resp.alias("id.resp_h"), F.col("event_id").alias("uid"), (F.col("value") / 10).alias("duration"))


RECORDS = """r AS (SELECT event_id AS uid, value, event_id % 17 = 0 AS bad, user_id % 256 AS o, CASE WHEN event_id % 11 = 0 THEN -1 WHEN event_id % 13 <> 0 THEN event_id % 256 END AS d FROM events),
 l AS (SELECT *, d IS NOT NULL AND (o IN (5, 70) OR d IN (5, 70)) AS ex, CASE WHEN d IS NULL THEN NULL WHEN o BETWEEN 64 AND 127 OR d BETWEEN 64 AND 127 THEN 1 WHEN (o BETWEEN 0 AND 31) <> (d BETWEEN 0 AND 31) THEN 0 END AS lab FROM r)"""


@query(f"WITH {RECORDS} SELECT CASE WHEN bad THEN 'invalid_ts' WHEN ex THEN 'excluded' WHEN lab IS NULL THEN 'unlabeled' ELSE 'emitted' END AS reason, count(*) AS n FROM l GROUP BY 1")
def label_reason_counts(spark, sf_dir):
    return flows.reason_counts(records(spark, sf_dir), NET)


@query(f"WITH {RECORDS} SELECT uid, lab AS label, coalesce(value / 10, 0.0) AS duration, strftime(make_timestamp(floor(uid + coalesce(value / 10, 0.0))::BIGINT * 1000000) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS daytime, '' AS orig_bytes FROM l WHERE NOT bad AND NOT ex AND lab IS NOT NULL")
def cidr_label(spark, sf_dir):
    return flows.labelled_flows(records(spark, sf_dir), NET).select("uid", "label", "duration", "daytime", "orig_bytes")


@query("""WITH p AS (SELECT event_id AS seq, user_id % 256 AS o, (event_id * 7) % 256 AS d, event_id % 1000 AS a, event_id % 2000 AS b FROM events),
 c AS (SELECT *, CASE WHEN o BETWEEN 64 AND 127 THEN 1 WHEN d BETWEEN 64 AND 127 THEN 2 WHEN o < 32 AND NOT d < 32 THEN 3 WHEN d < 32 AND NOT o < 32 THEN 4 END AS k FROM p)
 SELECT seq, CASE WHEN k IN (1, 3) THEN '10.0.0.' || d || '|10.0.0.' || o ELSE '10.0.0.' || o || '|10.0.0.' || d END AS pair, CASE WHEN k IN (1, 3) THEN 'snd' ELSE 'rcv' END AS direction, CASE WHEN k IN (1, 3) THEN a ELSE b END AS port, (k < 3)::INTEGER AS label FROM c WHERE k IS NOT NULL""")
def packet_classes(spark, sf_dir):
    """Pair, direction, port and label of packets by their addresses."""
    e = table(spark, sf_dir, "events")
    address = lambda c: F.concat(F.lit("10.0.0."), (c % 256).cast("string"))
    packets = e.select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), address(F.col("user_id")).alias("src"), address(F.col("event_id") * 7).alias("dst"), F.lit("tcp").alias("protocol"), (F.col("event_id") % 1000).alias("src_port"), (F.col("event_id") % 2000).alias("dst_port"), F.lit(60).alias("length"))
    return flows.classified(packets, NET).select("seq", "pair", "direction", "port", "label")


@query(f"""WITH {RECORDS} SELECT uid, CASE WHEN o BETWEEN 64 AND 127 THEN 'outbound' WHEN d BETWEEN 64 AND 127 THEN 'inbound' WHEN o BETWEEN 0 AND 31 AND NOT coalesce(d BETWEEN 0 AND 31, false) THEN 'outbound'
 WHEN d BETWEEN 0 AND 31 AND NOT o BETWEEN 0 AND 31 THEN 'inbound' ELSE 'unknown' END AS direction FROM l""")
def direction_classify(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("uid", net.direction(F.col("`id.orig_h`"), F.col("`id.resp_h`"), NET).alias("direction"))


@query(f"WITH {FLOW} SELECT seq, daytime + (TIMESTAMP '2022-02-01 09:03:59' - (SELECT min(daytime) FROM flow)) AS daytime FROM flow")
def time_shift(spark, sf_dir):
    return reshape.shifted(flow_view(spark, sf_dir).select("seq", "daytime"), F.lit("2022-02-01 09:03:59").cast("timestamp_ntz"))


@query(f"WITH {FLOW} SELECT seq, daytime, CASE WHEN seq % 2 = 0 THEN 'A' ELSE 'B' END AS side, row_number() OVER (ORDER BY daytime, seq % 2, seq) AS rn FROM flow")
def ordered_merge(spark, sf_dir):
    rows = flow_view(spark, sf_dir).select("seq", "daytime")
    return reshape.ordered_merge(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), place="rn")


@query(f"""WITH {FLOW}, a AS (SELECT seq, daytime, 'A' AS side FROM flow WHERE seq % 2 = 0), b AS (SELECT seq, daytime, 'B' AS side FROM flow WHERE seq % 2 = 1)
, m AS (SELECT * FROM a UNION ALL SELECT seq, daytime + ((SELECT min(daytime) FROM a) - (SELECT min(daytime) FROM b)), side FROM b) SELECT *, row_number() OVER (ORDER BY daytime, side, seq) AS rn FROM m""")
def align_mix(spark, sf_dir):
    rows = flow_view(spark, sf_dir).select("seq", "daytime")
    a, b = rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")
    return reshape.align_mix(a, b, place="rn")


@query(f"""WITH {FLOW}, n AS (SELECT seq, daytime, row_number() OVER (ORDER BY daytime, seq) AS rn FROM flow), c AS (SELECT *, (rn - 1) // 3000 AS chunk FROM n)
 SELECT seq, rn, chunk, lpad(chunk::VARCHAR, 5, '0') || '_' || strftime(min(daytime) OVER (PARTITION BY chunk), '%Y%m%d%H%M%S') || '.csv' AS file FROM c""")
def chunk_ids(spark, sf_dir):
    rows = flow_view(spark, sf_dir).select("seq", "daytime")
    return reshape.chunked(rows, 3000, ["daytime", "seq"]).select("seq", "rn", "chunk", "file")


@query(f"""WITH {FLOW}, t AS (SELECT seq, daytime, row_number() OVER (ORDER BY daytime, seq) - 1 AS i FROM flow WHERE label = 0), s AS (SELECT seq, row_number() OVER (ORDER BY daytime, seq) - 1 AS k FROM flow WHERE label = 1 AND daytime < (SELECT min(daytime) FROM flow WHERE label = 1) + INTERVAL 24 HOUR)
 SELECT seq, daytime, 2 * i AS ord FROM t UNION ALL SELECT s.seq, t.daytime, 2 * i + 1 FROM t JOIN s ON t.i % (SELECT count(*) FROM s) = s.k""")  # fmt: skip
def cyclic_injection(spark, sf_dir):
    rows = flow_view(spark, sf_dir).select("seq", "daytime", "label")
    attacks = rows.filter("label = 1")
    first = attacks.agg(F.min("daytime")).first()[0]
    source = attacks.filter(F.col("daytime") < F.lit(first) + F.expr("INTERVAL 24 HOUR"))
    return reshape.injected(rows.filter("label = 0").drop("label"), source.drop("label"), ["daytime", "seq"])


@query(f"WITH {FLOW} SELECT seq, daytime FROM flow WHERE daytime >= TIMESTAMP '2024-01-05 00:00:00' AND daytime < TIMESTAMP '2024-01-09 12:00:00'")
def time_range_filter(spark, sf_dir):
    return reshape.time_range(flow_view(spark, sf_dir).select("seq", "daytime"), F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09 12:00:00").cast("timestamp_ntz"))


@query(f"WITH {FLOW} SELECT seq FROM flow WHERE NOT (daytime < (SELECT min(daytime) FROM flow) + INTERVAL 3 DAY AND label = 1)")
def delete_labelled_before(spark, sf_dir):
    return reshape.without_early_attacks(flow_view(spark, sf_dir), F.expr("INTERVAL 3 DAY")).select("seq")


@query(f"""WITH {FLOW}, v AS (SELECT 'value' AS feature, value AS v FROM flow UNION ALL SELECT 'k', k FROM flow)
 SELECT feature, count(v) AS observed, count(*) - count(v) AS missing, round(min(v), 6) AS least, round(max(v), 6) AS largest, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation FROM v GROUP BY feature""")
def feature_stats(spark, sf_dir):
    return stats.feature_stats(flow_view(spark, sf_dir), ["value", "k"])


@query(f"WITH {FLOW} SELECT date_trunc('hour', daytime)::TIMESTAMP AS slot, count(*) AS n FROM flow GROUP BY 1")
def time_bucket_counts(spark, sf_dir):
    return stats.time_counts(flow_view(spark, sf_dir), "hour")


@query(f"WITH {FLOW} SELECT label_key, label, count(*) AS n FROM flow GROUP BY ALL")
def label_counts(spark, sf_dir):
    return flow_view(spark, sf_dir).groupBy("label_key", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {FLOW}, f AS (SELECT us // 1000000 // 600 AS slot, round(sum(value), 4) AS total, count(*) AS n, count(DISTINCT user_id) AS users FROM flow GROUP BY 1)
 SELECT g.slot, coalesce(f.total, 0.0) AS total, coalesce(n, 0) AS n, coalesce(users, 0) AS users FROM (SELECT unnest(range((SELECT min(slot) FROM f), (SELECT max(slot) FROM f) + 1)) AS slot) g LEFT JOIN f USING (slot)""")
def minute_histogram_gapfill(spark, sf_dir):
    found = [F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"), F.countDistinct("user_id").alias("users")]
    return stats.gap_filled(table(spark, sf_dir, "events"), 600, "ts", found, {"total": 0.0, "n": 0, "users": 0})


@query(f"""WITH {FLOW} SELECT seq, count(*) OVER (PARTITION BY label_key ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS cw,
 count(*) OVER (PARTITION BY label_key ORDER BY us RANGE BETWEEN {96 * HOUR} PRECEDING AND {24 * HOUR + 1} PRECEDING) AS pw FROM flow""")
def dual_window_counts(spark, sf_dir):
    return windows.dual_window(flow_view(spark, sf_dir), "label_key", "us", 24 * HOUR, 72 * HOUR).select("seq", "cw", "pw")


@query(f"WITH {FLOW} SELECT seq, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean FROM flow WINDOW w AS (PARTITION BY label_key ORDER BY us RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW)")
def trailing_window(spark, sf_dir):
    return windows.trailing(flow_view(spark, sf_dir), "label_key", "us", 12 * HOUR, "value").select("seq", "n", "mean")


@query("""SELECT make_timestamp((b - o) * 3600000000) AS "start", make_timestamp((b - o + 4) * 3600000000) AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean
 FROM (SELECT *, epoch_us(ts) // 3600000000 AS b FROM events), (SELECT unnest(range(0, 4)) AS o) GROUP BY ALL""")
def hopping_window(spark, sf_dir):
    return windows.hopping(table(spark, sf_dir, "events"), "ts", "4 hours", "1 hour", [F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")], ("event_type",))


@query("SELECT event_id, coalesce(ts < a, false) AS in_file FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS a, lag(ts) OVER (ORDER BY user_id, value, event_id) AS b FROM events) WHERE ts < b")
def time_order_violations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("place", F.struct("value", "event_id"))
    return windows.order_violations(e, "user_id", "place", "ts").select("event_id", "in_file")


def texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    blank = lambda n, x: F.when(F.col("event_id") % n == 0, "").otherwise(x)
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("row"), blank(29, F.when(F.col("event_id") % 47 == 0, "noon").otherwise(F.date_format(F.when(F.col("event_id") % 53 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")), "yyyy-MM-dd HH:mm:ss"))).alias("daytime"), blank(31, (F.col("event_id") % 3).cast("string")).alias("label"), F.col("event_type").alias("conn_state"), F.when(F.col("event_id") % 37 == 0, "x").otherwise(F.col("value").cast("string")).alias("duration"), blank(41, F.when(F.col("event_id") % 43 == 0, "maybe").otherwise("T")).alias("local_orig"))


@query("""SELECT 'required_columns' AS "check", count(*) FILTER (WHERE event_id % 29 = 0) + count(*) FILTER (WHERE event_id % 31 = 0) + count(*) FILTER (WHERE event_id % 41 = 0) AS n, 'NG' AS status FROM events
 UNION ALL SELECT 'daytime_format', count(*) FILTER (WHERE event_id % 47 = 0 AND event_id % 29 <> 0), 'NG' FROM events
 UNION ALL SELECT 'time_order', count(*) FILTER (WHERE t < a) + count(*) FILTER (WHERE t < b), 'NG' FROM (SELECT t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS a, lag(t) OVER (ORDER BY user_id, event_id) AS b FROM (SELECT user_id, event_id, date_trunc('second', ts - CASE WHEN event_id % 53 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END) AS t FROM events WHERE event_id % 29 <> 0 AND event_id % 47 <> 0))
 UNION ALL SELECT 'label_value', count(*) FILTER (WHERE event_id % 31 <> 0 AND event_id % 3 = 2), 'NG' FROM events
 UNION ALL SELECT 'value_types', count(*) FILTER (WHERE event_id % 37 = 0) + count(*) FILTER (WHERE event_id % 43 = 0 AND event_id % 41 <> 0), 'NG' FROM events""")
def check_rollup(spark, sf_dir):
    return validate.roll_up(validate.problems(texts(spark, sf_dir)))


@query(f"""WITH {FLOW} SELECT seq, round(ln(1 + value / 1000), 6) AS log_value, round(ln(1 + k), 6) AS log_k, CASE WHEN user_id * 400 <= 1023 THEN 0.0 WHEN user_id * 400 <= 49151 THEN 0.5 ELSE 1.0 END::DOUBLE AS port, round(value / 60, 6) AS "interval", round(value / 10000, 6) AS length FROM flow""")
def feature_scaling(spark, sf_dir):
    r = flow_view(spark, sf_dir)
    return r.select("seq", F.round(scalars.scaled_count(F.col("value")), 6).alias("log_value"), F.round(scalars.scaled_duration(F.col("k")), 6).alias("log_k"), scalars.port_bucket(F.col("user_id") * 400).alias("port"), F.round(scalars.scaled_interval(F.col("value")), 6).alias("interval"), F.round(scalars.scaled_length(F.col("value")), 6).alias("length"))


NEIGHBOURS = """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id % 100 <> 0),
 d AS (SELECT vec_id, neighbour, {score} AS score FROM q, p), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {order}, neighbour) AS "rank" FROM d)"""
L2 = NEIGHBOURS.format(score="list_sum(list_transform(list_zip(e, f), lambda x: (x[1] - x[2]) * (x[1] - x[2])))", order="score")
COSINE = NEIGHBOURS.format(score="list_cosine_similarity(e, f)", order="score DESC")


def sides(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 100 = 0"), e.filter("vec_id % 100 <> 0")


ALL = lambda sql: sql.replace("embeddings WHERE vec_id % 100 <> 0", "embeddings").replace("FROM q, p)", "FROM q, p WHERE vec_id <> neighbour)")


@query(ALL(COSINE) + ' SELECT vec_id, neighbour, "rank"::INTEGER AS "rank", round(score, 4) AS score FROM t WHERE "rank" <= 8')
def knn_cosine_all(spark, sf_dir):
    """The stated queries against all other rows by cosine."""
    found = drift.nearest(sides(spark, sf_dir)[0], table(spark, sf_dir, "embeddings"), 8, "cosine", itself=False)
    return found.select("vec_id", "neighbour", "rank", F.round("score", 4).alias("score"))


@query()
def knn_ivf(spark, sf_dir):
    """The stated queries against all other rows, approximately.  These vectors hardly cluster, so 36 of 48 cells are searched; the recall is 0.95 or more."""
    rows = table(spark, sf_dir, "embeddings")
    found = drift.approximate_nearest(sides(spark, sf_dir)[0], rows, drift.inverted_index(rows, 48), 8, 36, itself=False)
    return found.select("vec_id", "neighbour", "rank", F.round("score", 4).alias("score"))


@query(ALL(L2) + ' SELECT vec_id, "rank"::INTEGER AS "rank", round(score, 4) AS score FROM t WHERE "rank" <= 8')
def knn_l2(spark, sf_dir):
    return knn_l2_all(spark, sf_dir).drop("neighbour")


@query(ALL(L2) + ' SELECT vec_id, neighbour, "rank"::INTEGER AS "rank", round(score, 4) AS score FROM t WHERE "rank" <= 8')
def knn_l2_all(spark, sf_dir):
    """The stated queries against all other rows by squared distance."""
    found = drift.nearest(sides(spark, sf_dir)[0], table(spark, sf_dir, "embeddings"), 8, itself=False)
    return found.select("vec_id", "neighbour", "rank", F.round("score", 4).alias("score"))


@query(L2 + ' SELECT round(avg(score), 4) AS score, avg(score) > 0.025 AND (SELECT count(*) FROM q) >= 8 AND (SELECT count(*) FROM p) >= 8 AS detected FROM t WHERE "rank" <= 8')
def knn_l2_drift(spark, sf_dir):
    return drift.drift_score(*sides(spark, sf_dir), 8, 0.025)


@query(COSINE + ' SELECT round(avg(score), 4) AS score, avg(score) < 0.9 AND (SELECT count(*) FROM q) >= 8 AND (SELECT count(*) FROM p) >= 8 AS detected FROM t WHERE "rank" <= 8')
def knn_cosine_drift(spark, sf_dir):
    return drift.drift_score(*sides(spark, sf_dir), 8, 0.9, "cosine")


def halves(spark, sf_dir):
    return flow_view(spark, sf_dir).withColumn("early", F.col("daytime") < F.lit("2024-01-16").cast("timestamp_ntz"))


@query(f"""WITH {FLOW}, v AS (SELECT label_key, value AS v, count(*) FILTER (WHERE daytime < TIMESTAMP '2024-01-16') AS a, count(*) FILTER (WHERE daytime >= TIMESTAMP '2024-01-16') AS b FROM flow GROUP BY ALL),
 g AS (SELECT label_key, abs(sum(a) OVER u / sum(a) OVER k - sum(b) OVER u / sum(b) OVER k) AS g, lead(v) OVER u - v AS w FROM v WINDOW u AS (PARTITION BY label_key ORDER BY v), k AS (PARTITION BY label_key))
 SELECT label_key, round(max(g), 6) AS ks, round(sum(g * coalesce(w, 0)), 6) AS wasserstein FROM g GROUP BY 1""")
def ks_wasserstein(spark, sf_dir):
    return stats.cdf_distances(halves(spark, sf_dir), ["label_key"], "value", "early")


@query(f"""WITH {FLOW}, h AS (SELECT label_key, value, daytime < TIMESTAMP '2024-01-16' AS early FROM flow), e AS (SELECT label_key, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 50 AS step FROM h WHERE early GROUP BY 1),
 c AS (SELECT label_key, least(floor((value - lo) / step), 49)::INTEGER AS bin, count(*) FILTER (WHERE early) AS a, count(*) FILTER (WHERE NOT early) AS b FROM h JOIN e USING (label_key) WHERE value BETWEEN lo AND hi GROUP BY ALL),
 f AS (SELECT e.label_key, step, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM e CROSS JOIN (SELECT unnest(range(0, 50)) AS bin) g LEFT JOIN c ON c.label_key = e.label_key AND c.bin = g.bin),
 d AS (SELECT label_key, a / (sum(a) OVER w * step) + 1e-10 AS p, b / (sum(b) OVER w * step) + 1e-10 AS q FROM f WINDOW w AS (PARTITION BY label_key)), n AS (SELECT label_key, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM d WINDOW w AS (PARTITION BY label_key))
 SELECT label_key, round(sum(p * ln(p / q)), 6) AS kl FROM n GROUP BY 1""")  # fmt: skip
def kl_histogram(spark, sf_dir):
    return stats.histogram_kl(halves(spark, sf_dir), ["label_key"], "value", "early")


@query(f"""WITH {FLOW}, d AS (SELECT label_key, date_trunc('day', daytime) AS day, avg(value) AS a, avg(k) AS b FROM flow GROUP BY ALL),
 z AS (SELECT label_key, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS b FROM d WINDOW w AS (PARTITION BY label_key)) SELECT label_key, round(max((a + b) / 2), 6) AS top FROM z GROUP BY 1""")
def zscore_mean(spark, sf_dir):
    rows = flow_view(spark, sf_dir).groupBy("label_key", F.date_trunc("day", "daytime").alias("day")).agg(F.avg("value").alias("a"), F.avg("k").alias("b"))
    return stats.zscores(rows, ["a", "b"], ["label_key"]).groupBy("label_key").agg(F.round(F.max((F.col("a") + F.col("b")) / 2), 6).alias("top"))


@query(f"WITH {FLOW} SELECT label_key, round(corr(value, k), 6) AS value_k, round(corr(value, user_id), 6) AS value_user_id FROM flow GROUP BY 1")
def pearson_matrix(spark, sf_dir):
    return stats.correlations(flow_view(spark, sf_dir), ["label_key"], [("value", "k"), ("value", "user_id")])


@query(f"""WITH {FLOW}, e AS (SELECT seq, us // 1000000 AS s FROM flow), t AS (SELECT us // 1000000 AS tick, k FROM flow WHERE label = 1)
 SELECT seq, s, coalesce(sum(k), 0.0) AS cost FROM e LEFT JOIN t ON tick >= s - 1800 AND tick < s + 1800 GROUP BY ALL""")
def training_cost_range_join(spark, sf_dir):
    """The training cost within half an hour of every event."""
    rows = flow_view(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1_000_000))
    return rangejoin.range_sum(rows.select("seq", "s"), rows.filter("label = 1").select(F.col("s").alias("at"), "k"), "seq", "s", "at", "k", 1800, 1800)


@query(f"""WITH {FLOW}, t AS (SELECT us // 1000000 AS tick, sum(value) AS v FROM flow WHERE label_key = 'click' GROUP BY 1) SELECT seq, us // 1000000 AS s, round(coalesce(sum(v), 0.0), 4) AS cost FROM flow LEFT JOIN t ON tick >= us // 1000000 - 600 AND tick < us // 1000000 + 60 GROUP BY ALL""")
def training_cost_all(spark, sf_dir):
    """The value of clicks from ten minutes before to a minute after every event: a range that isn't even."""
    rows = flow_view(spark, sf_dir).withColumn("s", F.floor(F.col("us") / 1_000_000))
    found = rangejoin.range_sum(rows.select("seq", "s"), rows.filter("label_key = 'click'").select(F.col("s").alias("at"), "value"), "seq", "s", "at", "value", 600, 60)
    return found.withColumn("cost", F.round("cost", 4))


@query(f"""WITH {FLOW}, a AS (SELECT date_trunc('hour', daytime)::TIMESTAMP AS slot, count(*) AS n_error FROM flow WHERE label = 1 GROUP BY 1), b AS (SELECT date_trunc('hour', daytime)::TIMESTAMP AS slot, count(*) AS n_click FROM flow WHERE label_key = 'click' GROUP BY 1) SELECT slot, n_error, n_click FROM a FULL JOIN b USING (slot)""")
def result_outer_join(spark, sf_dir):
    r = flow_view(spark, sf_dir).withColumn("slot", F.date_trunc("hour", "daytime").cast("timestamp_ntz"))
    part = lambda c, n: r.filter(c).groupBy("slot").agg(F.count("*").alias(n))
    return part("label = 1", "n_error").join(part("label_key = 'click'", "n_click"), "slot", "full_outer")


@query(f"""WITH {FLOW}, a AS (SELECT row_number() OVER (ORDER BY us, seq) AS rn, seq AS error_seq FROM flow WHERE label = 1), b AS (SELECT row_number() OVER (ORDER BY us, seq) AS rn, seq AS click_seq FROM flow WHERE label_key = 'click') SELECT rn, error_seq, click_seq FROM a FULL JOIN b USING (rn)""")
def positional_zip(spark, sf_dir):
    r = flow_view(spark, sf_dir)
    part = lambda c, n: order.global_row_number(r.filter(c), ["us", "seq"]).select("rn", F.col("seq").alias(n))
    return part("label = 1", "error_seq").join(part("label_key = 'click'", "click_seq"), "rn", "full_outer")


@query(f"WITH {FLOW} SELECT seq, value, NULL::DOUBLE AS k FROM flow WHERE label = 1 UNION ALL SELECT seq, NULL, k FROM flow WHERE label_key = 'click'")
def union_missing_columns(spark, sf_dir):
    r = flow_view(spark, sf_dir)
    return r.filter("label = 1").select("seq", "value").unionByName(r.filter("label_key = 'click'").select("seq", "k"), allowMissingColumns=True)


@query(f"WITH {FLOW} SELECT DISTINCT date_trunc('hour', daytime)::TIMESTAMP AS slot FROM flow WHERE label = 1")
def distinct_times(spark, sf_dir):
    return flow_view(spark, sf_dir).filter("label = 1").select(F.date_trunc("hour", "daytime").cast("timestamp_ntz").alias("slot")).distinct()


@query("SELECT user_id, name FROM (SELECT DISTINCT user_id, regexp_replace(trim(event_type || '/' || user_id), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM events)")
def safe_key_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", scalars.safe_name(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))).alias("name")).distinct()


def packet_view(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("pair"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600).alias("ts"), F.when(F.col("event_id") % 3 == 0, "snd").otherwise("rcv").alias("direction"), F.when(F.col("event_id") % 2 == 0, "tcp").otherwise("udp").alias("protocol"), (F.col("event_id") % 5).cast("int").alias("port"), F.col("value").cast("long").alias("length"), F.lit(0).alias("label"))


PACKETS = """RECURSIVE p AS (SELECT user_id::VARCHAR AS pair, event_id AS seq, epoch_us(ts) / 1e6 / 600 AS ts, event_id % 3 <> 0 AS rcv, event_id % 2 = 0 AS tcp, event_id % 5 AS port, trunc(value)::BIGINT AS length FROM events),
 s AS (SELECT pair, min(ts) AS start FROM p GROUP BY 1 UNION ALL SELECT p.pair, min(p.ts) FROM s JOIN p ON p.pair = s.pair AND p.ts - s.start > 60 GROUP BY p.pair),
 f AS (SELECT p.*, s.start FROM p ASOF JOIN s ON p.pair = s.pair AND p.ts >= s.start),
 g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY pair, start, rcv ORDER BY ts, seq) AS gap, row_number() OVER (PARTITION BY pair, start, rcv, port ORDER BY ts, seq) AS nth FROM f)"""


@query(f"""WITH {PACKETS}, m AS (SELECT pair, start, port FROM (SELECT *, row_number() OVER (PARTITION BY pair, start ORDER BY nth DESC, ts, seq) AS r FROM g WHERE rcv) WHERE r = 1)
 SELECT pair, start, count(*) AS n, count(*) FILTER (WHERE rcv) AS n_rcv, count(*) FILTER (WHERE NOT rcv) AS n_snd, count(*) FILTER (WHERE tcp) AS tcp, count(*) FILTER (WHERE NOT tcp) AS udp, coalesce(any_value(m.port), 0) AS most_port, count(DISTINCT g.port) FILTER (WHERE rcv) AS port_count,
 {", ".join(f"coalesce(max(length) FILTER (WHERE {c}), 0) AS {s}_max_length, coalesce(min(length) FILTER (WHERE {c}), -10000) AS {s}_min_length, coalesce(max(gap) FILTER (WHERE {c}), 60.0) AS {s}_max_interval, coalesce(min(gap) FILTER (WHERE {c}), 60.0) AS {s}_min_interval" for s, c in (("rcv", "rcv"), ("snd", "NOT rcv")))}, 0 AS label
 FROM g LEFT JOIN m USING (pair, start) GROUP BY pair, start HAVING (SELECT max(ts) FROM p) > start + 60""")  # fmt: skip
def packet_flows(spark, sf_dir):
    """Flows of packets with a maximum age."""
    return flows.packet_flows(packet_view(spark, sf_dir))


def _replay(spark, sf_dir, mode, **settings):
    rows = flow_view(spark, sf_dir).select(F.col("label_key").alias("key"), "seq", (F.col("us") / 1e6).alias("t"), (F.col("k") > 80).cast("int").alias("label"), scalars.scaled_count(F.col("value")).alias("x"), (F.col("k") / 100).alias("y"))
    return replay.replay(rows, ["x", "y"], mode, **settings).withColumn("score", F.round("score", 6))


#: The daily clock, then one recursive row a key and step of Adam on the rows of a round, then the scores before each row.
STATIC = f"""WITH RECURSIVE {FLOW.removeprefix("WITH ")}, s AS (SELECT min(us) AS s FROM flow),
 n AS (SELECT label_key AS key, seq, us, (k > 80)::INTEGER AS label, ln(1 + value / 1000) AS x, k / 100 AS y, row_number() OVER (ORDER BY us, seq) AS r, greatest(0, ceil((us - s) / {24 * HOUR}.0) - 1)::BIGINT AS b FROM flow, s),
 c AS (SELECT *, (r + least(0, min(b - r) OVER (ORDER BY us, seq ROWS UNBOUNDED PRECEDING)))::BIGINT AS round FROM n),
 t AS MATERIALIZED (SELECT *, coalesce(lag(round) OVER (ORDER BY us, seq), 0) AS version FROM c),
 good AS MATERIALIZED (SELECT key, round, label, x, y FROM t WHERE x IS NOT NULL AND y IS NOT NULL AND label IS NOT NULL AND round < (SELECT max(round) FROM t)),
 a AS (SELECT DISTINCT key, 0::BIGINT AS step, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v, 0.0::DOUBLE AS u, 0.0::DOUBLE AS mw, 0.0::DOUBLE AS mv, 0.0::DOUBLE AS mu, 0.0::DOUBLE AS qw, 0.0::DOUBLE AS qv, 0.0::DOUBLE AS qu, 0::BIGINT AS n FROM t
  UNION ALL SELECT key, step + 1, {", ".join(f"CASE WHEN c > 0 THEN {p} - 0.001 * sqrt(1 - 0.999 ^ (n + 1)) / (1 - 0.9 ^ (n + 1)) * (0.9 * m{p} + 0.1 * g{p}) / (sqrt(0.999 * q{p} + 0.001 * g{p} * g{p}) + 1e-7) ELSE {p} END" for p in "wvu")},
   {", ".join(f"CASE WHEN c > 0 THEN 0.9 * m{p} + 0.1 * g{p} ELSE m{p} END" for p in "wvu")}, {", ".join(f"CASE WHEN c > 0 THEN 0.999 * q{p} + 0.001 * g{p} * g{p} ELSE q{p} END" for p in "wvu")}, CASE WHEN c > 0 THEN n + 1 ELSE n END
  FROM (SELECT a.key, step, any_value(w) AS w, any_value(v) AS v, any_value(u) AS u, any_value(mw) AS mw, any_value(mv) AS mv, any_value(mu) AS mu, any_value(qw) AS qw, any_value(qv) AS qv, any_value(qu) AS qu, any_value(n) AS n, count(label) AS c,
   sum((1 / (1 + exp(-(w * x + v * y + u))) - label) * x) / count(label) AS gw, sum((1 / (1 + exp(-(w * x + v * y + u))) - label) * y) / count(label) AS gv, sum(1 / (1 + exp(-(w * x + v * y + u))) - label) / count(label) AS gu
   FROM a LEFT JOIN good g ON g.key = a.key AND g.round = step // 20 WHERE step < 20 * (SELECT max(round) FROM t) GROUP BY a.key, step))
 SELECT t.key, seq, label, round(1 / (1 + exp(-(w * x + v * y + u))), 6) AS score, (1 / (1 + exp(-(w * x + v * y + u))) >= 0.5)::INTEGER AS vote, round > version AS retrained FROM t JOIN a ON a.key = t.key AND a.step = 20 * version"""


@query(STATIC)
def replay_static(spark, sf_dir):
    """Scores of models that a daily clock retrains on the day's rows, 20 steps each."""
    return _replay(spark, sf_dir, "st", interval=86400.0)


@query()
def replay_dynamic(spark, sf_dir):
    return _replay(spark, sf_dir, "dy", interval=43200.0, current=86400.0, past=259200.0, theta=0.0001)


@query(f"WITH {FLOW} SELECT label_key AS key, seq, (k > 80)::INTEGER AS label, 0.5::DOUBLE AS score, 1 AS vote, false AS retrained FROM flow")
def replay_none(spark, sf_dir):
    """Scores of a model that is never trained: logistic regression with weights 0."""
    return _replay(spark, sf_dir, "nt")
