"""Registered queries of summaries, comparisons, sessions and packets; see ``catalogue`` for the tables they view."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import profile, session, stats, windows
from .catalogue import FLOW, HOUR, flow_view, query, table, texts

HOURLY = "date_trunc('hour', daytime)::TIMESTAMP AS slot"


def hourly(spark, sf_dir):
    return flow_view(spark, sf_dir).withColumn("slot", F.date_trunc("hour", "daytime").cast("timestamp_ntz"))


@query(f"""WITH {FLOW}, a AS (SELECT {HOURLY}, count(*) AS n_error FROM flow WHERE label = 1 GROUP BY 1), b AS (SELECT {HOURLY}, count(*) AS n_click FROM flow WHERE label_key = 'click' GROUP BY 1) SELECT slot, n_error, n_click FROM a JOIN b USING (slot)""")
def inner_join_on_time(spark, sf_dir):
    r = hourly(spark, sf_dir)
    part = lambda c, n: r.filter(c).groupBy("slot").agg(F.count("*").alias(n))
    return part("label = 1", "n_error").join(part("label_key = 'click'", "n_click"), "slot")


@query(f"""WITH {FLOW}, v AS (SELECT label_key, count(*) AS flow_num, count(*) FILTER (WHERE label = 0) AS benign_count, count(*) FILTER (WHERE label = 1) AS malicious_count FROM flow WHERE k IS NOT NULL AND value IS NOT NULL GROUP BY 1) SELECT * FROM v""")
def training_set_counts(spark, sf_dir):
    return profile.training_counts(flow_view(spark, sf_dir), ["k", "value"], keys=("label_key",))


@query(f"""WITH {FLOW} SELECT user_id::VARCHAR AS file, count(*) AS n, min(daytime) AS first, max(daytime) AS last FROM flow GROUP BY 1 UNION ALL SELECT NULL, count(*), min(daytime), max(daytime) FROM flow""")
def file_and_global_summary(spark, sf_dir):
    r = flow_view(spark, sf_dir).withColumn("file", F.col("user_id").cast("string"))
    return profile.span_summary(r, keys=("file",)).unionByName(profile.span_summary(r).withColumn("file", F.lit(None).cast("string")))


@query(f"WITH {FLOW}, c AS (SELECT user_id, count(*) AS n FROM flow GROUP BY 1) SELECT count(*) AS files, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM c")
def rows_per_file(spark, sf_dir):
    return profile.rows_per_file(flow_view(spark, sf_dir), "user_id")


@query("""SELECT 'daytime' AS "column", count(*) FILTER (WHERE event_id % 29 = 0) AS missing FROM events UNION ALL SELECT 'label', count(*) FILTER (WHERE event_id % 31 = 0) FROM events
 UNION ALL SELECT 'local_orig', count(*) FILTER (WHERE event_id % 41 = 0) FROM events UNION ALL SELECT 'conn_state', 0""")
def missing_per_column(spark, sf_dir):
    return profile.missing_cells(texts(spark, sf_dir), ["daytime", "label", "local_orig", "conn_state"])


@query(f"WITH {FLOW}, c AS (SELECT label_key AS value, count(*) AS n FROM flow GROUP BY 1) SELECT value, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, row_number() OVER (ORDER BY n DESC, value)::INTEGER AS place FROM c")
def frequency_sort(spark, sf_dir):
    return profile.frequencies(flow_view(spark, sf_dir), "label_key")


@query(f"WITH {FLOW} SELECT user_id, min(us) AS us FROM flow GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    return profile.ordered_distinct(flow_view(spark, sf_dir), "user_id", ["us"]).select("user_id", "first.us")


@query(f"WITH {FLOW} SELECT seq, value FROM flow ORDER BY md5(seq::VARCHAR), seq LIMIT 20000")
def downsample(spark, sf_dir):
    """A sampling operator: 20000 rows at most."""
    return profile.downsample(flow_view(spark, sf_dir).select("seq", "value"), 20_000, "seq")


@query(f"""WITH {FLOW}, e AS (SELECT label_key, min(value) AS lo, max(value) AS hi, count(*) AS a FROM flow GROUP BY 1), c AS (SELECT flow.label_key, least(floor((value - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n FROM flow JOIN e USING (label_key) GROUP BY ALL)
 SELECT label_key, g.bin::INTEGER AS bin, round(lo + g.bin * ((hi - lo) / 30), 6) AS lo, coalesce(n, 0) AS n, round(coalesce(n, 0) / (a * ((hi - lo) / 30)), 9) AS density FROM e CROSS JOIN (SELECT unnest(range(0, 30)) AS bin) g LEFT JOIN c USING (label_key, bin)""")
def value_histogram(spark, sf_dir):
    return stats.histogram(flow_view(spark, sf_dir), "value", 30, ("label_key",))


@query(f"WITH {FLOW}, n AS (SELECT DISTINCT label_key AS x FROM flow) SELECT p.x AS a, q.x AS b FROM n p, n q WHERE p.x <> q.x")
def dataset_pairs(spark, sf_dir):
    return profile.dataset_pairs(flow_view(spark, sf_dir), "label_key")


@query(f"""WITH {FLOW}, a AS (SELECT DISTINCT user_id FROM flow WHERE label = 1), b AS (SELECT DISTINCT user_id FROM flow WHERE label_key = 'click'), i AS (SELECT * FROM a INTERSECT SELECT * FROM b), u AS (SELECT * FROM a UNION SELECT * FROM b)
 SELECT user_id, user_id IN (SELECT user_id FROM i) AS shared FROM u""")
def name_sets(spark, sf_dir):
    """Union of two sets of names, and which of them are in both."""
    r = flow_view(spark, sf_dir)
    a, b = (r.filter(c).select("user_id") for c in ("label = 1", "label_key = 'click'"))
    both = a.intersect(b).withColumn("shared", F.lit(True))
    return a.union(b).distinct().join(both, "user_id", "left").na.fill(False, ["shared"])


@query(f"""WITH {FLOW}, d AS (SELECT date_trunc('day', daytime)::TIMESTAMP AS day, label_key, avg(value) AS v FROM flow GROUP BY ALL)
 SELECT a.label_key AS a, b.label_key AS b, round(sum(a.v * ln(a.v / b.v)) / sum(a.v) + ln(sum(b.v) / sum(a.v)), 6) AS kl, round(avg(abs(a.v - b.v)), 6) AS mean_distance FROM d a JOIN d b ON a.day = b.day AND a.label_key <> b.label_key GROUP BY ALL""")
def raw_kl_of_pairs(spark, sf_dir):
    """Divergence and mean distance of each pair of keys over their daily means."""
    d = flow_view(spark, sf_dir).groupBy(F.date_trunc("day", "daytime").alias("day"), "label_key").agg(F.avg("value").alias("v"))
    a, b = (d.select("day", F.col("label_key").alias(s), F.col("v").alias(f"v{s}")) for s in "ab")
    both = a.join(b, "day").filter("a != b")
    return both.groupBy("a", "b").agg(F.round(profile.aligned_kl(F.col("va"), F.col("vb")), 6).alias("kl"), F.round(F.avg(F.abs(F.col("va") - F.col("vb"))), 6).alias("mean_distance"))


@query(f"""WITH {FLOW}, c AS (SELECT date_trunc('day', daytime) AS day, label_key, nullif(corr(value, score), 'NaN'::DOUBLE) AS value, nullif(corr(k, score), 'NaN'::DOUBLE) AS k FROM flow GROUP BY ALL) SELECT label_key, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM c GROUP BY 1""")
def feature_importance(spark, sf_dir):
    return profile.importance(flow_view(spark, sf_dir).withColumn("day", F.date_trunc("day", "daytime")), ["value", "k"], "score", ["label_key"], "day")


@query(f"WITH {FLOW}, m AS (SELECT {HOURLY}, label_key, sum(k) AS cost FROM flow GROUP BY ALL) SELECT slot, round(sum(cost), 4) AS cost, count(*) AS models FROM m GROUP BY 1")
def model_cost_sum(spark, sf_dir):
    return hourly(spark, sf_dir).groupBy("slot", "label_key").agg(F.sum("k").alias("cost")).groupBy("slot").agg(F.round(F.sum("cost"), 4).alias("cost"), F.count("*").alias("models"))


@query(f"""WITH {FLOW}, s AS (SELECT label_key, daytime < TIMESTAMP '2024-01-16' AS early, count(value) AS n, avg(value) AS m, var_samp(value) / count(value) AS v FROM flow GROUP BY ALL)
 SELECT a.label_key, round((a.m - b.m) / sqrt(a.v + b.v), 6) AS t, round((a.v + b.v) ^ 2 / (a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1)), 4) AS freedom FROM s a JOIN s b ON a.label_key = b.label_key AND a.early AND NOT b.early""")
def welch_test(spark, sf_dir):
    return profile.welch(flow_view(spark, sf_dir).withColumn("early", F.col("daytime") < F.lit("2024-01-16").cast("timestamp_ntz")), "value", "early", ["label_key"])


@query(f"""WITH {FLOW} SELECT seq, round(value, 6) AS f0, round(k, 6) AS f1, label::DOUBLE AS f2, (label_key = 'click')::INTEGER::DOUBLE AS f3, round((us - (SELECT min(us) FROM flow)) / {HOUR}.0, 6) AS hours FROM flow""")
def feature_vectors(spark, sf_dir):
    r = flow_view(spark, sf_dir).withColumn("click", F.col("label_key") == "click")
    first = F.lit(r.agg(F.min("us")).first()[0])
    v = session.feature_vector(["value", "k", "label", "click"])
    return r.select("seq", v.alias("v"), F.round((F.col("us") - first) / HOUR, 6).alias("hours")).select("seq", "hours", *(F.round(F.col("v")[i], 6).alias(f"f{i}") for i in range(4)))


@query(f"""WITH {FLOW}, s AS (SELECT min(daytime) AS a FROM flow WHERE daytime >= TIMESTAMP '2023-12-20') SELECT seq, daytime FROM flow, s WHERE daytime >= a AND daytime <= TIMESTAMP '2024-01-10' + (a - TIMESTAMP '2023-12-20')""")
def session_filter(spark, sf_dir):
    """Rows of a session whose asked start is before the first row, so that its clocks and end move."""
    rows = flow_view(spark, sf_dir).select("seq", "daytime")
    return session.session_rows(rows, session.session_range(rows, datetime(2023, 12, 20), datetime(2024, 1, 10)))


@query("""SELECT event_id, trim(event_type) AS kind, event_id % 97 AS port, make_date(2024, 1 + (event_id % 12)::INTEGER, 1 + (event_id % 28)::INTEGER) AS day, make_timestamp(event_id * 1000000) AS "at", 'flow' AS tag, '["conn","zeek"]' AS tags FROM events""")
def ingest_projection(spark, sf_dir):
    """Raw text fields stripped, renamed and converted; epoch seconds as a time; constant fields and tags."""
    e = table(spark, sf_dir, "events")
    raw = e.select("event_id", F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("raw kind"), (F.col("event_id") % 97).cast("string").alias("raw_port"), F.format_string("%02d/%02d/2024", F.col("event_id") % 12 + 1, F.col("event_id") % 28 + 1).alias("raw_day"), F.col("event_id").cast("string").alias("ts"))
    return raw.select(
        "event_id", F.trim("raw kind").alias("kind"), F.col("raw_port").try_cast("long").alias("port"), F.to_date("raw_day", "MM/dd/yyyy").alias("day"),
        F.timestamp_seconds(F.col("ts").try_cast("double")).cast("timestamp_ntz").alias("at"), F.lit("flow").alias("tag"), scalars.json_text(F.array(F.lit("conn"), F.lit("zeek"))).alias("tags"),
    )


@query(f"""WITH {FLOW}, b AS (SELECT min(us) + {24 * HOUR} AS a, max(us) AS z FROM flow), e AS (SELECT unnest(range(a, z + 1, {6 * HOUR})) AS "end" FROM b WHERE a <= z), j AS (SELECT "end", count(us) AS n, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM e LEFT JOIN flow ON us >= "end" - {24 * HOUR} AND us <= "end" GROUP BY 1)
 SELECT "end", n, CASE WHEN n >= 50 THEN value END AS value, CASE WHEN n >= 50 THEN k END AS k FROM j""")
def sliding_feature_means(spark, sf_dir):
    """Feature means of day-long windows every six hours, empty ones included, null below 50 rows."""
    return windows.sliding_means(flow_view(spark, sf_dir), "us", 24 * HOUR, 6 * HOUR, ["value", "k"], 50)


@query(f"""WITH {FLOW}, w AS (SELECT seq, us, us - min(us) OVER (PARTITION BY label_key) AS age, count(*) OVER (PARTITION BY label_key ORDER BY us RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS cw, count(*) OVER (PARTITION BY label_key ORDER BY us RANGE BETWEEN {48 * HOUR} PRECEDING AND {24 * HOUR + 1} PRECEDING) AS pw FROM flow) SELECT seq, cw, pw FROM w WHERE age >= {48 * HOUR}""")
def equal_windows_warm(spark, sf_dir):
    """Equal current and past windows of a day, from when both are full."""
    counted = windows.dual_window(flow_view(spark, sf_dir), "label_key", "us", 24 * HOUR, 24 * HOUR)
    return windows.warm(counted, "label_key", "us", 48 * HOUR).select("seq", "cw", "pw")


@query(f"""WITH {FLOW}, e AS (SELECT label_key, min(value) AS lo, max(value) AS hi, count(*) AS n, (max(value) - min(value)) / 63 AS step FROM flow WHERE value IS NOT NULL GROUP BY 1),
 b AS (SELECT label_key, (value - lo) / step AS q, least(floor((value - lo) / step), 62) AS low FROM flow JOIN e USING (label_key) WHERE value IS NOT NULL), w AS (SELECT label_key, low AS b, sum(1 - (q - low)) AS w FROM b GROUP BY ALL UNION ALL SELECT label_key, low + 1, sum(q - low) FROM b GROUP BY ALL)
 SELECT label_key, p::INTEGER AS point, round(lo + p * step, 6) AS x, round(sum(w * exp(-(((p - b) * step / 2.5) * ((p - b) * step / 2.5)) / 2)) / (n * 2.5 * sqrt(2 * pi())), 9) AS density FROM e CROSS JOIN (SELECT unnest(range(0, 64)) AS p) JOIN w USING (label_key) GROUP BY label_key, p, lo, step, n""")
def kernel_density(spark, sf_dir):
    """Density of each event type's values at 64 places."""
    return stats.kernel_density(flow_view(spark, sf_dir), "value", 2.5, 64, ("label_key",))


@query(f"""WITH {FLOW}, b AS (SELECT min(us) AS a, max(us) AS z FROM flow), e AS (SELECT unnest(range(a + {48 * HOUR}, z + 1, {12 * HOUR})) AS "end" FROM b WHERE a + {48 * HOUR} <= z),
 r AS (SELECT value FROM flow WHERE us < (SELECT a FROM b) + {72 * HOUR} AND value IS NOT NULL), j AS MATERIALIZED (SELECT "end", us, value FROM e LEFT JOIN flow ON us >= "end" - {48 * HOUR} AND us <= "end"),
 t AS (SELECT "end", count(us) AS n, avg(value) AS m FROM j GROUP BY 1), v AS (SELECT "end", value AS v, count(*) AS a, 0 AS b FROM j WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT "end", value, 0, count(*) FROM t, r WHERE n >= 30 AND m IS NOT NULL GROUP BY ALL),
 c AS (SELECT "end", v, sum(a) AS a, sum(b) AS b FROM v JOIN t USING ("end") WHERE n >= 30 GROUP BY ALL),
 g AS (SELECT "end", abs(sum(a) OVER u / sum(a) OVER k - sum(b) OVER u / sum(b) OVER k) AS g, lead(v) OVER u - v AS w FROM c WINDOW u AS (PARTITION BY "end" ORDER BY v), k AS (PARTITION BY "end")),
 d AS (SELECT "end", round(max(g), 6) AS ks, round(sum(g * coalesce(w, 0)), 6) AS wasserstein FROM g GROUP BY 1)
 SELECT "end", n, ks, wasserstein, CASE WHEN ks IS NOT NULL THEN round(m - (SELECT avg(value) FROM r), 6) END AS mean_shift FROM t LEFT JOIN d USING ("end")""")
def sliding_drift(spark, sf_dir):
    """Drift of the value in two-day windows every twelve hours against the first three days."""
    rows = flow_view(spark, sf_dir)
    first = rows.agg(F.min("us")).first()[0] or 0
    return windows.sliding_drift(rows, "us", 48 * HOUR, 12 * HOUR, "value", rows.filter(F.col("us") < first + 72 * HOUR), 30)


@query(f"""WITH {FLOW} SELECT seq, trunc(value)::INTEGER AS label, label_key || '|' || user_id AS key, printf('%4.1f', seq % 1000 * 100.0 / 7000) || '% (' || format('{{:,}}', seq % 1000) || ')' AS share,
 CASE WHEN seq // 3600 > 0 THEN (seq // 3600) || 'h ' ELSE '' END || CASE WHEN seq // 60 > 0 THEN (seq % 3600 // 60) || 'm ' ELSE '' END || (seq % 60) || 's' AS span, round(value * k + k * user_id, 4) AS product, round((value - k) * (value - k) + (k - user_id) * (k - user_id), 4) AS distance FROM flow""")
def scalar_texts(spark, sf_dir):
    """Labels and keys from text, shares and spans as text, products and distances of vectors."""
    r = flow_view(spark, sf_dir)
    a, b = F.array("value", "k"), F.array("k", F.col("user_id").cast("double"))
    share = scalars.ratio_text(F.col("seq") % 1000, F.lit(7000))
    return r.select("seq", scalars.label_of(F.col("value").cast("string")).alias("label"), scalars.label_key(F.col("label_key"), F.col("user_id")).alias("key"), share.alias("share"), scalars.duration_text(F.col("seq")).alias("span"), F.round(scalars.inner_product(a, b), 4).alias("product"), F.round(scalars.squared_distance(a, b), 4).alias("distance"))
