"""Advantages over ``events``: a user is a prompt, an event a request, its value the reward."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.operators import advantage as A
from arbolith.plans.registry import Plans
from arbolith.tables import table

plans = Plans()
G = ["user_id"]
E = "WITH e AS (SELECT event_id, user_id, event_type, ts, value, TRY_CAST(props->>'$.k' AS DOUBLE) AS k FROM events) "


def rows(spark, base):
    return table(spark, base, "events").select(
        "event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").alias("k")
    )


def out(df, *more):
    return df.select("event_id", *more, F.round("advantage", 6).alias("advantage"))


@plans.add("""SELECT event_id, user_id, round(CASE WHEN count(*) OVER g < 2 THEN 0 ELSE value - avg(value) OVER g END, 6) AS advantage
    FROM events WINDOW g AS (PARTITION BY user_id)""")
def w1_group_mean_advantage(spark, base):
    return out(A.group_mean(rows(spark, base), G, "value"), "user_id")


@plans.add(E + """SELECT event_id, round(CASE WHEN min(k) OVER g = max(k) OVER g OR count(*) OVER g < 2 THEN 0
    ELSE (dense_rank() OVER (PARTITION BY user_id ORDER BY k) - 1) / (count(*) OVER g - 1) - 0.5 END, 6) AS advantage
    FROM e WINDOW g AS (PARTITION BY user_id)""")
def w2_rank_advantage(spark, base):
    return out(A.rank(rows(spark, base), G, "k"))


@plans.add(E + """, p AS (SELECT *, value / greatest(k, 1) AS x FROM e)
    SELECT event_id, round(x - avg(x) OVER (PARTITION BY user_id), 6) AS advantage FROM p""")
def w3_length_normalised(spark, base):
    return out(A.length_normalised(rows(spark, base).withColumn("k", A.number("k")), G, "value", "k"))


@plans.add(E + "SELECT event_id, round(0.7 * coalesce(value, 0) + 0.3 * coalesce(k, 0), 6) AS reward FROM e")
def w4_composite_reward(spark, base):
    return A.composite(rows(spark, base), {"value": 0.7, "k": 0.3}).select("event_id", F.round("reward", 6).alias("reward"))


GRPO = """SELECT event_id, round((value - avg(value) OVER g) / ({std} + 1e-4), 6) AS advantage
    FROM events WINDOW g AS (PARTITION BY user_id)"""


@plans.add(GRPO.format(std="coalesce(stddev_samp(value) OVER g, 0)"))
def w5_grpo_group(spark, base):
    return out(A.grpo(rows(spark, base), G, "value"))


@plans.add(GRPO.format(std="(SELECT stddev_samp(value) FROM events)"))
def w5_grpo_batch(spark, base):
    return out(A.grpo(rows(spark, base), G, "value", scale="batch"))


@plans.add("""SELECT event_id, round((value - avg(value) OVER g) * CASE WHEN count(value) OVER g > 1
    THEN count(value) OVER g / (count(value) OVER g - 1) ELSE 1 END, 6) AS advantage FROM events WINDOW g AS (PARTITION BY user_id)""")
def w6_rloo(spark, base):
    return out(A.grpo(rows(spark, base), G, "value", scale="none", center="loo"))


@plans.add("""WITH a AS (SELECT event_id, value - avg(value) OVER (PARTITION BY user_id) AS a FROM events)
    SELECT event_id, round(a / ((SELECT stddev_samp(a) FROM a) + 1e-4), 6) AS advantage FROM a""")
def w7_reinforce_plus(spark, base):
    return out(A.reinforce_plus(rows(spark, base), G, "value"))


@plans.add(E + """, s AS (SELECT event_id,
        0.5 * coalesce((value - avg(value) OVER g) / (coalesce(stddev_samp(value) OVER g, 0) + 1e-4), 0)
        + 2 * coalesce((k - avg(k) OVER g) / (coalesce(stddev_samp(k) OVER g, 0) + 1e-4), 0) AS s FROM e WINDOW g AS (PARTITION BY user_id))
    SELECT event_id, round((s - (SELECT avg(s) FROM s)) / ((SELECT stddev_samp(s) FROM s) + 1e-8), 6) AS advantage FROM s""")
def w8_gdpo(spark, base):
    return out(A.gdpo(rows(spark, base), G, {"value": 0.5, "k": 2.0}))


@plans.add("""WITH r AS (SELECT event_id, user_id * 1000 + event_id % 20 AS request, user_id, value FROM events),
    s AS (SELECT *, max(value) OVER w - min(value) OVER w > 1e-6 AS inconsistent,
          row_number() OVER (PARTITION BY request ORDER BY event_id DESC) AS n FROM r WINDOW w AS (PARTITION BY request)),
    l AS (SELECT request, CASE WHEN count(*) OVER g < 2 THEN 0 ELSE value - avg(value) OVER g END AS a FROM s WHERE n = 1 WINDOW g AS (PARTITION BY user_id))
    SELECT event_id, inconsistent, round(a, 6) AS advantage FROM s JOIN l USING (request)""")
def w9_request_aware(spark, base):
    df = rows(spark, base).withColumn("request", F.col("user_id") * 1000 + F.col("event_id") % 20)
    return out(A.by_request(df, "request", "user_id", "value", "event_id"), "inconsistent")


@plans.add("""SELECT event_id, round(value / ((SELECT stddev_samp(value) FROM events) + 1e-8), 6) AS advantage FROM events""")
def w10_whitening(spark, base):
    return out(A.whiten(rows(spark, base), "value"))


@plans.add(E + """SELECT event_id, round(CASE WHEN max(k) OVER g - min(k) OVER g < 1e-5 THEN least(1, greatest(0, k))
    ELSE (k - min(k) OVER g) / (max(k) OVER g - min(k) OVER g) END, 6) AS normalised FROM e WINDOW g AS (PARTITION BY user_id, event_type)""")
def w14_min_max(spark, base):
    return A.min_max(rows(spark, base), ["user_id", "event_type"], "k").select("event_id", F.round("normalised", 6).alias("normalised"))


@plans.add("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, n, value AS x, 1.0::DOUBLE AS w FROM o WHERE n = 1
          UNION ALL SELECT o.user_id, o.event_id, o.n, r.x * 0.9 + o.value, r.w * 0.9 + 1 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, event_id, round(x / w, 6) AS smoothed FROM r""")
def w20_smoothing(spark, base):
    df = A.smooth(rows(spark, base), G, ["event_id"], "value", 0.9)
    return df.select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@plans.add(E + """SELECT event_id FROM (SELECT event_id, stddev_samp(k) OVER (PARTITION BY user_id, event_type) AS s FROM e) WHERE s > 0""")
def m19_varied_groups(spark, base):
    return A.varied_groups(rows(spark, base), ["user_id", "event_type"], "k").select("event_id")


STATS = "count({c}) AS n, count(*) FILTER ({c} <> 0) AS non_zero, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, min({c}) AS min, max({c}) AS max"


@plans.add("SELECT " + STATS.format(c="value") + " FROM events")
def a16_a22_statistics(spark, base):
    s = A.statistics(rows(spark, base), "value")
    return s.select("n", "non_zero", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


@plans.add("""SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS prompts, count(*) FILTER (c > 1) AS multi, count(*) FILTER (c = 1) AS single
    FROM (SELECT count(*) AS c FROM events GROUP BY user_id, event_type, event_id % 20)""")
def a23_group_sizes(spark, base):
    return A.group_sizes(rows(spark, base).withColumn("part", F.col("event_id") % 20), ["user_id", "event_type", "part"])


@plans.add(E + "SELECT event_type, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS std, count(k) AS n FROM e GROUP BY 1")
def a24_nan_aware(spark, base):
    k = A.number("k")
    return rows(spark, base).groupBy("event_type").agg(
        F.round(F.avg(k), 6).alias("mean"), F.round(F.stddev_samp(k), 6).alias("std"), F.count(k).alias("n")
    )


@plans.add(E + """SELECT round(avg(CASE WHEN r = 0 THEN 1.0 ELSE 0.0 END), 6) AS flat_share
    FROM (SELECT coalesce(max(k) - min(k), 0) AS r FROM e GROUP BY user_id, event_type)""")
def a26_flat_share(spark, base):
    return A.flat_share(rows(spark, base), ["user_id", "event_type"], "k").select(F.round("flat_share", 6).alias("flat_share"))


@plans.add("""SELECT row_id, CASE WHEN missing THEN NULL ELSE round(expected_acc_reward * 2, 6) END AS reward, missing AS all_missing
    FROM (SELECT *, coalesce(CAST(expected_acc_reward AS VARCHAR), 'nan') = 'nan' AS missing FROM training_rows)""")
def x5_reward_matrix(spark, base):
    df = table(spark, base, "training_rows").select("row_id", "expected_acc_reward")
    return A.nan_sum(df, {"expected_acc_reward": 2.0}).select("row_id", F.round("reward", 6).alias("reward"), "all_missing")
