"""Preference pairs from ``events``: a user and event type is a prompt, the whole part of the value the answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.operators import preference as P
from arbolith.plans.registry import Plans
from arbolith.tables import table

plans = Plans()
PROMPT = ["user_id", "event_type"]
C = "WITH c AS (SELECT event_id, user_id, event_type, value, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS answer FROM events) "


def candidates(spark, base):
    df = table(spark, base, "events").select("event_id", *PROMPT, "value")
    return df.withColumn("answer", F.floor("value").cast("bigint").cast("string"))


@plans.add(C + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM c)
    SELECT event_id, CASE WHEN row_number() OVER b = 1 THEN last_value(answer) OVER (PARTITION BY user_id, n // 8 ORDER BY n
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(answer) OVER b END AS shifted
    FROM o WINDOW b AS (PARTITION BY user_id, n // 8 ORDER BY n)""")
def w11_shift(spark, base):
    """Batches of 8 within each user, however many events that user has."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    df = candidates(spark, base).withColumn("n", n)
    return P.shift_in_batches(df, "n", "answer", 8, ["user_id"]).select("event_id", "shifted")


@plans.add(C + """, b AS (SELECT user_id, event_type, arg_max(answer, (value, -event_id)) AS chosen, max(value) AS chosen_score FROM c GROUP BY 1, 2)
    SELECT b.user_id, b.event_type, chosen, arg_min(answer, (value, event_id)) AS rejected, chosen_score, min(value) AS rejected_score
    FROM b JOIN c ON c.user_id = b.user_id AND c.event_type = b.event_type AND c.answer <> b.chosen GROUP BY 1, 2, 3, 5""")
def w12_best_and_worst(spark, base):
    return P.best_and_worst(candidates(spark, base), PROMPT, "answer", "value", "event_id")


@plans.add(C + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n,
        count(*) OVER g AS m, avg(value) OVER g AS mean FROM c WINDOW g AS (PARTITION BY user_id, event_type))
    SELECT event_id, CASE WHEN n <= 2 THEN 'positive' ELSE 'negative' END AS role FROM r WHERE mean < 60 AND (n <= 2 OR n = m)""")
def w13_rejection_sampling(spark, base):
    return P.rejection_sample(candidates(spark, base), PROMPT, F.col("value"), "event_id", 2, easy=60.0).select("event_id", "role")


@plans.add("""WITH n AS (SELECT greatest(count(*) FILTER (value > 50), 1) AS d, greatest(count(*) FILTER (NOT value > 50), 1) AS u FROM events)
    SELECT d AS desirable, u AS undesirable, round_even(u / d, 2) AS desirable_low, round_even(u / d * 1.33, 2) AS desirable_high,
           round_even(d / u / 1.33, 2) AS undesirable_low, round_even(d / u, 2) AS undesirable_high FROM n""")
def a21_class_balance(spark, base):
    return P.class_balance(candidates(spark, base), F.col("value") > 50)


@plans.add("SELECT event_id, value FROM events WHERE value > 50")
def row_p26_score_threshold(spark, base):
    return candidates(spark, base).filter("value > 50").select("event_id", "value")
