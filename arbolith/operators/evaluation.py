"""Accuracy breakdowns, model pools, joins of evaluations, and metrics over vectors, ranks and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.functions import scalars as S
from arbolith.operators.ordering import running_total
from arbolith.storage import materialize, small_side


def accuracy_by(df: DataFrame, key: str | Column, correct: Column) -> DataFrame:
    """key, total, correct, accuracy; null and empty keys are 'unknown'. A null ``correct`` counts as wrong."""
    right = F.coalesce(correct.cast("double"), F.lit(0.0))
    per = df.groupBy(F.coalesce(S.truthy(key), F.lit("unknown")).alias("key"))
    return per.agg(F.count("*").alias("total"), F.sum(right).alias("correct"), F.avg(right).alias("accuracy"))


def run_summary(df: DataFrame, score: Column, failed: Column, cost: Column, tokens: Column) -> DataFrame:
    """Totals of a run in one row: counts, accuracy over all and over completed rows, cost and tokens."""
    done = F.when(~failed, F.coalesce(score, F.lit(0.0)))
    cost = F.nanvl(cost, F.lit(None).cast("double"))
    return df.agg(
        F.count("*").alias("total"),
        F.count(F.when(failed, 1)).alias("failed"),
        F.count(F.when(~failed & (score >= 0.5), 1)).alias("correct"),
        F.avg(F.coalesce(F.when(~failed, score), F.lit(0.0))).alias("accuracy"),
        F.avg(done).alias("completed_accuracy"),
        F.sum(cost).alias("cost"),
        F.avg(cost).alias("avg_cost"),
        F.sum(tokens).alias("tokens"),
    )


def usage_counts(df: DataFrame, models: str) -> DataFrame:
    """model, n: how often each is named in the arrays of ``models``, counted before the shuffle."""
    return df.select(F.explode(models).alias("model")).groupBy("model").agg(F.count("*").alias("n"))


def correct_pools(df: DataFrame, task: str, model: str, correct: Column) -> DataFrame:
    """task, models (correct ones first, then by name), correct_models, n_correct; a model is correct if any of its rows is.

    A task's list has a place per distinct model.
    """
    per = df.groupBy(task, model).agg(F.max(F.coalesce(correct, F.lit(False))).alias("__ok"))
    items = F.sort_array(F.collect_list(F.struct((~F.col("__ok")).alias("wrong"), F.col(model).alias("m"))))
    out = per.groupBy(task).agg(items.alias("__items"))
    right = F.transform(F.filter("__items", lambda x: ~x["wrong"]), lambda x: x["m"])
    return out.select(task, F.transform("__items", lambda x: x["m"]).alias("models"), right.alias("correct_models"), F.size(right).alias("n_correct"))


def key_conflicts(df: DataFrame, key: Column, identity: str) -> DataFrame:
    """key, n: keys that stand for several identities."""
    return df.groupBy(key.alias("key")).agg(F.countDistinct(identity).alias("n")).filter("n > 1")


def join_by_question(left: DataFrame, left_text: str, right: DataFrame, right_text: str) -> DataFrame:
    """Inner join on the normalised question; the right side is broadcast only while it is small."""
    a = left.withColumn("__q", S.normal_question(left_text))
    b = right.withColumn("__q", S.normal_question(right_text))
    return a.join(small_side(b), "__q").drop("__q")


def last_of(df: DataFrame, keys: Sequence[str], order: Column, *values: str) -> DataFrame:
    """keys and the values of the row with the greatest ``order``: one aggregate, partial before the shuffle."""
    best = F.max_by(F.struct(*values), order).alias("__v")
    return df.groupBy(*keys).agg(best).select(*keys, "__v.*")


def majority(df: DataFrame, keys: Sequence[str], letter: str) -> DataFrame:
    """keys, majority, votes: the most frequent non-empty value, the smallest of tied ones."""
    per = df.filter(S.truthy(letter).isNotNull()).groupBy(*keys, letter).agg(F.count("*").alias("__n"))
    best = F.max_by(F.struct(F.col(letter).alias("majority"), F.col("__n").alias("votes")), F.struct("__n", (-F.ascii(letter)).alias("a")))
    return per.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def histogram(df: DataFrame, value: Column, buckets: int = 10) -> DataFrame:
    """bucket (0..), n, ratio over 0..1, the last bucket closed; empty buckets are there with 0."""
    at = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(value / F.lit(1.0 / buckets)))).cast("int")
    per = df.filter(value.isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(per, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # as many rows as buckets
    return out.withColumn("ratio", F.coalesce(F.try_divide("n", total), F.lit(0.0)))


def token_accuracy(df: DataFrame, labels: str, predictions: str) -> DataFrame:
    """tokens, correct, accuracy, exact: with label -100 masked and predictions one step behind; exact is per row."""
    pairs = F.zip_with(F.expr(f"slice({labels}, 2, greatest(size({labels}) - 1, 0))"), F.expr(f"slice({predictions}, 1, greatest(size({predictions}) - 1, 0))"), lambda y, p: F.struct(y.alias("y"), p.alias("p")))
    kept = F.filter(pairs, lambda x: x["y"] != -100)
    right = F.size(F.filter(kept, lambda x: x["y"] == x["p"]))
    rows = df.select(F.size(kept).alias("n"), right.alias("r"))
    return rows.agg(
        F.sum("n").alias("tokens"), F.sum("r").alias("correct"), (F.sum("r") / F.sum("n")).alias("accuracy"), F.avg((F.col("n") == F.col("r")).cast("double")).alias("exact")
    )


def paired_metrics(df: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """measure, pearson, spearman of cosine, -L1, -L2 and dot against the label; pairs without a measure or label are left out of it.

    The ranks of all measures and of the labels beside them come from one range
    sort of distinct values; where a measure's ranks start doesn't matter to a correlation.
    """
    y = F.col(label).cast("double")
    values = {"cosine": S.cosine(a, b), "l1": -S.l1(a, b), "l2": -S.l2(a, b), "dot": S.dot(a, b)}
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), x.alias("x"), y.alias("y")) for m, x in values.items()])))
    rows = materialize(rows.filter("x IS NOT NULL AND y IS NOT NULL"), "paired")
    sides = F.inline(F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v"))))
    per = rows.select("measure", sides).groupBy("measure", "side", "v").agg(F.count("*").alias("n"))
    per = running_total(per, ["measure", "side", "v"], "n", "upto").select("measure", "side", "v", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))
    per = materialize(per, "ranks")
    ranks = {s: per.filter(F.col("side") == s).select(F.col("measure").alias(f"m{s}"), F.col("v").alias(f"v{s}"), F.col("rank").alias(f"r{s}")) for s in "xy"}
    on = rows.join(small_side(ranks["x"]), (F.col("measure") == F.col("mx")) & (F.col("x") == F.col("vx")))
    on = on.join(small_side(ranks["y"]), (F.col("measure") == F.col("my")) & (F.col("y") == F.col("vy")))
    return on.groupBy("measure").agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def contrast(df: DataFrame, group: Sequence[str], query: str, doc: str, positive: str) -> DataFrame:
    """mean_pos, mean_neg, margin: over in-group queries and documents, margin = positive less hardest negative, averaged.

    ``positive`` names the id of a row: a row's own document is its positive,
    the group's other documents its negatives. Groups are batches of bounded size.
    """
    docs = df.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(positive).alias("__p"), F.col(doc).alias("__d"))
    same = F.lit(True)
    for g in group:
        same = same & (F.col(g) == F.col(f"__{g}"))
    sim = df.join(docs, same).select(F.col(positive).alias("q"), (F.col(positive) == F.col("__p")).alias("own"), S.cosine(query, "__d").alias("s"))
    per = sim.groupBy("q").agg(F.max(F.when(F.col("own"), F.col("s"))).alias("pos"), F.avg(F.when(~F.col("own"), F.col("s"))).alias("neg"), F.max(F.when(~F.col("own"), F.col("s"))).alias("hard"))
    return per.agg(F.avg("pos").alias("mean_pos"), F.avg("neg").alias("mean_neg"), F.avg(F.col("pos") - F.col("hard")).alias("margin"))


def ranking_metrics(df: DataFrame, group: Sequence[str], score: str, label: str, tie: str) -> DataFrame:
    """mrr, ndcg over groups of at least two rows with a positive; gains 2^label - 1, discounts log2(rank + 1)."""
    w = Window.partitionBy(*group)
    ranked = df.select(*group, F.col(label).alias("y"), F.row_number().over(w.orderBy(F.col(score).desc(), tie)).alias("r"), F.row_number().over(w.orderBy(F.col(label).desc(), tie)).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    gain = F.pow(F.lit(2.0), F.col("y")) - 1
    per = ranked.filter("n > 1").groupBy(*group).agg(
        F.max(F.when(F.col("y") > 0, 1 / F.col("r"))).alias("rr"), F.sum(gain / F.log2(F.col("r") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("i") + 1)).alias("ideal")
    )
    return per.filter("ideal > 0").agg(F.avg("rr").alias("mrr"), F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def kl_estimates(df: DataFrame, policy: str, reference: str) -> DataFrame:
    """k1, k3: means over tokens of the log-probability arrays' KL estimators, differences clamped to +-20."""
    d = F.explode(F.zip_with(policy, reference, lambda p, r: F.greatest(F.lit(-20.0), F.least(F.lit(20.0), r.cast("double") - p.cast("double")))))
    return df.select(d.alias("d")).agg(F.avg(-F.col("d")).alias("k1"), F.avg(F.exp("d") - F.col("d") - 1).alias("k3"))


def pair_losses(df: DataFrame, similarity: str, label: str, margin: float = 0.5) -> DataFrame:
    """cosine_mse, contrastive and online of pairs with a cosine and a label 0 or 1.

    online sums over the hard pairs only: negatives nearer than the farthest
    positive, and positives farther than the nearest negative (than the mean of
    their own kind where there is but one of the other). One row; two passes.
    """
    d, y = 1 - F.col(similarity), F.col(label)
    kinds = {k: F.when(y == k, d) for k in (0, 1)}
    ends = df.agg(
        *[f(kinds[k]).alias(f"__{n}{k}") for k in (0, 1) for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg), ("n", F.count))]
    )
    near = F.when(F.col("__n1") > 1, F.col("__max1")).otherwise(F.col("__avg0"))
    far = F.when(F.col("__n0") > 1, F.col("__min0")).otherwise(F.col("__avg1"))
    gap = F.pow(F.greatest(F.lit(0.0), margin - d), 2)
    hard = F.when((y == 1) & (d > far), d * d).when((y == 0) & (d < near), gap).otherwise(0.0)
    return df.crossJoin(F.broadcast(ends)).agg(  # one row
        F.avg(F.pow(F.col(similarity) - y, 2)).alias("cosine_mse"),
        F.avg(F.when(y == 1, 0.5 * d * d).otherwise(0.5 * gap)).alias("contrastive"),
        F.sum(hard).alias("online"),
    )


def running_lists(df: DataFrame, group: Sequence[str], order: str, label: str, out: str) -> DataFrame:
    """``out``: the number of the list in the group that a row belongs to; every positive starts one, rows before the first go."""
    w = Window.partitionBy(*group).orderBy(order)
    return df.withColumn(out, F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).over(w)).filter(F.col(out) > 0)


def ranking_losses(df: DataFrame, group: Sequence[str], order: str, score: str, label: str, least: int = 2) -> DataFrame:
    """pointwise (logistic) and listwise (softmax over lists of at least ``least`` rows) losses, one row.

    In the order of a group every positive starts a list; rows before the first belong to none.
    """
    s, y = F.col(score), F.col(label)
    each = F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))
    lists = running_lists(df, group, order, label, "__list").groupBy(*group, "__list")
    top = lists.agg(F.max(s).alias("__top"), F.max(F.when(y == 1, s)).alias("__own"), F.count("*").alias("__n"), F.collect_list(s).alias("__s"))
    total = F.aggregate("__s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top")))
    per = top.filter(F.col("__n") >= least).agg(F.avg(F.ln(total) + F.col("__top") - F.col("__own")).alias("listwise"))
    return df.agg(F.avg(each).alias("pointwise")).crossJoin(per)  # one row each
