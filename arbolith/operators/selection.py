"""Which rows are taken, and what is written of them: lists of ids, repairs, draws, tool calls and model pools."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.functions.scalars import truthy
from arbolith.operators.ordering import running_total
from arbolith.storage import materialize


def listed(df: DataFrame, key: str, group: str, groups: Sequence[str] = (), excluded: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Rows whose ``group`` (null as 'unknown') is in ``groups``, then without ``excluded`` keys, then only ``wanted`` ones.

    ``excluded`` and ``wanted`` have a column ``key``; null keys are in neither.
    No groups, or a missing list, lets all rows pass.
    """
    rows = df.filter(F.coalesce(truthy(group), F.lit("unknown")).isin(list(groups))) if groups else df
    rows = rows.join(excluded.select(key).distinct(), key, "left_anti") if excluded is not None else rows
    return rows.join(wanted.select(key).distinct(), key, "left_semi") if wanted is not None else rows


def without_blanks(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of ``columns`` is null or blank, these trimmed."""
    rows = df.withColumns({c: F.trim(F.col(c)) for c in columns})
    for c in columns:
        rows = rows.filter(truthy(c).isNotNull())
    return rows


def media(paths: Column) -> Column:
    """array<struct<bytes, path>> of an array of paths; null stays null."""
    return F.transform(paths, lambda p: F.struct(F.lit(None).cast("binary").alias("bytes"), p.alias("path")))


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the columns with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def in_input_order(results: DataFrame, key: str, inputs: DataFrame, order: str) -> DataFrame:
    """``results`` with the input's ``order``, sorted by it; results of no input are left out."""
    return results.join(inputs.select(key, order), key).orderBy(order)


def teacher_prompt(prompt: Column, answer: Column, label: Column | None, plain: str, labelled: str) -> Column:
    """The template ``labelled`` where there is a label, else ``plain``, with {prompt}, {answer} and {label} filled; null without prompt or answer."""
    label = F.coalesce(label, F.lit("")) if label is not None else F.lit("")
    out = F.when(label != "", F.lit(labelled)).otherwise(F.lit(plain))
    for name, value in (("label", label), ("answer", answer), ("prompt", truthy(prompt))):  # what is filled in last is not looked at again
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def mended_literal(c: Column) -> Column:
    """A list of literals with the commas that got lost between its objects."""
    return F.regexp_replace(c, r"\}(?:\n {0,2})?\{", "},{")


def tagged_spans(text: Column, spans: Column, tag: str = "<ref-object><bbox>") -> Column:
    """``text`` with each of the ordered 0-based spans (array<struct<a, b>>) replaced by ``tag``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"] + 1, F.greatest(s["a"] - acc["at"], F.lit(0)))
        return F.struct(F.concat(acc["out"], before, F.lit(tag)).alias("out"), s["b"].alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def rewritten(text: Column, phrases: Sequence[str], by: str) -> Column:
    """Every one of ``phrases`` replaced by ``by``, one after the other."""
    for p in phrases:
        text = F.replace(text, F.lit(p), F.lit(by))
    return text


def drawn(choices: Sequence[str], key: Column, seed: int = 42) -> Column:
    """One of ``choices`` by the md5 of seed and key, which any engine can replay."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % len(choices)
    return F.array(*[F.lit(c) for c in choices])[at.cast("int")]


def interleave_by_share(frames: Sequence[tuple[DataFrame, Sequence[str]]], shares: Sequence[float], seed: int = 42, stop: str = "first") -> DataFrame:
    """Rows of the frames with ``slot`` and ``source``: each slot draws its frame by ``shares`` and takes that frame's next row.

    A draw is the md5 of seed and slot. ``stop`` 'first' ends before the first
    slot whose frame has no row left; 'all' goes on to where every frame has
    been used up, and slots of used-up frames are left out.
    """
    sizes = [f.count() for f, _ in frames]
    spark = frames[0][0].sparkSession
    total = sum(shares)
    bounds = np.cumsum([s / total for s in shares]).tolist()
    # so many slots have drawn each frame often enough, but for a chance below e-9
    need = max((n / (s / total) + 6 * math.sqrt(n) / (s / total) + 60 / (s / total) for n, s in zip(sizes, shares) if n), default=0)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    source = F.lit(len(frames) - 1)
    for i in range(len(frames) - 2, -1, -1):
        source = F.when(draw < bounds[i], i).otherwise(source)
    slots = materialize(spark.range(math.ceil(need)).withColumnRenamed("id", "slot").withColumn("source", source), "slots")
    parts, ends = [], []
    for i, (f, order) in enumerate(frames):
        mine = running_total(slots.filter(F.col("source") == i).withColumn("__one", F.lit(1).cast("bigint")), ["slot"], "__one", "__nth").drop("__one")
        mine = materialize(mine, "slots")
        ends.append(mine.filter(F.col("__nth") == sizes[i] + 1).agg(F.min("slot")).first()[0])
        rows = running_total(f.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", "__nth").drop("__one")
        parts.append(rows.join(mine.hint("merge"), "__nth").drop("__nth"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = min((e for e in ends if e is not None), default=None)
    return out.filter(F.col("slot") < first) if stop == "first" and first is not None else out


def sampled_children(df: DataFrame, group: Sequence[str], node: str, value: str, keep: int, mix: float, temperature: float, seed: int = 42) -> DataFrame:
    """At most ``keep`` children of every parent, drawn one by one without replacement.

    A draw's weights are a mix of the softmax of ``value`` at ``temperature``
    (1 for values that aren't positive) and the uniform distribution over the
    children left; the draws of a parent follow from the md5 of seed, parent
    and draw. Which children a draw can take depends on all before it, so a
    parent is drawn in one task; parents with ``keep`` children or fewer aren't.
    """
    v = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    size = df.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]).agg(F.count("*").alias("__n"))
    same = F.lit(True)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    rows = df.select(*group, node, v.alias("__v")).join(size.hint("merge"), same).select(*group, node, "__v", "__n")
    schema = rows.select(*group, node).schema
    mix, temperature = min(max(mix, 0.0), 1.0), max(temperature, 1e-6)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(node, kind="stable")
        left, got = list(range(len(pdf))), []
        reward = np.array([math.exp(min(x / temperature, 700.0)) if x > 0 else 1.0 for x in pdf["__v"]])
        name = ":".join(str(pdf[c].iloc[0]) for c in group)
        for i in range(min(keep, len(left))):
            u = int(hashlib.md5(f"{seed}:{name}:{i}".encode()).hexdigest()[:12], 16) / 2**48
            w = reward[left]
            p = (1 - mix) * w / w.sum() + mix / len(left)
            at = min(int(np.searchsorted(np.cumsum(p / p.sum()), u, side="left")), len(left) - 1)
            got.append(left.pop(at))
        return pdf.iloc[sorted(got)][[*group, node]]

    few = rows.filter(F.col("__n") <= keep).select(*group, node)
    return few.unionByName(rows.filter(F.col("__n") > keep).groupBy(*group).applyInPandas(run, schema))


def hermes_calls(content: Column) -> Column:
    """Tool calls as text: each JSON of an array<string> in a tool_call block."""
    blocks = F.transform(content, lambda c: F.concat(F.lit("<tool_call>\n"), c, F.lit("\n</tool_call>")))
    return F.array_join(blocks, "\n")


def hermes_parsed(text: Column) -> Column:
    """array<struct<name, arguments>> of the tool_call blocks in ``text``; blocks that are no JSON object with a name are left out."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    calls = F.transform(blocks, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull())


def react_calls(name: Column, arguments: Column) -> Column:
    """A tool call in the words of a reasoning and acting agent."""
    return F.concat(F.lit("Action: "), name, F.lit("\nAction Input: "), F.coalesce(arguments, F.lit("{}")))


def partitioned_pools(pool: Column, key: Column, pools: int, seed: int = 42) -> Column:
    """array<array<string>>: the models of ``pool`` dealt in turn to ``pools`` children, in the order of the md5 of seed, key and model."""
    def digest(m: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), key, m))

    order = F.transform(F.array_sort(F.transform(F.array_distinct(pool), lambda m: F.struct(digest(m).alias("d"), m.alias("m")))), lambda x: x["m"])
    return F.transform(F.sequence(F.lit(0), F.lit(pools - 1)), lambda i: F.filter(order, lambda m, k: k % pools == i))


def informative() -> Column:
    """Whether a delegate's answer could be read, states a confidence, and says something."""
    said = truthy(F.trim("delegate_answer")).isNotNull() | truthy(F.trim("delegate_evidence")).isNotNull()
    return F.coalesce((F.col("action") == "delegate") & F.col("delegate_parse_ok") & F.col("delegate_confidence").isNotNull() & said, F.lit(False))


def kept_for_training(paths: DataFrame, nodes: DataFrame, scope: Sequence[str], leaf: str, node: str, least: int, most: int, order: Sequence[Column]) -> DataFrame:
    """scope, node, kind ('delegate' or 'submit'): the nodes kept of the ``most`` first paths of every scope, by ``order``.

    ``paths`` has a row per right path with node_ids and its leaf; of a path
    the informative delegates are kept, and the submit if they are ``least``.
    """
    w = Window.partitionBy(*scope).orderBy(*order, leaf)
    chosen = paths.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    steps = chosen.select(*scope, F.col(leaf).alias("__leaf"), F.explode("node_ids").alias(node))
    marked = nodes.select(*scope, node, informative().alias("__told"))
    on = materialize(steps.join(marked.hint("merge"), [*scope, node]).filter("__told").drop("__told"), "kept")
    told = on.groupBy(*scope, "__leaf").agg(F.count("*").alias("__n"))
    submits = chosen.select(*scope, F.col(leaf).alias("__leaf"))
    submits = submits if least <= 0 else submits.join(told.filter(F.col("__n") >= least).hint("merge"), [*scope, "__leaf"], "left_semi")
    delegates = on.select(*scope, node).distinct().withColumn("kind", F.lit("delegate"))
    return delegates.unionByName(submits.select(*scope, F.col("__leaf").alias(node), F.lit("submit").alias("kind")))


def wrapped_tool(tool: Column) -> Column:
    """A tool's JSON as {"type": "function", "function": ..}, unless it has either key already; null stays null."""
    has = F.get_json_object(tool, "$.type").isNotNull() | F.get_json_object(tool, "$.function").isNotNull()
    return F.when(has, tool).otherwise(F.concat(F.lit('{"type":"function","function":'), tool, F.lit("}")))


def bare_tool(tool: Column) -> Column:
    """The function of a wrapped tool's JSON; others unchanged."""
    inner = F.get_json_object(tool, "$.function")
    return F.when(F.get_json_object(tool, "$.type").isNotNull() & inner.isNotNull(), inner).otherwise(tool)


def tool_name(tool: Column) -> Column:
    """The name a model calls a tool by."""
    plain = bare_tool(tool)
    return F.coalesce(truthy(F.get_json_object(plain, "$.name_for_model")), F.get_json_object(plain, "$.name"))


def array_statistics(values: Column) -> Column:
    """struct(mean, std, least, most, size) of an array of numbers or of arrays of numbers, which are summed first.

    The deviation is the population's; null items are left out, and an array without any has nulls and size 0.
    """
    items = F.filter(values, lambda x: x.isNotNull())
    n = F.size(items)
    mean = F.aggregate(items, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    off = F.aggregate(items, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(n, F.lit(0))
    return F.struct(mean.alias("mean"), F.sqrt(off).alias("std"), F.array_min(items).alias("least"), F.array_max(items).alias("most"), n.alias("size"))


def summed(nested: Column) -> Column:
    """An array of arrays of numbers as the array of their sums; null items count 0."""
    return F.transform(nested, lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0))))


#: What an exported row has, by how much is wanted of it.
RECORDS = {
    "minimal": ("messages", "answer", "expected_acc_reward"),
    "standard": ("messages", "answer", "expected_acc_reward", "task_id", "node_id", "parent_id"),
}


def record(df: DataFrame, level: str, key: str) -> DataFrame:
    """``key`` and the columns of RECORDS, or all columns for 'full'."""
    return df if level == "full" else df.select(key, *RECORDS[level])
