import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbolith import storage
from arbolith.functions import scalars as S
from arbolith.operators import advantage, chats, ordering, preference, sampling, selection, trees
from arbolith.sources import catalog, files, registry
from arbolith.streaming import packing
from arbolith.tables import latest
from tests.compare import SMALL


def one(df):
    return df.collect()[0]


def test_latest_takes_nulls_last_and_null_keys_together(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, 1, "p"), (None, 2, "q")], "k string, v int, w string")
    assert {(r.k, r.w) for r in latest(df, ["k"], ["v"]).collect()} == {("a", "y"), (None, "q")}


def test_broadcast_only_below_the_bound(spark):
    small = spark.range(10)
    assert "broadcast" in storage.small_side(small)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in storage.small_side(small, limit=1)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0], [5.0], [2.0, 2.0], [None, 1.0, float("nan"), 3.0]])
def test_advantages(spark, values):
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(values)], "i int, g string, r double")
    clean = [v for v in values if v is not None and v == v]
    mean = sum(clean) / len(clean)
    got = {r.i: r.advantage for r in advantage.group_mean(df, ["g"], "r").collect()}
    for i, v in enumerate(values):
        want = 0.0 if len(values) < 2 else None if v is None or v != v else v - mean
        assert got[i] == want if want is None else math.isclose(got[i], want)
    std = np.std(clean, ddof=1) if len(clean) > 1 else 0.0
    got = {r.i: r.advantage for r in advantage.grpo(df, ["g"], "r").collect()}
    for i, v in enumerate(values):
        if v is not None and v == v:
            assert math.isclose(got[i], (v - mean) / (std + 1e-4), abs_tol=1e-9)


def test_rank_advantage_divides_by_rows_not_by_distinct_values(spark):
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate([1.0, 1.0, 2.0, 3.0])], "i int, g string, r double")
    assert [r.advantage for r in advantage.rank(df, ["g"], "r").orderBy("i").collect()] == [-0.5, -0.5, 1 / 3 - 0.5, 2 / 3 - 0.5]


def test_empty_group_operators(spark):
    df = spark.createDataFrame([], "i int, g string, r double")
    for f in (advantage.group_mean, advantage.rank, advantage.grpo, advantage.reinforce_plus):
        assert f(df, ["g"], "r").count() == 0


def test_best_and_worst_needs_two_answers(spark):
    rows = [("p", "a", 1.0, 0), ("p", "a", 5.0, 1), ("p", "b", 2.0, 2), ("q", "a", 1.0, 3), ("q", "a", 2.0, 4), ("n", None, 1.0, 5)]
    got = preference.best_and_worst(spark.createDataFrame(rows, "p string, a string, s double, o int"), ["p"], "a", "s", "o").collect()
    assert [(r.p, r.chosen, r.rejected, r.chosen_score, r.rejected_score) for r in got] == [("p", "a", "b", 5.0, 2.0)]


def test_positions_and_running_totals(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 37) % 1000).repartition(7)
    got = ordering.positions(df, ["x"]).collect()
    assert all(r.position == r.x for r in got)
    total = ordering.running_total(df, ["x"], "x", "upto").collect()
    assert all(r.upto == r.x * (r.x + 1) // 2 for r in total)


def test_sampling_is_exact_at_any_size(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    for n in (0, 3, 10, 27):
        assert sampling.sample_exactly(df, n, 42, "k").count() == n
    assert {r.part: r["count"] for r in sampling.split(df, 0.25, 1, "k").groupBy("part").count().collect()} == {"val": 2, "train": 8}
    with pytest.raises(ValueError):
        sampling.split(spark.range(1), 0.5, 1, "id")


@pytest.mark.parametrize(("n", "rows"), [(1, 5), (3, 10), (7, 7), (4, 3)])
def test_contiguous_shards_follow_even_spacing(spark, n, rows):
    got = [r.shard for r in sampling.contiguous_shards(spark.range(rows), ["id"], n).orderBy("id").collect()]
    ends = np.linspace(0, rows, n + 1).astype(int)
    assert got == [int(np.searchsorted(ends, i, side="right")) - 1 for i in range(rows)]


def test_packing_keeps_every_item_and_the_capacity(spark):
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 70, 400)] + [250]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
    packed = sampling.pack_sequences(df, "i", "n", 100, 50, ["i"], -(-df.count() // 3))
    assert sorted(r.i for r in packed.collect()) == list(range(401))
    for r in sampling.bin_totals(packed, df, "i", "n").collect():
        assert r.total <= 100 or r.items == 1


def test_packed_stream_keeps_the_capacity(spark):
    path = storage.scratch(spark, "t")
    spark.range(200).select(F.col("id"), (F.col("id") * 7 % 40 + 1).alias("n"), (F.col("id") % 2).alias("s")).repartition(5).write.parquet(path)
    rows = packing.read_stream(spark, path, "id long, n long, s long")
    got = packing.run_once(packing.packed_stream(rows, "s", "id", "n", 100)).collect()
    assert len({r.item for r in got}) == len(got)
    assert all(r.total <= 100 for r in got)
    left = 200 - len(got)
    assert 0 < left <= 2 * 100  # only the open containers are held back


def test_packed_intervals_bring_out_every_item(spark):
    path = storage.scratch(spark, "t")
    size = F.when(F.col("id") == 5, 250).otherwise(F.col("id") * 7 % 40 + 1).cast("long")
    spark.range(700).select(F.col("id"), size.alias("n"), (F.col("id") % 2).alias("s")).repartition(3).write.parquet(path)
    rows = packing.read_stream(spark, path, "id long, n long, s long")
    got = packing.run_to_end(packing.packed_intervals(rows, "s", "id", "n", 100), path, "s", "id", "n").collect()
    assert sorted(r.item for r in got) == list(range(700))
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin, r.total), []).append(250 if r.item == 5 else r.item * 7 % 40 + 1)
    assert all(sum(ns) == total and (total <= 100 or len(ns) == 1) for (_, _, total), ns in bins.items())
    assert len({k[:2] for k in bins}) == len(bins)


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([("a", 3), ("b", 6), ("c", 7), ("d", 2), ("e", 12)], 10) == [[("e", 12)], [("c", 7), ("a", 3)], [("b", 6), ("d", 2)]]
    assert packing.best_fit([], 10) == []


def test_m17_has_every_document(spark):
    from arbolith.plans import streams

    got = [r.item for r in streams.m17_packed_stream(spark, SMALL).select("item").collect()]
    assert sorted(got) == sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())


def test_shift_in_batches_stays_in_a_long_group(spark, tmp_path):
    from arbolith.plans import preferences

    n = F.col("id")
    user = F.when(n < 80_010, 1).otherwise(2).cast("long")
    spark.range(80_020).select(n.alias("event_id"), user.alias("user_id"), F.lit("x").alias("event_type"), n.cast("double").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.shifted for r in preferences.w11_shift(spark, str(tmp_path)).filter("event_id >= 80000").collect()}
    want = {}
    for first, last in ((80_000, 80_008), (80_008, 80_010), (80_010, 80_018), (80_018, 80_020)):
        want |= {i: str((last if i == first else i) - 1) for i in range(first, last)}
    assert got == want


@pytest.mark.parametrize("left", [False, True])
def test_truncation_protects_tokens(spark, left):
    rng = np.random.default_rng(5)
    rows = [[] if i == 0 else [str(x) for x in rng.choice(["the", "a", "b", "c"], rng.integers(1, 12))] for i in range(60)] + [["the"] * 9, None]

    def brute(ws):
        if ws is None or len(ws) <= 5:
            return ws
        free = [i for i, w in enumerate(ws) if w != "the"]
        room = max(5 - (len(ws) - len(free)), 0)
        kept = set(free[len(free) - room :] if left else free[:room])
        return [w for i, w in enumerate(ws) if w == "the" or i in kept]

    df = spark.createDataFrame(list(enumerate(rows)), "i int, w array<string>")
    got = {r.i: r.t for r in df.select("i", chats.truncated(F.col("w"), 5, left, ["the"]).alias("t")).collect()}
    assert got == {i: brute(ws) for i, ws in enumerate(rows)}


def test_dialogue_keeps_lines_of_a_turn(spark):
    df = spark.createDataFrame([("\n\nHuman: a\nb\n\nc\n\n\nAssistant: \u00a0d\n- e \n",)], "t string")
    got = one(df.select(chats.dialogue(F.col("t")).alias("m"))).m
    assert [(m.role, m.content) for m in got] == [("user", "a\nb\n\nc"), ("assistant", "d\n- e")]


def test_spread_keeps_the_ends_and_goes_far(spark):
    rows = [("p", f"n{i}", v) for i, v in enumerate([0.0, 0.1, 0.5, 0.9, 1.0, 0.05, 0.95, 0.55, 0.45])]
    df = spark.createDataFrame(rows, "p string, n string, v double")
    kept = {r.n for r in trees.spread_children(df, ["p"], "n", "v", 3, 3).collect()}
    assert kept == {"n4", "n0", "n2"}
    few = spark.createDataFrame(rows[:3], "p string, n string, v double")
    assert trees.spread_children(few, ["p"], "n", "v", 1, 1).count() == 3


def test_spread_ties_and_rounds_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("pqr"), f"n{i:03d}", rng.choice([0.0, 0.25, 0.5, 1.0, None]), rng.randrange(3), rng.randrange(3)) for i in range(90)]
    rows += [(None, f"m{i}", 0.5, 0, 0) for i in range(5)] + [("few", "a", 1.0, 0, 0), ("few", "b", 0.0, 0, 0)]
    df = spark.createDataFrame(rows, "p string, n string, v double, c int, t int")
    width = {r.p: r.k for r in trees.spread_width(df, ["p"], "v", 3, 7).collect()}
    want = set()
    for p in {r[0] for r in rows}:
        kids = sorted(((v or 0.0, c, t, n) for q, n, v, c, t in rows if q == p), key=lambda x: (-x[0], -x[1], -x[2], x[3]))
        kept = kids[: width[p]] if len(kids) < 4 or width[p] >= len(kids) else [kids[0], kids[-1]][: width[p]]
        while len(kept) < min(width[p], len(kids)):
            gaps = lambda x: [abs(x[0] - y[0]) for y in kept]  # noqa: B023, E731
            kept.append(max((x for x in kids if x not in kept), key=lambda x: (min(gaps(x)), round(sum(gaps(x)) / len(kept), 12), x[0], x[2], x[3])))
        want |= {(p, x[3]) for x in kept}
    for room in (1000, 3):
        assert {(r.p, r.n) for r in trees.spread_children(df, ["p"], "n", "v", 3, 7, "c", "t", room).collect()} == want


def test_messages(spark):
    talk = [[("user", "a", None), ("user", "b", None), ("assistant", "<think>x</think> c", None), ("user", "d", None)], [], None, [("human", None, None)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(talk)], f"i int, m {chats.MESSAGES}")
    m = F.col("m")
    got = df.select("i", chats.valid(m).alias("v"), chats.last_user(m).alias("u"), chats.merged(m).alias("g"), chats.without_history_thinking(m).alias("t")).orderBy("i").collect()
    assert [r.v for r in got] == [True, False, False, False]
    assert got[0].u == 3 and got[1].u == -1
    assert [x.content for x in got[0].g] == ["ab", "<think>x</think> c", "d"]
    assert got[0].t[2].content == "c"
    assert got[2].g is None


def test_renames_never_merge_columns(spark):
    assert chats.rename_map(["Query", "prompt", "x"], {"query": "q", "prompt": "q"}) == {}
    assert chats.rename_map(["A", "b"], {"a": "b"}) == {}
    assert chats.rename_map(["A", "c"], {"a": "b"}) == {"A": "b"}


def test_scalars(spark):
    df = spark.createDataFrame([("node_12", "\\boxed{b} or \x08oxed{\\text{B}}", "Confidence: 85", ["x", "Y"]), ("root", "", None, [])], "a string, b string, c string, o array<string>")
    r = df.select(
        S.suffix_number("a").alias("n"), S.unique_boxed("b").alias("u"), S.confidence("c").alias("c"), S.answer_index(F.lit("y"), "o").alias("i"), S.answer_letter(F.lit("['D']"), F.lit(4)).alias("l")
    ).collect()
    assert (r[0].n, r[0].u, r[0].c, r[0].i, r[0].l) == (12, "B", 0.85, 1, "D")
    assert (r[1].n, r[1].u, r[1].c, r[1].i) == (0, None, None, 0)


def test_dataset_syntax():
    no = lambda p: False
    assert catalog.parse("hf::a/b:x/y#5", no) == catalog.Request("a/b", "hf", ("x", "y"), 5)
    assert catalog.parse("a", no) == catalog.Request("a")
    assert catalog.parse("/p:q#1", lambda p: p == "/p:q") == catalog.Request("/p:q", count=1)
    with pytest.raises(ValueError):
        catalog.parse("a#x#y:", no)


def test_catalog_subsets():
    c = catalog.Catalog()
    c.register_json(json.dumps([{"name": "d", "path": "/d", "subsets": ["a", {"name": "w", "weak": True}]}]))
    with pytest.raises(ValueError):
        c.register(catalog.Dataset("d", "/e"))
    d = c.find("team/d")
    with pytest.raises(ValueError):
        c.select(d, [])
    assert [s.name for s in c.select(d, ["all"])] == ["a"]
    assert [s.name for s in c.select(d, ["new"])] == ["new"]


def test_id_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("# all\nx1 # why\n\nx2\n")
    (tmp_path / "in" / "b.jsonl").write_text('{"task_id": "x3"}\n{"idx": 4}\n\n"not an object"\n')
    (tmp_path / "c.json").write_text('["x5", {"id": "x6"}]')
    (tmp_path / "d.json").write_text('{"task_ids": ["x7", "x1"]}')
    assert {r.id for r in files.read_ids(spark, str(tmp_path)).collect()} == {"x1", "x2", "x3", "4", "x5", "x6", "x7"}


def test_csv_keeps_empty_cells_and_na(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n,NA\n"",null\n1,"a ""b"""\n')
    assert sorted(map(tuple, files.read(spark, str(tmp_path / "a.csv")).collect())) == [("", "NA"), ("", "null"), ("1", 'a "b"')]


def test_registry_refuses_doubles():
    r = registry.Registry("thing")
    r.add("a")(1)
    with pytest.raises(ValueError):
        r.add("a")(2)
    with pytest.raises(KeyError):
        r["b"]


def test_negatives_are_others_and_at_most_k(spark):
    df = spark.createDataFrame([(i, f"r{i % 5}" if i else None) for i in range(20)], "k int, r string")
    own = {i: f"r{i % 5}" if i else None for i in range(20)}
    got = {r.k: r.negatives for r in sampling.negatives(df, "k", "r", 6, 1).collect()}
    assert all(own[k] not in v and len(v) <= 6 and None not in v for k, v in got.items())
    assert sampling.negatives(df.limit(1), "k", "r", 6, 1).count() == 0


def test_streams_resume_from_their_folder(spark, tmp_path):
    rows = spark.range(10).selectExpr("id AS a", "id * 2 AS b")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: packing.read_stream(spark, str(tmp_path / "in"), "a long, b long")
    assert packing.run_once(stream(), out=str(tmp_path / "out")).count() == 10
    rows.filter("a < 3").write.mode("append").parquet(str(tmp_path / "in"))
    assert packing.run_once(stream(), out=str(tmp_path / "out")).count() == 13


def test_ranks_within(spark):
    rows = [(g, i) for i, g in enumerate(["a"] * 50 + [None] * 7 + ["b"])]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = {(r.g, r.i): (r.rank, r.size) for r in ordering.ranks_within(df, "g", ["i"]).collect()}
    assert got == {(g, i): (i + 1, 50) if g == "a" else (i - 49, 7) if g is None else (1, 1) for g, i in rows}
    assert ordering.ranks_within(df.limit(0), "g", ["i"]).count() == 0


def test_released_tables_are_gone(spark):
    before = storage.mark()
    path = storage.materialize(spark.range(3)).inputFiles()[0]
    assert storage.mark() == before + 1
    storage.release(before)
    assert not os.path.exists(path.removeprefix("file://"))


def test_sampled_children(spark):
    rows = [(p, f"n{i:02d}", float(i % 2)) for p in ("p", None) for i in range(40)] + [("few", "a", 1.0), ("few", "b", None)]
    df = spark.createDataFrame(rows, "p string, n string, v double")
    got = selection.sampled_children(df, ["p"], "n", "v", 10, 0.0, 0.1).collect()
    assert sorted((r.p or "", r.n) for r in got) == sorted({(r.p or "", r.n) for r in got}) and len(got) == 22
    odd = [int(r.n[1:]) % 2 for r in got if r.p != "few"]
    assert sum(odd) >= 19  # exp(10) to 1 for the children that are right
    even = [int(r.n[1:]) % 2 for r in selection.sampled_children(df, ["p"], "n", "v", 10, 1.0, 0.1).collect() if r.p != "few"]
    assert 4 <= sum(even) <= 16
    assert sorted(map(str, got)) == sorted(map(str, selection.sampled_children(df.repartition(7), ["p"], "n", "v", 10, 0.0, 0.1).collect()))


def test_interleaved_by_share(spark):
    a, b = spark.range(60).withColumn("k", F.lit("a")), spark.range(40).withColumn("k", F.lit("b"))
    first = selection.interleave_by_share([(a, ["id"]), (b, ["id"])], [3, 1]).orderBy("slot").collect()
    assert [r.slot for r in first] == list(range(len(first))) and (sum(r.k == "a" for r in first) == 60 or sum(r.k == "b" for r in first) == 40)
    every = selection.interleave_by_share([(a, ["id"]), (b, ["id"])], [3, 1], stop="all").orderBy("slot").collect()
    assert [r.id for r in every if r.k == "a"] == list(range(60)) and [r.id for r in every if r.k == "b"] == list(range(40))
    assert selection.interleave_by_share([(a, ["id"]), (b.limit(0), ["id"])], [1, 1]).filter("k = 'b'").count() == 0


def test_repairs_and_templates(spark):
    df = spark.createDataFrame([("[{a}{b}\n{c}\n  {d}]", "héllo wörld", None), (None, "", "x")], "lit string, t string, label string")
    spans = F.array(F.struct(F.lit(1).alias("a"), F.lit(3).alias("b")), F.struct(F.lit(6).alias("a"), F.lit(20).alias("b")))
    got = df.select(
        selection.mended_literal(F.col("lit")).alias("m"), selection.tagged_spans(F.col("t"), spans, "#").alias("s"),
        selection.teacher_prompt(F.col("t"), F.lit("{prompt}"), F.col("label"), "{prompt}|{answer}", "{label}|{prompt}|{answer}").alias("p"),
    ).collect()
    assert got[0].m == "[{a},{b},{c},{d}]" and got[0].s == "h#lo #" and got[1].m is None
    assert got[1].p is None


@pytest.mark.parametrize("weight", [0.0, 0.05, 0.9, 1.0])
def test_smooth_long_series_against_a_loop(spark, weight):
    rng = random.Random(2)
    rows = [(g, i, rng.choice([None, rng.random(), -5.0])) for g in ("a", None) for i in range(3000 if g else 40)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(6)
    got = {(r.g, r.i): r.smoothed for r in advantage.smooth(df, ["g"], ["i"], "v", weight).collect()}
    plain = {(r.g, r.i): r.x for r in df.select("g", "i", advantage.number("v").alias("x")).collect()}
    for g in ("a", None):
        x = n = 0.0
        for i in range(3000 if g else 40):
            v = plain[g, i]
            x, n = x * weight + (v if v is not None else 0.0), n * weight + 1
            assert math.isclose(got[g, i], x / n, rel_tol=1e-9, abs_tol=1e-12)


def test_registries_and_loss_scales(spark):
    assert registry.loss_scale_of("default") == ("default", "base") and registry.loss_scale_of("react") == ("default", "react")
    assert registry.loss_scale_of("last_round+hermes+x") == ("last_round", "hermes+x")
    df = spark.createDataFrame([("Thought: a Observation: b", "f", None, 1.0), (None, "g", "{}", None)], "t string, n string, a string, v double")
    row = df.select(registry.loss_scales["react"](F.col("t")).alias("s"), registry.dialects["hermes"](F.col("n"), F.col("a")).alias("h"), registry.dialects["react"](F.col("n"), F.col("a")).alias("r")).first()
    assert [(x.content, x.weight) for x in row.s] == [("Thought:", 1.0), (" a ", 1.0), ("Observation:", 2.0), (" b", 0.0)]
    assert row.h == '<tool_call>\n{"name": "f", "arguments": {}}\n</tool_call>' and row.r == "Action: f\nAction Input: {}"
    mean = registry.metrics["mean"]()
    assert mean.compute() is None
    mean.update(df, F.col("v"))
    mean.update(df.limit(0), F.col("v"))
    mean.update(df, F.lit(4.0))
    assert mean.compute() == 3.0
    mean.reset()
    assert mean.compute() is None
