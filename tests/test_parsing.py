import json
import math

from pyspark.sql import functions as F

from arbolith.functions import parsing as P
from arbolith.functions import scalars as S


def test_find_object():
    assert P.find_object('x ```json\n{"a": 1}\n``` y {"b": 2}') == {"b": 2}  # a bare object wins over a fenced one
    assert P.find_object('{"b": 2} y ```json\n{"a": 1}\n```') == {"b": 2}
    assert P.find_object('{"a": 1} then {"b": {"c": "}"}} end') == {"b": {"c": "}"}}
    assert P.find_object('<think>{"a": 1}</think> {"b": 2}') == {"a": 1}  # the thought's object comes as one more balanced one
    assert P.find_object('<think>{"a": }</think> {"b": 2}') == {"b": 2}
    assert P.find_object('{"a": "\\boxed{A} \\alpha"}')["a"].endswith("\\alpha")
    assert P.find_object(r'{"a": "\\ \d é"}') == {"a": "\\ \\d é"}
    assert P.find_object('say "{" then {"a": 1}') == {"a": 1}
    assert P.find_object('{"a": 1} {broken}') == {"a": 1}
    assert P.find_object("{broken") is None and P.find_object(None) is None and P.find_object("[1]") is None


def test_payload_answer(spark):
    cases = {
        '{"boxed_letter": " z "}': "Z",
        '{"boxed_letter": "AB", "final_answer": "\\\\boxed{c}"}': "C",
        '{"final_answer": "\\\\boxed{c} \\\\boxed{d}"} \\boxed{A}': None,
        '{"final_answer": "(b)."}': "B",
        '{"final_answer": "\'(B)\'"}': "B",
        '{"final_answer": "so it is none"} \\boxed{E}': "E",
        '{"final_answer": "The answer is (d), I think"}': "D",
        '{"final_answer": "so I take c."}': "C",
        '{"final_answer": "it lies 2 km off; d or d"}': "D",
        '{"final_answer": "DDD 44"}': "D",
        '{"final_answer": "none of A and B"}': "B",
        '{"answer": "B"}': None,
        "\\boxed{C}": "C",
        "\\boxed{C} \\boxed{D}": None,
        "The answer is D.": None,
        "": None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string")
    got = [r.x for r in df.select("i", P.payload_answer("t").alias("x")).orderBy("i").collect()]
    assert got == [*cases.values(), None]


def test_confidence(spark):
    cases = {'{"confidence": "0.4"} confidence: 0.9': 0.4, '{"confidence": 7}': 1.0, '{"confidence": "high"} 30%': 0.3, "Confidence = 85": 0.85, "none": None}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    assert [r.x for r in df.select("i", P.confidence("t").alias("x")).orderBy("i").collect()] == list(cases.values())


def test_letters(spark):
    cases = [
        ("C) text", "C", None, None, None),
        ("so b", None, None, None, None),
        ("['D', 'A']", "D", None, None, None),
        ("[2]", "C", None, None, None),
        ("1", "B", None, None, None),
        ("9", None, None, None, None),
        ("Z", None, None, None, None),
        ("\\boxed{A} \\boxed{B} answer: C", "B", "C", "A", "A"),
        ("<answer>E</answer> \\boxed{A}", "A", "A", "E", "A"),
        ("The best option is (B). Not C, D", None, None, "B", None),
        ("I take A, then B. ok", None, None, "B", None),
        ("answer: **C** or answer: D", "A", "D", "C", "D"),
        ("Final answer J", "F", None, "J", "J"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    n = F.lit(6)
    got = df.select("i", S.answer_letter("t", n).alias("a"), S.predicted_letter("t", n).alias("p"), S.flexible_answer("t").alias("f"), S.stated_letter("t").alias("s")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in cases]


def test_overlap(spark):
    assert P.lcs("abcbdab", "bdcaba") == 4
    same = P.overlap("a b c d e", "a b c d e")
    assert all(math.isclose(x, 100.0) for x in same)
    r1, r2, rl, bleu = P.overlap("the cat sat", "the cat stood still")
    assert math.isclose(r1, 100 * 4 / 7, abs_tol=1e-6) and math.isclose(r2, 100 * 2 / 5, abs_tol=1e-6) and math.isclose(rl, r1)
    want = math.exp(1 - 4 / 3) * math.exp((math.log(2 / 3) + math.log(1 / 2) + math.log(1 / 2) + math.log(1 / 4)) / 4)
    assert math.isclose(bleu, 100 * want, abs_tol=1e-5)
    assert math.isclose(P.overlap("质量不变", "质量 变")[0], 100 * 6 / 7, abs_tol=1e-6)
    df = spark.createDataFrame([("a", "a"), ("", "a"), (None, None)], "p string, y string")
    assert [r.m.rouge_1 for r in df.select(P.overlap_metrics("p", "y").alias("m")).collect()] == [100.0, None, None]


def test_action_match():
    assert P.action_match("f", '{"a": 1, "b": 2}', "f", '{"b": 2, "a": 1}') == 1.0
    assert P.action_match("f", '{"a": 1, "b": 3}', "f", '{"b": 2, "a": 1}') == 0.75
    assert P.action_match("g", "{}", "f", "{}") == 0.0
    assert P.action_match("f", "x y", "f", "x y") == 1.0


def test_spans(spark):
    df = spark.createDataFrame([("go A: one B: two A: three",), ("none",), ("",), (None,)], "t string")
    got = [r.s for r in df.select(P.span_weights(F.col("t"), {"A:": (2, 1), "B:": (3, 0)}).alias("s")).collect()]
    assert [(x.content, x.weight) for x in got[0]] == [("go ", 1.0), ("A:", 2.0), (" one ", 1.0), ("B:", 3.0), (" two ", 0.0), ("A:", 2.0), (" three", 1.0)]
    assert [(x.content, x.weight) for x in got[1]] == [("none", 1.0)] and got[2] == [] and got[3] is None


def test_json_object_is_compact_and_sorted(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",)], "t string")
    assert [r.o for r in df.select(P.json_object("t").alias("o")).collect()] == ['{"a":"é","b":1}', None]
    assert json.loads("{}") == {}


def test_scrubbed_and_fences(spark):
    assert P.scrubbed({"a_token": "x", "b": [{"c_token": 1, "d_token": "y"}]}) == {"a_token": None, "b": [{"c_token": 1, "d_token": None}]}
    df = spark.createDataFrame([("a ```python\nx",), ("none",), (None,)], "t string")
    head, code = P.fence_split(F.col("t"))
    assert [tuple(r) for r in df.select(head, code).collect()] == [("a ", "```python\nx"), ("none", None), (None, None)]


def test_pattern_weights_and_literals(spark):
    df = spark.createDataFrame([("12x3", "ask", "[['a', None], ['b', 2]]"), ("", None, "[broken"), (None, "key", None)], "t string, q string, h string")
    got = df.select(P.pattern_weights(F.col("t"), {r"\d+": 2.0, "x": 0.0}, F.col("q"), {"key": 5.0}).alias("s"), P.literal_pairs("h").alias("h")).collect()
    assert [(x.content, x.weight) for x in got[0].s] == [("12", 2.0), ("x", 0.0), ("3", 2.0)] and got[0].h == [["a", None], ["b", "2"]]
    assert got[1].s == [] and got[1].h is None and [(x.content, x.weight) for x in got[2].s] == [(None, 5.0)] and got[2].h is None
