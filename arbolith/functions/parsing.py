"""What models wrote, parsed: JSON payloads, answers, tool calls, and overlap metrics. Python runs in Arrow batches."""

from __future__ import annotations

import ast
import json
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.functions import scalars as S

METRICS = ["rouge_1", "rouge_2", "rouge_l", "bleu_4"]
FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
THINKING = re.compile(r"<think>.*?</think>", re.S | re.I)
#: A backslash with what JSON lets follow it, or alone.
ESCAPE = re.compile(r'\\(?:["\\/bfnrtu]|())')
#: Strings, which hide the braces in them, and braces.
BRACES = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.S)
#: How a payload's final answer states a letter.
BARE = re.compile(r"[({]?\s*([A-Ja-j])\s*[)}.\\]?")
STATED = re.compile(r"(?:answer|choice|option)\s*(?:is|:)\s*\(?([A-Ja-j])\)?", re.I)
TRAILING = re.compile(r"\b([A-Ja-j])\s*[.)]*\s*$")
BOXED = re.compile(S.BOXED)


def _loads(text: str) -> dict | None:
    for t in (text, ESCAPE.sub(lambda m: m[0] if m[1] is None else r"\\", text)):
        try:
            found = json.loads(t)
        except (ValueError, RecursionError):
            continue
        return found if isinstance(found, dict) else None
    return None


def _objects(text: str) -> Iterator[str]:
    """What stands between outermost braces, in order."""
    depth = start = 0
    for m in BRACES.finditer(text):
        if m[0] == "{":
            start = start if depth else m.start()
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                yield text[start : m.end()]


def find_object(text: str | None) -> dict | None:
    """The JSON object in ``text``, the last that can be read of: the first fenced block, the whole text, what lies between its
    first and last brace, and each balanced object; all of them with and without thinking blocks, lost escapes mended.
    """
    if not text or "{" not in text:
        return None
    both = (text, THINKING.sub("", text).strip())
    parts = [m[1] for t in both if (m := FENCED.search(t))] + [*both]
    parts += [t[t.find("{") : t.rfind("}") + 1] for t in both]
    parts += [x for t in both for x in _objects(t)]
    for part in reversed(dict.fromkeys(x.strip() for x in parts)):
        found = _loads(part) if part else None
        if found is not None:
            return found
    return None


@F.pandas_udf(T.StringType())
def json_object(texts: pd.Series) -> pd.Series:
    """The object of :func:`find_object` as compact JSON with sorted keys, null if there is none."""
    return texts.map(lambda t: None if (o := find_object(t)) is None else json.dumps(o, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def _one_boxed(text: str) -> tuple[str | None, bool]:
    """(the boxed letter, whether several differ)."""
    letters = {x.upper() for x in BOXED.findall(text.replace("\boxed", "\\boxed"))}
    return (letters.pop(), False) if len(letters) == 1 else (None, bool(letters))


def answer_of(text: str | None) -> str | None:
    """The letter that a reply gives, with or without a JSON payload.

    The payload's boxed_letter if it is one letter; else its final_answer's box
    (boxes that differ end the search) or bare letter; else the reply's own
    box; else the letter that final_answer states, ends in, or names alone.
    """
    if text is None:
        return None
    payload = find_object(text) or {}
    letter, final = payload.get("boxed_letter"), payload.get("final_answer")
    if isinstance(letter, str) and len(letter.strip()) == 1 and letter.strip().isalpha():
        return letter.strip().upper()
    if isinstance(final, str):
        boxed, differ = _one_boxed(final)
        bare = BARE.fullmatch(final.strip().strip("'\"").strip())
        if boxed or differ or bare:
            return None if differ else boxed or bare[1].upper()
    boxed, _ = _one_boxed(text)
    if boxed or not isinstance(final, str):
        return boxed
    found = STATED.search(final) or TRAILING.search(final.strip())
    named = {x for x in final.upper() if "A" <= x <= "J"}
    return found[1].upper() if found else named.pop() if len(named) == 1 else None


@F.pandas_udf(T.StringType())
def payload_answer(texts: pd.Series) -> pd.Series:
    """:func:`answer_of` of each text."""
    return texts.map(answer_of)


@F.pandas_udf(T.DoubleType())
def payload_confidence(texts: pd.Series) -> pd.Series:
    """The confidence of the text's JSON payload, clamped to 0..1; null without a payload or number."""

    def one(text: str | None) -> float | None:
        try:
            return max(0.0, min(1.0, float((find_object(text) or {})["confidence"])))
        except (KeyError, TypeError, ValueError):
            return None

    return texts.map(one)


def confidence(c: str | Column) -> Column:
    """The payload's confidence, else what the text states, see :func:`arbolith.functions.scalars.confidence`."""
    return F.coalesce(payload_confidence(S.col(c)), S.confidence(c))


def thinking_block(thinking: Column, text: Column) -> Column:
    """The text after its thinking in tags, if there is any."""
    return F.when(S.truthy(thinking).isNotNull(), F.concat(F.lit("<think>\n"), thinking, F.lit("\n</think>\n"), F.coalesce(text, F.lit("")))).otherwise(text)


def delimited(text: Column, keys: Sequence[str]) -> Column:
    """array<struct<key, content>>: the text cut before each key; what comes before the first has the key ''."""
    any_key = "|".join(re.escape(k) for k in keys)
    parts = F.filter(F.split(text, f"(?={any_key})"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, f"^({any_key})?", 1).alias("key"), F.regexp_replace(p, f"^(?:{any_key})", "").alias("content")))


def span_weights(text: Column, weights: dict[str, tuple[float, float]]) -> Column:
    """array<struct<content, weight>>: each key with its first weight, what follows it with the second; 1 before the first key."""
    table = F.create_map(*[x for k, (a, b) in weights.items() for x in (F.lit(k), F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")))])
    spans = F.transform(
        delimited(text, list(weights)),
        lambda s: F.array(
            F.struct(s["key"].alias("content"), F.coalesce(F.element_at(table, s["key"])["a"], F.lit(1.0)).alias("weight")),
            F.struct(s["content"].alias("content"), F.coalesce(F.element_at(table, s["key"])["b"], F.lit(1.0)).alias("weight")),
        ),
    )
    return F.filter(F.flatten(spans), lambda s: s["content"] != "")


def pattern_weights(text: Column, weights: dict[str, float], prompt: Column | None = None, prompts: dict[str, float] | None = None) -> Column:
    """array<struct<content, weight>>: each stretch that a pattern matches with its weight, the rest with 1.

    Where ``prompt`` contains a key of ``prompts``, the first of them weighs the whole text instead.
    """
    any_ = "|".join(f"(?:{p})" for p in weights)
    marked = F.regexp_replace(text, f"({any_})", "\u0001$1\u0002")
    pieces = F.filter(F.split(marked, "(?=\u0001)|(?<=\u0002)"), lambda p: p != "")

    def weighed(piece: Column) -> Column:
        content, weight = F.regexp_replace(piece, "[\u0001\u0002]", ""), F.lit(1.0)
        for p, w in reversed(weights.items()):
            weight = F.when(piece.startswith("\u0001") & content.rlike(f"^(?:{p})$"), float(w)).otherwise(weight)
        return F.struct(content.alias("content"), weight.alias("weight"))

    out = F.transform(pieces, weighed)
    for key, w in reversed((prompts or {}).items()):
        whole = F.array(F.struct(text.alias("content"), F.lit(float(w)).alias("weight")))
        out = F.when(F.coalesce(F.contains(prompt, F.lit(key)), F.lit(False)), whole).otherwise(out)
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def literal_pairs(texts: pd.Series) -> pd.Series:
    """A history written as a Python literal, [['query', 'response'], ..]; null where it is none."""

    def one(text: str | None) -> list | None:
        try:
            rows = ast.literal_eval(text)
            return [[None if x is None else str(x) for x in r] for r in rows]
        except (TypeError, ValueError, SyntaxError, MemoryError, RecursionError):
            return None

    return texts.map(one)


UNIT = re.compile(r"[\u3400-\u9fff]|[^\s\u3400-\u9fff]+")


def _f1(hits: float, a: float, b: float) -> float:
    return 2 * hits / (a + b) if hits else 0.0


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, by rows of the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def overlap(prediction: str | None, label: str | None) -> tuple[float, float, float, float] | None:
    """ROUGE-1, ROUGE-2, ROUGE-L (F) and BLEU-4 in per cent over words; None if a side has none.

    A word is what stands between white space; Chinese characters, which no
    space separates, are words of their own (no dictionary is at hand).

    An order without matches counts as 1 / (2^k * n-grams), k growing by one with each such order.
    """
    p, y = UNIT.findall(prediction or ""), UNIT.findall(label or "")
    if not p or not y:
        return None
    grams = [[Counter(zip(*(t[i:] for i in range(n)))) for t in (p, y)] for n in range(1, 5)]
    hits = [sum((a & b).values()) for a, b in grams]
    sums = [[sum(c.values()) for c in g] for g in grams]
    logs, k = 0.0, 0
    for h, (n, _) in zip(hits, sums):
        if not h:
            k += 1
        logs += math.log(h / n if h else 1 / (2**k * max(n, 1))) / 4
    brevity = 1.0 if len(p) > len(y) else math.exp(1 - len(y) / len(p))
    return tuple(round(100 * x, 6) for x in (_f1(hits[0], *sums[0]), _f1(hits[1], *sums[1]), _f1(lcs(p, y), len(p), len(y)), brevity * math.exp(logs)))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in METRICS]))
def overlap_metrics(predictions: pd.Series, labels: pd.Series) -> pd.DataFrame:
    """:func:`overlap` of each row, nulls where a side has no words."""
    rows = [overlap(p, y) or (None,) * 4 for p, y in zip(predictions, labels)]
    return pd.DataFrame(rows, columns=METRICS)


def action_match(name: str, arguments: str, want_name: str, want_arguments: str) -> float:
    """F1 of two tool calls: 0 for other names; by key, 1 for an equal value and 0.5 for the key alone; else ROUGE-L of the texts."""
    if name.strip() != want_name.strip():
        return 0.0
    a, b = find_object(arguments), find_object(want_arguments)
    if a is None or b is None:
        x, y = arguments.split(), want_arguments.split()
        return 1.0 if x == y else _f1(lcs(x, y), len(x), len(y))
    if not a and not b:
        return 1.0
    return _f1(sum(1.0 if b[k] == v else 0.5 for k, v in a.items() if k in b), len(a), len(b))


@F.pandas_udf(T.DoubleType())
def tool_reward(names: pd.Series, arguments: pd.Series, want_names: pd.Series, want_arguments: pd.Series) -> pd.Series:
    """1 where the call is exactly the wanted one, else 0; nulls count as empty."""
    rows = zip(*(s.fillna("") for s in (names, arguments, want_names, want_arguments)))
    return pd.Series([float(action_match(*r) == 1.0) for r in rows], dtype="float64")


def scrubbed(value: object, mark: str = "_token") -> object:
    """``value`` with the strings under keys that contain ``mark`` as None, at any depth."""
    if isinstance(value, dict):
        return {k: None if mark in k and isinstance(v, str) else scrubbed(v, mark) for k, v in value.items()}
    return [scrubbed(v, mark) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def scrub_json(texts: pd.Series) -> pd.Series:
    """JSON with the strings under keys with _token as null; what is no JSON as null."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(scrubbed(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


def fence_split(text: Column, fence: str = "```python") -> tuple[Column, Column]:
    """(what comes before the first fence, the fence and all after it); the second is null without one."""
    at = F.instr(text, fence)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), F.when(at > 0, F.substring(text, at, F.length(text)))
