"""Scalar functions and reward functions over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.functions import parsing as P
from arbolith.functions import scalars as S
from arbolith.plans.registry import Plans
from arbolith.tables import table

plans = Plans()
KEY = ["task_id", "node_id", "written_at", "loaded_at"]
K = "task_id, node_id, written_at, loaded_at"
FINAL = f"SELECT {K}, {{}} FROM search_nodes WHERE action = 'submit'"


def finals(spark, base):
    return table(spark, base, "search_nodes").filter("action = 'submit'").select(*KEY, "final_answer_text", "boxed_letter", "cost")


def tasks(spark, base):
    return table(spark, base, "tasks")


@plans.add(r"SELECT id, trim(regexp_replace(replace(lower(question), '<image>', ' '), '\s+', ' ', 'g')) AS question FROM tasks")
def f1_normal_question(spark, base):
    return tasks(spark, base).select("id", S.normal_question("question").alias("question"))


BOX = r"list_transform(regexp_extract_all(final_answer_text, '\\boxed\{\s*(?:\\text\{\s*)?([A-Za-z])\s*\}?\s*\}', 1), lambda x: upper(x))"


@plans.add(FINAL.format(BOX + " AS letters"))
def f2_boxed_letters(spark, base):
    return finals(spark, base).select(*KEY, S.boxed_letters("final_answer_text").alias("letters"))


@plans.add(FINAL.format(f"CASE WHEN len(list_distinct({BOX})) = 1 THEN ({BOX})[1] END AS letter"))
def f3_unique_boxed(spark, base):
    return finals(spark, base).select(*KEY, S.unique_boxed("final_answer_text").alias("letter"))


@plans.add(r"""WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Confidence: ' || CAST(floor(value) / 100 AS VARCHAR) WHEN 1 THEN 'confidence = ' || CAST(floor(value) AS VARCHAR)
        WHEN 2 THEN 'I am ' || floor(value) || '% sure' ELSE '50% {"confidence": "' || CAST(floor(value) / 40 AS VARCHAR) || '"}' END AS t, value FROM events),
    x AS (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN floor(value) / 40 END AS j, TRY_CAST(nullif(regexp_extract(lower(t), 'confidence\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS s,
        TRY_CAST(nullif(regexp_extract(t, '([0-9]+(?:\.[0-9]+)?)\s*%', 1), '') AS DOUBLE) AS p FROM c)
    SELECT event_id, round(greatest(0, least(1, coalesce(j, CASE WHEN s > 1 THEN s / 100 ELSE s END, p / 100))), 6) AS confidence FROM x""")
def f5_confidence(spark, base):
    e = table(spark, base, "events")
    kind, low = F.col("event_id") % 4, F.floor("value")
    text = (
        F.when(kind == 0, F.concat(F.lit("Confidence: "), (low / 100).cast("string")))
        .when(kind == 1, F.concat(F.lit("confidence = "), low.cast("double").cast("string")))
        .when(kind == 2, F.concat(F.lit("I am "), low.cast("string"), F.lit("% sure")))
        .otherwise(F.concat(F.lit('50% {"confidence": "'), (low / 40).cast("string"), F.lit('"}')))
    )
    return e.select("event_id", F.round(P.confidence(text), 6).alias("confidence"))


@plans.add(FINAL.format(r"regexp_replace(regexp_replace('<think>' || coalesce(boxed_letter, '') || '</think> ' || coalesce(final_answer_text, ''), '(?is)<think>.*?</think>', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text"))
def f7_without_thinking(spark, base):
    tagged = F.concat(F.lit("<think>"), F.coalesce("boxed_letter", F.lit("")), F.lit("</think> "), F.coalesce("final_answer_text", F.lit("")))
    return finals(spark, base).select(*KEY, S.without_thinking(tagged).alias("text"))


@plans.add(r"""WITH t AS (SELECT id, trim(answer) AS a, options, len(options) AS n FROM tasks),
    x AS (SELECT *, CASE WHEN regexp_full_match(a, '\d{1,9}') THEN CAST(a AS INTEGER) END AS d,
        CASE WHEN regexp_full_match(a, '\[?[''"(]?([A-Za-z])['')"]?\]?\.?') THEN ascii(upper(regexp_extract(a, '([A-Za-z])', 1))) - 65 END AS l FROM t)
    SELECT id, CAST(coalesce(CASE WHEN d < n THEN d WHEN d = n THEN d - 1 WHEN d IS NOT NULL THEN 0 END,
        CASE WHEN l BETWEEN 0 AND n - 1 THEN l END,
        nullif(list_position(list_transform(options, lambda o: lower(trim(o))), lower(a)), 0) - 1, 0) AS INTEGER) AS answer_index FROM x""")
def f8_answer_index(spark, base):
    return tasks(spark, base).select("id", S.answer_index("answer", "options").alias("answer_index"))


#: Answers as they are, as lists, as numbers and in sentences.
SPELT = "CASE ascii(right(id, 1)) % 4 WHEN 0 THEN '[' || chr(39) || answer || chr(39) || ', 0]' WHEN 1 THEN '(' || answer || ') as said' WHEN 2 THEN ' ' || (ascii(answer) - 65) ELSE answer END"


@plans.add(rf"""WITH w AS (SELECT id, trim({SPELT}) AS a, len(options) AS n FROM tasks),
    y AS (SELECT id, n, upper(trim(CASE WHEN a LIKE '[%' THEN split_part(a, chr(39), 2) ELSE a END)) AS a FROM w),
    x AS (SELECT id, n, CASE WHEN regexp_full_match(a, '\d+') THEN CAST(a AS INTEGER) ELSE ascii(nullif(regexp_extract(a, '([A-Z])', 1), '')) - 65 END AS i FROM y)
    SELECT id, CASE WHEN i BETWEEN 0 AND least(n, 26) - 1 THEN chr(65 + i) END AS letter FROM x""")
def f9_answer_letter(spark, base):
    return tasks(spark, base).select("id", S.answer_letter(F.expr(SPELT), F.size("options")).alias("letter"))


PRED = rf"""coalesce(CASE WHEN len(list_distinct({BOX})) = 1 THEN ({BOX})[1] END,
    CASE WHEN ascii(nullif(upper(regexp_extract(final_answer_text, '(?i)(?:answer|final answer)\s*[:：]\s*\(?\s*([A-Z])\s*\)?', 1)), '')) - 65 < 5
        THEN upper(regexp_extract(final_answer_text, '(?i)(?:answer|final answer)\s*[:：]\s*\(?\s*([A-Z])\s*\)?', 1)) END)"""


@plans.add(FINAL.format(PRED + " AS letter"))
def f10_predicted_letter(spark, base):
    return finals(spark, base).select(*KEY, S.predicted_letter("final_answer_text", F.lit(5)).alias("letter"))


@plans.add(FINAL.format(f"coalesce(CASE WHEN len(list_distinct({BOX})) = 1 THEN ({BOX})[1] END, " + ", ".join(f"nullif(upper(regexp_extract(final_answer_text, '{p}', 1)), '')" for p in S.PREDICTIONS) + ") AS letter"))
def f11_stated_letter(spark, base):
    return finals(spark, base).select(*KEY, S.stated_letter("final_answer_text").alias("letter"))


OPTIONS = r"""array_to_string(list_transform(options, lambda o, i: '(' || chr(64 + CAST(i AS INTEGER)) || ') ' || trim(regexp_replace(o, '^\s*\(?[A-Z][).:]\s+', ''))), chr(10))"""


@plans.add(f"SELECT id, {OPTIONS} AS options FROM tasks")
def f12_options_text(spark, base):
    return tasks(spark, base).select("id", S.options_text("options").alias("options"))


@plans.add(f"SELECT id, 'Question: ' || coalesce(question, '') || chr(10) || {OPTIONS} || chr(10) || 'Answer:' AS prompt FROM tasks")
def f13_prompt(spark, base):
    prompt = S.filled("Question: {{QUERY}}\n{{OPTIONS}}\nAnswer:", {"QUERY": F.col("question"), "OPTIONS": S.options_text("options")})
    return tasks(spark, base).select("id", prompt.alias("prompt"))


@plans.add(f"""WITH p AS (SELECT {K}, upper(trim(boxed_letter)) AS p FROM search_nodes WHERE action = 'submit')
    SELECT {K}, CASE WHEN p = upper(trim(answer)) THEN 1.0 ELSE 0.0 END AS mca FROM p LEFT JOIN tasks ON id = task_id""")
def f14_mca(spark, base):
    gold = tasks(spark, base).select(F.col("id").alias("task_id"), "answer")
    same = F.upper(F.trim("boxed_letter")) == F.upper(F.trim("answer"))
    return finals(spark, base).join(gold, "task_id", "left").select(*KEY, F.when(same, 1.0).otherwise(0.0).alias("mca"))


@plans.add(FINAL.format("TRY_CAST(nullif(regexp_extract(final_answer_text, '(10|[0-9])', 1), '') AS DOUBLE) / 10 AS score"))
def f15_judge_score(spark, base):
    return finals(spark, base).select(*KEY, S.judge_score("final_answer_text").alias("score"))


@plans.add("SELECT id, md5(concat_ws('|', id, source, question)) AS row_id FROM tasks")
def f18_row_md5(spark, base):
    return tasks(spark, base).select("id", F.md5(F.concat_ws("|", "id", "source", "question")).alias("row_id"))


@plans.add("SELECT event_id, coalesce(TRY_CAST(props->>'$.k' AS DOUBLE), -1) AS k FROM events")
def f20_safe_float(spark, base):
    return table(spark, base, "events").select("event_id", S.safe_float(F.get_json_object("props", "$.k"), -1).alias("k"))


@plans.add("SELECT l_orderkey, l_linenumber, l_partkey, chr(65 + CASE WHEN l_partkey % 30 BETWEEN 0 AND 25 THEN CAST(l_partkey % 30 AS INTEGER) ELSE 0 END) AS letter FROM lineitem")
def f21_letter_of(spark, base):
    at = (F.col("l_partkey") % 30).cast("int")
    return table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.letter_of(at).alias("letter"))


@plans.add(r"SELECT DISTINCT repo, replace(repo, '/', '__') AS name FROM documents")
def f22_safe_name(spark, base):
    return table(spark, base, "documents").select("repo").distinct().withColumn("name", S.safe_name("repo"))


@plans.add(rf"SELECT {K}, coalesce(TRY_CAST(nullif(regexp_extract(node_id, '_(\d+)$', 1), '') AS BIGINT), 0) AS n FROM search_nodes")
def f23_suffix_number(spark, base):
    return table(spark, base, "search_nodes").select(*KEY, S.suffix_number("node_id").alias("n"))


@plans.add("""SELECT doc_id, CASE WHEN e IN ('jpg','jpeg','png','gif','bmp','webp','tif','tiff') THEN 'image' WHEN e IN ('wav','mp3','flac','ogg','m4a') THEN 'audio'
    WHEN e IN ('mp4','avi','mov','mkv','webm') THEN 'video' ELSE 'other' END AS kind
    FROM (SELECT doc_id, lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS e FROM documents)""".replace("\\\\", "\\"))
def f24_media_kind(spark, base):
    return table(spark, base, "documents").select("doc_id", S.media_kind("file_path").alias("kind"))


@plans.add("SELECT event_id, round(1 - (1 - 0.1) * (1 - cos(pi() * (event_id % 1000) / 1000)) / 2, 6) AS x FROM events")
def f26_cosine_schedule(spark, base):
    x = S.cosine_schedule(F.col("event_id") % 1000, F.lit(1000), 0.1, 1.0)
    return table(spark, base, "events").select("event_id", F.round(x, 6).alias("x"))


@plans.add("""SELECT event_id, round(CASE WHEN s < 100 THEN s / 100 ELSE greatest(0, (1 + cos(pi() * (s - 100) / 900)) / 2) END, 6) AS x
    FROM (SELECT event_id, event_id % 1000 AS s FROM events)""")
def x8_warm_up(spark, base):
    return table(spark, base, "events").select("event_id", F.round(S.warm_up(F.col("event_id") % 1000, 100, 1000), 6).alias("x"))


VEC = "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT a.vec_id, a.e AS a, b.e AS b, a.label = b.label AS same FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0) "


def vector_pairs(spark, base):
    """Even vectors with the next one, ``same`` if their labels are equal: one equi-join."""
    v = table(spark, base, "embeddings")
    left = v.filter("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("a"), F.col("label").alias("la"))
    right = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    return left.join(right, "vec_id").select("vec_id", "a", "b", (F.col("la") == F.col("lb")).alias("same"))


@plans.add(VEC + """SELECT vec_id, round(list_dot_product(a, b), 4) AS dot, round(list_cosine_similarity(a, b), 5) AS cosine,
    round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 4) AS l1, round(list_distance(a, b), 4) AS l2 FROM p""")
def f27_vectors(spark, base):
    return vector_pairs(spark, base).select(
        "vec_id",
        F.round(S.dot("a", "b"), 4).alias("dot"),
        F.round(S.cosine("a", "b"), 5).alias("cosine"),
        F.round(S.l1("a", "b"), 4).alias("l1"),
        F.round(S.l2("a", "b"), 4).alias("l2"),
    )


@plans.add("SELECT user_id, event_id, CAST(r AS DOUBLE) AS reward FROM (SELECT user_id, event_id, TRY_CAST(nullif(regexp_extract('Reward: ' || CAST(floor(value) / 100 AS VARCHAR), 'Reward:\\s*([0-1](?:\\.\\d+)?)', 1), '') AS DOUBLE) AS r FROM events)".replace("\\\\", "\\"))
def f30_stated_reward(spark, base):
    text = F.concat(F.lit("Reward: "), (F.floor("value") / 100).cast("string"))
    return table(spark, base, "events").select("user_id", "event_id", S.stated_reward(text).alias("reward"))


@plans.add("""WITH RECURSIVE t AS (SELECT id, 1 AS i, CAST(0 AS UBIGINT) AS s FROM tasks
    UNION ALL SELECT id, i + 1, (s * 131 + ascii(substring(id, i, 1))) % 4294967296 FROM t WHERE i <= length(id))
    SELECT id, CAST(max_by(s, i) AS BIGINT) AS seed FROM t GROUP BY id""")
def m23_string_seed(spark, base):
    return tasks(spark, base).select("id", S.string_seed("id").alias("seed"))


TAGGED = "CASE doc_id % 4 WHEN 0 THEN '<think>' || t || '</think><answer>' || t || '</answer>' WHEN 1 THEN '<think>' || t || '</think> Action: x Action Input: ' || t WHEN 2 THEN t || '<think></think><answer></answer>' ELSE t END"


def tagged():
    t, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    return (
        F.when(k == 0, F.concat(F.lit("<think>"), t, F.lit("</think><answer>"), t, F.lit("</answer>")))
        .when(k == 1, F.concat(F.lit("<think>"), t, F.lit("</think> Action: x Action Input: "), t))
        .when(k == 2, F.concat(t, F.lit("<think></think><answer></answer>")))
        .otherwise(t)
    )


@plans.add(rf"""SELECT doc_id, CASE WHEN regexp_matches(x, '(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z') THEN 1.0 ELSE 0.0 END AS format,
    CASE WHEN regexp_matches(x, '(?s)\A<think>.*?</think>\s*Action:.*?Action Input:.*?\z') THEN 1.0 ELSE 0.0 END AS react
    FROM (SELECT doc_id, {TAGGED} AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""")
def r1_r2_format_rewards(spark, base):
    x = tagged()
    return table(spark, base, "documents").select("doc_id", S.format_reward(x).alias("format"), S.react_reward(x).alias("react"))


@plans.add(r"""WITH w AS (SELECT id, string_split(trim(regexp_replace(lower(question), '\s+', ' ', 'g')), ' ') AS w FROM tasks),
    g AS (SELECT id, list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM w)
    SELECT id, round(CASE WHEN len(g) > 0 THEN -1.0 * (1 - len(list_distinct(g)) / len(g)) ELSE 0 END, 6) + 0.0 AS penalty FROM g""")
def r3_repetition(spark, base):
    return tasks(spark, base).select("id", F.round(S.repetition_penalty("question", 3, -1.0), 6).alias("penalty"))


@plans.add("SELECT doc_id, round(least(-(n_chars - 1800) / 200, 0), 6) AS penalty FROM documents WHERE n_chars IS NOT NULL")
def r4_overlong(spark, base):
    d = table(spark, base, "documents").filter("n_chars IS NOT NULL")
    return d.select("doc_id", F.round(S.overlong_penalty(F.col("n_chars"), 2000, 200), 6).alias("penalty"))


@plans.add("""SELECT event_id, round(CASE WHEN value > 50 THEN 1.0 - 0.5 * (1 - cos(pi() * event_id / 10000)) / 2
    ELSE -1.0 + 0.5 * (1 - cos(pi() * event_id / 10000)) / 2 END, 6) AS reward FROM events""")
def r5_cosine(spark, base):
    r = S.cosine_reward(F.col("value") > 50, F.col("event_id"), 10_000, (0.5, 1.0), (-1.0, -0.5))
    return table(spark, base, "events").select("event_id", F.round(r, 6).alias("reward"))


@plans.add(FINAL.format("coalesce(" + ", ".join(f"nullif(regexp_extract(final_answer_text, '{p}', 1), '')" for p in S.STATED)
    + r""", nullif(regexp_extract(right(final_answer_text, 200), '(?s)^(?:.*[^\p{L}\p{N}_])?([A-J])(?:[.,\s].*)?$', 1), '')) AS letter"""))
def r9_flexible(spark, base):
    return finals(spark, base).select(*KEY, S.flexible_answer("final_answer_text").alias("letter"))


@plans.add("""SELECT vec_id, round(ln(list_sum(list_transform(e, lambda v: exp(v - m)))) - list_sum(list_transform(e, lambda v: exp(v - m) * (v - m))) /
    list_sum(list_transform(e, lambda v: exp(v - m))), 5) AS entropy FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(CAST(embedding AS DOUBLE[])) AS m FROM embeddings)""")
def x7_entropy(spark, base):
    return table(spark, base, "embeddings").select("vec_id", F.round(S.softmax_entropy("embedding"), 5).alias("entropy"))
