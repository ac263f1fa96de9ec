"""Chat normalisation, validation and message rewrites over the exported rows, nodes and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.functions import scalars as S
from arbolith.operators import chats as C
from arbolith.plans.registry import Plans
from arbolith.tables import table

plans = Plans()
NK = ["task_id", "node_id", "written_at", "loaded_at"]
M = "CASE WHEN messages IS NULL THEN NULL ELSE list_transform(messages, lambda m: {{'role': m.role, 'content': {content}, 'loss': m.loss}}) END"


def rows(spark, base):
    return table(spark, base, "training_rows").select("row_id", "messages", "answer", "channel", "expected_acc_reward")


def flat(df, c="messages"):
    """Messages as an array of 'role|content|loss' strings, comparable everywhere."""
    one = lambda m: F.concat_ws("|", F.coalesce(m["role"], F.lit("~")), F.coalesce(m["content"], F.lit("~")), F.coalesce(m["loss"].cast("int").cast("string"), F.lit("~")))
    return df.withColumn(c, F.transform(c, one))


FLAT = "list_transform({}, lambda m: concat_ws('|', coalesce(m.role, '~'), coalesce(m.content, '~'), coalesce(CAST(CAST(m.loss AS INTEGER) AS VARCHAR), '~')))"


@plans.add("SELECT c_custkey AS key, c_name AS name, c_acctbal FROM customer")
def row_p1_p2_renamed(spark, base):
    """The user's names first, then built-in ones; C_NAME matches without case, and two columns never become one."""
    c = table(spark, base, "customer").select("c_custkey", "c_name", "c_acctbal")
    return C.renamed(c, {"C_NAME": "query", "c_custkey": "x", "C_ACCTBAL": "c_acctbal"}, {"query": "name", "x": "key"})


@plans.add("SELECT row_id, channel FROM training_rows")
def row_p3_standard(spark, base):
    return C.standard(rows(spark, base), "row_id").select("row_id", "channel")


@plans.add("SELECT n_nationkey AS key, n_name AS n_name, n_regionkey FROM nation")
def row_p4_stripped(spark, base):
    n = table(spark, base, "nation").select(F.col("n_nationkey").alias("__@key"), F.col("n_name").alias("__#n_name"), "n_regionkey")
    return C.stripped(n)


@plans.add("SELECT row_id, unnest(messages).role AS role FROM training_rows")
def row_p5_flat_map(spark, base):
    return rows(spark, base).select("row_id", F.explode("messages").alias("m")).select("row_id", "m.role")


VALID = "coalesce(len(messages) > 0 AND len(list_filter(messages, lambda m: m.content IS NULL OR m.role IS NULL OR NOT list_contains(['system','user','tool_call','tool_response','tool','assistant'], m.role))) = 0, false)"


@plans.add(f"SELECT row_id, {VALID} AS valid FROM training_rows")
def row_p6_p7_valid(spark, base):
    """Bad rows stay, marked, so that they can be kept aside."""
    return rows(spark, base).select("row_id", C.valid(F.col("messages")).alias("valid"))


@plans.add("SELECT row_id, coalesce(messages[-1].content <> answer, false) AS valid FROM training_rows")
def row_p8_valid_rejection(spark, base):
    return rows(spark, base).select("row_id", C.valid_rejection(F.col("messages"), F.col("answer")).alias("valid"))


@plans.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [x, y] WHEN o_orderkey % 3 = 1 THEN [least(x, z), least(y, w), greatest(x, z), greatest(y, w)] END AS box
    FROM (SELECT o_orderkey, CAST(o_orderkey % 17 AS BIGINT) AS x, CAST(o_custkey % 23 AS BIGINT) AS y, CAST(o_custkey % 19 AS BIGINT) AS z, CAST(o_orderkey % 29 AS BIGINT) AS w FROM orders)""")
def row_p9_boxes(spark, base):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    four = F.array(k % 17, c % 23, c % 19, k % 29)
    b = F.when(k % 3 == 0, F.slice(four, 1, 2)).when(k % 3 == 1, four).otherwise(F.slice(four, 1, 3))
    return table(spark, base, "orders").select("o_orderkey", C.box(b).alias("box"))


@plans.add("SELECT row_id FROM training_rows WHERE channel IN ('retry')")
def row_p11_p14_membership(spark, base):
    return rows(spark, base).filter(F.col("channel").isin("retry")).select("row_id")


@plans.add("SELECT row_id FROM training_rows WHERE NOT coalesce(len(list_filter(messages, lambda m: regexp_matches(lower(coalesce(m.content, '')), 'sorry|human:'))) > 0, false)")
def row_p12_blocklist(spark, base):
    bad = F.exists("messages", lambda m: F.coalesce(F.lower(m["content"]).rlike("sorry|human:"), F.lit(False)))
    return rows(spark, base).filter(~F.coalesce(bad, F.lit(False))).select("row_id")


@plans.add("SELECT row_id FROM training_rows WHERE len(list_distinct(list_transform(messages, lambda m: m.role))) > 2")
def row_p15_distinct_roles(spark, base):
    roles = F.array_distinct(F.transform("messages", lambda m: m["role"]))
    return rows(spark, base).filter(F.size(roles) > 2).select("row_id")


@plans.add("SELECT doc_id FROM documents WHERE n_chars <= 2000")
def row_p16_p17_max_length(spark, base):
    return table(spark, base, "documents").filter("n_chars <= 2000").select("doc_id")


@plans.add("SELECT id, CASE WHEN NOT regexp_matches(lower(question), 'boson') THEN CASE WHEN regexp_matches(lower(question), 'galaxy|star|orbit') THEN 'sky' WHEN regexp_matches(lower(question), 'acid|solvent') THEN 'lab' END END AS label FROM tasks")
def row_p19_taxonomy(spark, base):
    label = C.taxonomy(F.col("question"), [("galaxy|star|orbit", "sky"), ("acid|solvent", "lab")], "boson")
    return table(spark, base, "tasks").select("id", label.alias("label"))


@plans.add("SELECT id, CASE lower(trim(original_subject)) WHEN 'physics' THEN 'Physics' WHEN 'chemistry' THEN 'Chemistry' END AS subject FROM tasks WHERE lower(trim(original_subject)) IN ('physics', 'chemistry')")
def row_p20_recoded(spark, base):
    t = table(spark, base, "tasks").withColumn("s", C.recoded(F.col("original_subject"), {"physics": "Physics", "chemistry": "Chemistry"}))
    return t.filter("s IS NOT NULL").select("id", F.col("s").alias("subject"))


@plans.add("SELECT id, coalesce(nullif(subject, ''), nullif(original_subject, ''), 'none') AS subject FROM tasks")
def row_p21_first_truthy(spark, base):
    return table(spark, base, "tasks").select("id", S.first_truthy("subject", "original_subject", F.lit("none")).alias("subject"))


@plans.add("SELECT doc_id FROM documents WHERE lang IS NULL OR lower(lang) IN ('python', 'py')")
def row_p22_language(spark, base):
    return table(spark, base, "documents").filter("lang IS NULL OR lower(lang) IN ('python', 'py')").select("doc_id")


@plans.add("""SELECT user_id, bool_or(o) AS overlap FROM (SELECT user_id, coalesce(event_id < lag(event_id + CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id, value), false) AS o FROM events) GROUP BY 1""")
def row_p23_overlaps(spark, base):
    e = table(spark, base, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor("value")).alias("b"), "value")
    spans = F.sort_array(F.collect_list(F.struct("a", "value", "b")))
    per = e.groupBy("user_id").agg(spans.alias("s"))
    hit = F.exists(F.transform("s", lambda x, i: (i > 0) & (x["a"] < F.get("s", i - 1)["b"])), lambda o: F.coalesce(o, F.lit(False)))
    return per.select("user_id", hit.alias("overlap"))


@plans.add("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN messages IS NULL OR len(messages) = 0 THEN 'no messages' WHEN NOT """ + VALID + """ THEN 'invalid'
    WHEN expected_acc_reward IS NULL OR CAST(expected_acc_reward AS VARCHAR) = 'nan' THEN 'no reward' ELSE 'kept' END AS reason FROM training_rows) GROUP BY 1""")
def row_p24_drop_reasons(spark, base):
    m = F.col("messages")
    reason = (
        F.when(m.isNull() | (F.size(m) == 0), "no messages")
        .when(~C.valid(m), "invalid")
        .when(F.col("expected_acc_reward").isNull() | F.isnan("expected_acc_reward"), "no reward")
        .otherwise("kept")
    )
    return rows(spark, base).select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


QA = "list_filter([{{'role': 'system', 'content': nullif({s}, '')}}, {{'role': 'user', 'content': {q}}}, {{'role': 'assistant', 'content': {a}}}], lambda m: m.content IS NOT NULL)"


def pairs(c="messages"):
    return F.transform(c, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


@plans.add("SELECT id, " + QA.format(s="subject", q="question", a="answer") + " AS messages FROM tasks")
def n1_n2_query_response(spark, base):
    t = table(spark, base, "tasks").select("id", F.col("subject").alias("system"), F.col("question").alias("query"), F.col("answer").alias("response"))
    return C.normalised(t).select("id", pairs().alias("messages"))


@plans.add("""SELECT id, list_filter([{'role': 'user', 'content': nullif(concat_ws(chr(10), nullif(source, ''), nullif(question, '')), '')}, {'role': 'assistant', 'content': answer}], lambda m: m.content IS NOT NULL) AS messages FROM tasks""")
def n1_n3_instruction(spark, base):
    t = table(spark, base, "tasks").select("id", F.col("source").alias("instruction"), F.col("question").alias("input"), F.col("answer").alias("output"))
    return C.normalised(t).select("id", pairs().alias("messages"))


@plans.add("""SELECT row_id, list_transform(messages, lambda m: {'role': CASE m.role WHEN 'assistant' THEN 'assistant' WHEN 'tool' THEN 'tool_response' ELSE m.role END, 'content': m.content}) AS messages FROM training_rows""")
def n1_n4_conversations(spark, base):
    alias = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").when(r == "tool", "function-response").otherwise(r)
    turns = F.transform("messages", lambda m: F.struct(alias(m["role"]).alias("from"), m["content"].alias("value")))
    df = rows(spark, base).select("row_id", turns.alias("conversations"))
    return C.normalised(df).select("row_id", pairs().alias("messages"))


@plans.add("""SELECT task_id, node_id, written_at, loaded_at, list_filter([{'role': 'user', 'content': focus_question}, {'role': 'assistant', 'content': delegate_answer}], lambda m: m.content IS NOT NULL) AS messages FROM search_nodes""")
def n5_pairs(spark, base):
    n = table(spark, base, "search_nodes")
    one = F.array(F.struct(F.col("focus_question").alias("human"), F.col("delegate_answer").alias("gpt")))
    return n.select(*NK, one.alias("p")).withColumn("messages", C.from_pairs(F.col("p"), "human", "gpt")).select(*NK, pairs().alias("messages"))


@plans.add("SELECT id, replace('Q: {{QUERY}} A:', '{{QUERY}}', coalesce(question, '')) AS prompt FROM tasks")
def n7_f19_template(spark, base):
    return table(spark, base, "tasks").select("id", S.filled("Q: {{QUERY}} A:", {"QUERY": F.col("question")}).alias("prompt"))


@plans.add("SELECT vec_id, (['a','b','c','d','e','f','g','h'])[label % 8 + 1] AS response FROM embeddings WHERE label IS NOT NULL")
def n6_n8_labels(spark, base):
    names = F.array(*[F.lit(x) for x in "abcdefgh"])
    return table(spark, base, "embeddings").filter("label IS NOT NULL").select("vec_id", F.get(names, (F.col("label").cast("int") % 8)).alias("response"))


TALK = "list_filter(messages, lambda m: list_contains(['user', 'assistant'], m.role))"


@plans.add(f"""SELECT row_id, [[t[i].content, CASE WHEN t[i + 1].role = 'assistant' THEN t[i + 1].content END] FOR i IN range(1, len(t) + 1) IF t[i].role = 'user'] AS history FROM (SELECT row_id, {TALK} AS t FROM training_rows WHERE messages IS NOT NULL)""")
def n10_history(spark, base):
    return rows(spark, base).filter("messages IS NOT NULL").select("row_id", C.to_history(F.col("messages")).alias("history"))


@plans.add("""SELECT id, [{'role': 'user', 'content': trim(question)}, {'role': 'assistant', 'content': trim(answer)}] AS messages FROM tasks WHERE answer <> '' AND question <> '' AND NOT contains(question, chr(10))""")
def n11_dialogue(spark, base):
    """Questions of one line; :func:`n11_dialogue_all` has the others too."""
    t = table(spark, base, "tasks").filter("answer <> '' AND question <> ''").filter(~F.col("question").contains("\n"))
    text = F.concat(F.lit("\n\nHuman: "), "question", F.lit("\n\nAssistant: "), "answer")
    return t.select("id", C.dialogue(text).alias("messages")).select("id", pairs().alias("messages"))


@plans.add(r"""SELECT id, [{'role': 'user', 'content': regexp_replace(question, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g')},
    {'role': 'assistant', 'content': regexp_replace(answer, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g')}] AS messages FROM tasks WHERE answer <> '' AND question <> ''""")
def n11_dialogue_all(spark, base):
    """Turns of any number of lines."""
    t = table(spark, base, "tasks").filter("answer <> '' AND question <> ''")
    text = F.concat(F.lit("\n\nHuman: "), "question", F.lit("\n\nAssistant: "), "answer")
    return t.select("id", C.dialogue(text).alias("messages")).select("id", pairs().alias("messages"))


@plans.add("SELECT id, 'question' AS kind, question AS text FROM tasks UNION ALL SELECT id, 'answer', answer FROM tasks")
def n12_two_rows(spark, base):
    both = F.array(F.struct(F.lit("question").alias("kind"), F.col("question").alias("text")), F.struct(F.lit("answer").alias("kind"), F.col("answer").alias("text")))
    return table(spark, base, "tasks").select("id", F.inline(both))


@plans.add("SELECT id, i - 1 AS at, v[i] AS content, CASE WHEN i = 1 THEN 1 ELSE 0 END AS label FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT id, [answer] || coalesce(options, []) AS v FROM tasks))")
def n14_q18_views(spark, base):
    return C.views(table(spark, base, "tasks"), ["id"], "answer", "options").withColumn("at", F.col("at").cast("bigint"))


@plans.add("SELECT event_id, value, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS label FROM events WHERE value >= 10")
def n15_p13_thresholded(spark, base):
    e = table(spark, base, "events").filter("value >= 10")
    return e.select("event_id", "value", (F.col("value") >= 50).cast("int").alias("label"))


@plans.add(r"SELECT id, nullif(regexp_extract(x, '^\s*\d+[.)]\s*(.+)$', 1), '') AS text FROM (SELECT id, '3. ' || coalesce(source, '') AS x FROM tasks)")
def n21_enumeration(spark, base):
    text = F.regexp_extract(F.concat(F.lit("3. "), F.coalesce("source", F.lit(""))), r"^\s*\d+[.)]\s*(.+)$", 1)
    return table(spark, base, "tasks").select("id", S.truthy(text).alias("text"))


@plans.add("SELECT id, string_split(source || '[SEP]' || split, '[SEP]') AS parts FROM tasks")
def n22_separator(spark, base):
    return table(spark, base, "tasks").select("id", F.split(F.concat("source", F.lit("[SEP]"), "split"), r"\[SEP\]").alias("parts"))


@plans.add("SELECT id, 'Context: ' || coalesce(subject, '') || chr(10) || coalesce(question, '') AS text FROM tasks")
def n23_context(spark, base):
    t = table(spark, base, "tasks")
    return t.select("id", F.concat(F.lit("Context: "), F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("question", F.lit(""))).alias("text"))


@plans.add("SELECT doc_id, md5(replace(text, chr(65039), '')) AS text_md5 FROM documents")
def n24_clean(spark, base):
    return table(spark, base, "documents").select("doc_id", F.md5(F.replace("text", F.lit("️"), F.lit(""))).alias("text_md5"))


@plans.add("""SELECT id AS key, question, options, 'bench' AS kind FROM tasks WHERE source = 'glacis' UNION ALL SELECT task_id || '/' || node_id, instruction, model_pool, 'node' FROM search_nodes WHERE action = 'root'""")
def n31_benchmark(spark, base):
    """Two sources in one schema."""
    t = table(spark, base, "tasks").filter("source = 'glacis'").select(F.col("id").alias("key"), "question", "options", F.lit("bench").alias("kind"))
    n = table(spark, base, "search_nodes").filter("action = 'root'")
    n = n.select(F.concat_ws("/", "task_id", "node_id").alias("key"), F.col("instruction").alias("question"), F.col("model_pool").alias("options"), F.lit("node").alias("kind"))
    return t.unionByName(n)


ISLANDS = """WITH t AS (SELECT row_id, i, messages[i] AS m FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM training_rows)),
    g AS (SELECT *, sum(CASE WHEN m.role = lagged AND m.role IN ('user', 'assistant') THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY i) AS g
          FROM (SELECT *, lag(m.role) OVER (PARTITION BY row_id ORDER BY i) AS lagged FROM t)),
    u AS (SELECT row_id, g, min(i) AS i, any_value(m.role) AS role, CASE WHEN count(*) = 1 THEN any_value(m.content) ELSE string_agg(coalesce(m.content, ''), '' ORDER BY i) END AS content FROM g GROUP BY 1, 2)
    SELECT row_id, list({'role': role, 'content': content} ORDER BY i) AS messages FROM u GROUP BY 1"""


@plans.add(ISLANDS)
def q1_merged(spark, base):
    df = rows(spark, base).filter("size(messages) > 0").withColumn("messages", C.merged(F.col("messages")))
    return df.select("row_id", pairs().alias("messages"))


@plans.add(ISLANDS.replace("'user', 'assistant'", "'tool'"))
def q2_merged_tools(spark, base):
    df = rows(spark, base).filter("size(messages) > 0").withColumn("messages", C.merged(F.col("messages"), ("tool",)))
    return df.select("row_id", pairs().alias("messages"))


LAST = "len(messages) - CASE WHEN list_contains(list_transform(messages, lambda m: m.role), 'user') THEN list_position(list_reverse(list_transform(messages, lambda m: m.role)), 'user') ELSE len(messages) + 1 END"


@plans.add(f"SELECT row_id, CAST({LAST} AS INTEGER) AS last FROM training_rows WHERE messages IS NOT NULL")
def q5_last_user(spark, base):
    return rows(spark, base).filter("messages IS NOT NULL").select("row_id", C.last_user(F.col("messages")).alias("last"))


@plans.add(f"""SELECT row_id, [{{'role': m[i].role, 'content': CASE WHEN m[i].role = 'assistant' AND i - 1 < last THEN regexp_replace(split_part(m[i].content, '</think>', -1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') ELSE m[i].content END}} FOR i IN range(1, len(m) + 1)] AS messages
    FROM (SELECT row_id, messages AS m, {LAST} AS last FROM training_rows WHERE messages IS NOT NULL)""")
def q3_without_history_thinking(spark, base):
    df = rows(spark, base).filter("messages IS NOT NULL").withColumn("messages", C.without_history_thinking(F.col("messages")))
    return df.select("row_id", pairs().alias("messages"))


@plans.add("SELECT row_id, list_transform(messages, lambda m: {'role': m.role, 'content': CASE WHEN m.role = 'assistant' AND NOT contains(m.content, '<think>') THEN '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || m.content ELSE m.content END}) AS messages FROM training_rows")
def q4_empty_thinking(spark, base):
    return rows(spark, base).withColumn("messages", C.with_empty_thinking(F.col("messages"))).select("row_id", pairs().alias("messages"))


W = "WITH w AS (SELECT id, string_split(question, ' ') AS w FROM tasks) "


@plans.add(W + "SELECT id, w[1:20] AS words FROM w WHERE NOT list_contains(w, 'the')")
def q6_truncated(spark, base):
    """Tasks without the protected word; :func:`q6_truncated_all` has all, from both sides."""
    t = table(spark, base, "tasks").select("id", F.split("question", " ").alias("w")).filter("NOT array_contains(w, 'the')")
    return t.select("id", C.truncated(F.col("w"), 20, False, ["the"]).alias("words"))


@plans.add(W + """, p AS (SELECT id, w, [i FOR i IN range(1, len(w) + 1) IF w[i] <> 'the'] AS o, greatest(20 - len(list_filter(w, lambda x: x = 'the')), 0) AS room FROM w)
    SELECT id, CASE WHEN len(w) <= 20 THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF w[i] = 'the' OR list_position(o, i) <= room] END AS first_words,
        CASE WHEN len(w) <= 20 THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF w[i] = 'the' OR list_position(o, i) > len(o) - room] END AS last_words FROM p""")
def q6_truncated_all(spark, base):
    """All tasks, the protected word kept wherever it stands; the others' first or last fill what room is left."""
    w = F.col("w")
    t = table(spark, base, "tasks").select("id", F.split("question", " ").alias("w"))
    return t.select("id", C.truncated(w, 20, False, ["the"]).alias("first_words"), C.truncated(w, 20, True, ["the"]).alias("last_words"))


@plans.add(W + "SELECT id, CAST((i - 1) // 16 AS INTEGER) AS at, w[i:i + 15] AS words FROM (SELECT id, w, unnest(range(1, len(w) + 1, 16)) AS i FROM w)")
def q7_chunks(spark, base):
    t = table(spark, base, "tasks").select("id", C.chunks(F.split("question", " "), 16).alias("c"))
    return t.select("id", F.posexplode("c").alias("at", "words"))


@plans.add("SELECT row_id, greatest(coalesce(len(messages), 0), length(coalesce(answer, ''))) AS length FROM training_rows")
def q8_length(spark, base):
    n = F.greatest(F.coalesce(F.size("messages"), F.lit(0)), F.length(F.coalesce("answer", F.lit(""))), F.lit(0))
    return rows(spark, base).select("row_id", F.when(F.col("messages").isNull(), F.length(F.coalesce("answer", F.lit("")))).otherwise(n).cast("bigint").alias("length"))


@plans.add("SELECT row_id, list_transform(messages, lambda m: coalesce(m.loss, CASE WHEN m.role = 'assistant' THEN 1.0 ELSE 0.0 END)) AS scales FROM training_rows")
def q9_loss_scales(spark, base):
    return rows(spark, base).select("row_id", C.loss_scales(F.col("messages")).alias("scales"))


@plans.add("SELECT o_orderkey, [CAST(round_even((o_orderkey % 640) / 640 * 1000, 0) AS INTEGER), CAST(round_even((o_custkey % 480) / 480 * 1000, 0) AS INTEGER)] AS box FROM orders")
def q12_grid(spark, base):
    b = F.array((F.col("o_orderkey") % 640).cast("double"), (F.col("o_custkey") % 480).cast("double"))
    return table(spark, base, "orders").select("o_orderkey", C.grid_box(b, F.lit(640.0), F.lit(480.0)).alias("box"))


@plans.add("SELECT id, 'see <image> and <image>' || source AS text, [id, split] AS paths FROM tasks")
def q13_inline_images(spark, base):
    text = F.concat(F.lit("see <img>"), "id", F.lit("</img> and <img>"), "split", F.lit("</img>"), "source")
    shown, paths = C.inline_images(text)
    return table(spark, base, "tasks").select("id", shown.alias("text"), paths.alias("paths"))


@plans.add("SELECT id, CASE WHEN contains(question, '<image>') THEN question ELSE repeat('<image>', CAST(coalesce(len(images), 0) AS INTEGER)) || question END AS text FROM tasks")
def q14_image_prefixed(spark, base):
    n = F.greatest(F.coalesce(F.size("images"), F.lit(0)), F.lit(0))
    return table(spark, base, "tasks").select("id", C.image_prefixed(F.col("question"), n).alias("text"))


@plans.add("SELECT id, [{'name': id, 'arguments': source}, {'name': split, 'arguments': 'x'}] AS calls FROM tasks")
def q15_react_calls(spark, base):
    text = F.concat(F.lit("Action: "), "id", F.lit("\nAction Input: "), "source", F.lit("\nAction: "), "split", F.lit("\nAction Input: x"))
    return table(spark, base, "tasks").select("id", C.react_calls(text).alias("calls"))


@plans.add(W + "SELECT id, CASE WHEN len(w) < 60 THEN w || list_transform(range(60 - len(w)), lambda x: '0') ELSE w END AS words FROM w")
def q20_padded(spark, base):
    w = F.split("question", " ")
    fill = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 60 - F.size(w)))
    return table(spark, base, "tasks").select("id", F.concat(w, fill).alias("words"))


@plans.add("SELECT row_id, CASE WHEN messages[-1].role = 'assistant' THEN messages[:-2] ELSE messages END AS messages FROM (SELECT row_id, list_transform(messages, lambda m: {'role': m.role, 'content': m.content}) AS messages FROM training_rows)")
def x2_without_answer(spark, base):
    return rows(spark, base).withColumn("messages", C.without_answer(F.col("messages"))).select("row_id", pairs().alias("messages"))


@plans.add("""SELECT row_id, CASE WHEN coalesce(messages[-1].role = 'assistant', false) OR answer IS NULL THEN messages ELSE messages || [{'role': 'assistant', 'content': answer}] END AS messages
    FROM (SELECT row_id, answer, list_transform(messages, lambda m: {'role': m.role, 'content': m.content}) AS messages FROM training_rows WHERE messages IS NOT NULL)""")
def r12_r13_with_answer(spark, base):
    df = rows(spark, base).filter("messages IS NOT NULL").withColumn("messages", C.with_answer(F.col("messages"), F.col("answer")))
    return df.select("row_id", pairs().alias("messages"))


@plans.add("""SELECT row_id, array_to_string(list_transform(CASE WHEN list_contains(r, 'assistant') THEN messages[1:list_position(r, 'assistant') - 1] ELSE messages END, lambda m: m.role || ':' || coalesce(m.content, '')), '||') AS key
    FROM (SELECT row_id, messages, list_transform(messages, lambda m: m.role) AS r FROM training_rows WHERE messages IS NOT NULL)""")
def w1_prompt_key(spark, base):
    return rows(spark, base).filter("messages IS NOT NULL").select("row_id", C.prompt_key(F.col("messages")).alias("key"))


@plans.add("SELECT row_id, array_to_string(list_transform(messages, lambda m: upper(m.role[1]) || m.role[2:] || ': ' || coalesce(m.content, '')), chr(10)) AS text FROM training_rows WHERE messages IS NOT NULL")
def f29_transcript(spark, base):
    return rows(spark, base).filter("messages IS NOT NULL").select("row_id", C.transcript(F.col("messages")).alias("text"))


@plans.add("""SELECT row_id, list_transform(list_filter([{'role': 'system', 'content': channel}, {'role': 'user', 'content': repeat('<image>', 1) || answer}], lambda m: m.content IS NOT NULL), lambda m: m) AS messages FROM training_rows""")
def x13_assembled(spark, base):
    r = rows(spark, base)
    asked = C.image_prefixed(F.col("answer"), F.lit(1))
    return r.select("row_id", C.from_query(asked, F.lit(None), F.col("channel")).alias("messages")).select("row_id", pairs().alias("messages"))
