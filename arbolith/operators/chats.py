"""Chat rows: renames, normalisation to messages, validation, and rewrites of message arrays.

A conversation is array<struct<role, content, loss>>. Everything is a Column or
a projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.functions.scalars import first_truthy, strip, truthy

MESSAGES = "array<struct<role:string,content:string,loss:double>>"
# The roles of a message, other names for them, and names of the columns of query-response rows.
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")
ROLE_NAMES = {
    "human": "user",
    "gpt": "assistant",
    "bot": "assistant",
    "function_call": "tool_call",
    "function_response": "tool_response",
    "observation": "tool_response",
    "observations": "tool_response",
}
SYSTEM_NAMES = ("system", "system_prompt")
QUERY_NAMES = ("query", "prompt", "input", "instruction", "question", "problem")
RESPONSE_NAMES = ("response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content")
#: Fixed value: the columns a standard row keeps.
STANDARD = tuple(
    [p + c for p in ("", "rejected_", "positive_", "negative_") for c in ("messages", "images", "videos", "audios", "tools", "objects")]
    + ["rejected_response", "label", "channel", "margin", "teacher_prompt"]
)


# ---- columns


def rename_map(columns: Sequence[str], mapping: Mapping[str, str]) -> dict[str, str]:
    """column -> new name: without regard to case; no two columns become one, and a target already there by its own name stays."""
    wanted = {k.lower(): v for k, v in mapping.items()}
    hits: dict[str, list[str]] = {}
    for c in columns:
        target = wanted.get(c.lower())
        if target is not None:
            hits.setdefault(target, []).append(c)
    return {cs[0]: t for t, cs in hits.items() if len(cs) == 1 and cs[0] != t and (t not in columns or t in cs)}


def renamed(df: DataFrame, *mappings: Mapping[str, str]) -> DataFrame:
    """The mappings one after the other, such as the user's first and then the built-in names."""
    for mapping in mappings:
        df = df.withColumnsRenamed(rename_map(df.columns, mapping))
    return df


def stripped(df: DataFrame, prefixes: Sequence[str] = ("__@", "__#")) -> DataFrame:
    """Column names without the prefixes, unless that name is taken."""
    for c in df.columns:
        for p in prefixes:
            if c.startswith(p) and c[len(p) :] not in df.columns:
                df = df.withColumnRenamed(c, c[len(p) :])
    return df


def standard(df: DataFrame, *also: str) -> DataFrame:
    """The standard columns that are there, and ``also``."""
    return df.select(*[c for c in df.columns if c in STANDARD or c in also])


def alias_map(names: Sequence[str], target: str) -> dict[str, str]:
    return dict.fromkeys(names, target)


# ---- to messages


def message(role: str | Column, content: Column, loss: Column | None = None) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    loss = F.lit(None).cast("double") if loss is None else loss
    return F.struct(role.alias("role"), content.cast("string").alias("content"), loss.alias("loss"))


def _said(parts: Column) -> Column:
    return F.filter(parts, lambda m: m["content"].isNotNull())


def from_query(query: Column, response: Column, system: Column | None = None, history: Column | None = None) -> Column:
    """Messages of a query and its response, after the system text and the history's (query, response) pairs; nulls are left out."""
    parts = [F.array(message("system", truthy(system)))] if system is not None else []
    if history is not None:
        past = F.coalesce(history, F.array().cast("array<array<string>>"))
        parts.append(F.flatten(F.transform(past, lambda h: F.array(message("user", F.get(h, 0)), message("assistant", F.get(h, 1))))))
    parts.append(F.array(message("user", query), message("assistant", response)))
    return _said(F.concat(*parts))


def from_instruction(instruction: Column, input_: Column, output: Column) -> Column:
    """As :func:`from_query`: instruction and input with a line break between, or whichever says something."""
    asked = F.nullif(F.concat_ws("\n", truthy(instruction), truthy(input_)), F.lit(""))
    return from_query(asked, output)


def role_of(role: Column) -> Column:
    """The standard name of a role; '-' counts as '_'."""
    r = F.replace(role, F.lit("-"), F.lit("_"))
    names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(names, r), r)


def from_messages(messages: Column, role: str = "role", content: str = "content", system: Column | None = None) -> Column:
    """Messages with standard roles; ``system`` goes in front unless a system turn is there."""
    out = F.transform(messages, lambda m: message(role_of(m[role]), m[content], m["loss"] if role == "role" else None))
    if system is None:
        return out
    first = F.get(out, 0)["role"]
    return F.when(truthy(system).isNotNull() & ~F.coalesce(first == "system", F.lit(False)), F.concat(F.array(message("system", system)), out)).otherwise(out)


def from_pairs(pairs: Column, human: str, assistant: str) -> Column:
    """Messages of pairs with one field per side."""
    return _said(F.flatten(F.transform(pairs, lambda p: F.array(message("user", p[human]), message("assistant", p[assistant])))))


def to_history(messages: Column) -> Column:
    """(query, response) pairs of the user and assistant turns, the response null if the last user turn has none."""
    talk = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    asks = F.filter(F.transform(talk, lambda m, i: F.struct(m["role"].alias("r"), m["content"].alias("q"), F.get(talk, i + 1).alias("n"))), lambda x: x["r"] == "user")
    return F.transform(asks, lambda x: F.array(x["q"], F.when(x["n"]["role"] == "assistant", x["n"]["content"])))


def normalised(df: DataFrame) -> DataFrame:
    """``messages`` by what the columns are: a conversation, an instruction with input, or a query with its response."""
    have = {c.lower(): c for c in df.columns}
    for c in ("messages", "conversation", "conversations"):
        if c in have:
            fields = {f.name for f in df.schema[have[c]].dataType.elementType.fields}
            role, content = ("role", "content") if {"role", "content"} <= fields else ("from", "value")
            system = F.col(have["system"]) if "system" in have else None
            return df.withColumn("messages", from_messages(F.col(have[c]), role, content, system))
    if "instruction" in have and "input" in have:
        out = next((have[c] for c in RESPONSE_NAMES if c in have), None)
        return df.withColumn("messages", from_instruction(F.col(have["instruction"]), F.col(have["input"]), F.col(out) if out else F.lit(None)))

    def one(names: Sequence[str]) -> Column:
        cols = [have[c] for c in names if c in have]
        return F.col(cols[0]).cast("string") if len(cols) == 1 else F.lit(None).cast("string")

    return df.withColumn("messages", from_query(one(QUERY_NAMES), one(RESPONSE_NAMES), one(SYSTEM_NAMES)))


# ---- validation


def valid(messages: Column) -> Column:
    """Not empty, known roles, no null content."""
    each = F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES) & m["content"].isNotNull(), F.lit(False)))
    return F.coalesce((F.size(messages) > 0) & each, F.lit(False))


def valid_rejection(messages: Column, rejected: Column) -> Column:
    """A rejected response that is there and differs from the last content."""
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["content"] != rejected, F.lit(False))


def box(b: Column) -> Column:
    """A box of 2 or 4 numbers, the latter from the least corner to the greatest; null for other sizes."""
    x = [F.get(b, i) for i in range(4)]
    corners = F.array(F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3]))
    return F.when(F.size(b) == 4, corners).when(F.size(b) == 2, b)


def grid_box(b: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the image, rounded half to even."""
    return F.transform(b, lambda x, i: F.bround(x / F.when(i % 2 == 0, width).otherwise(height) * 1000).cast("int"))


# ---- rewrites


def last_user(messages: Column) -> Column:
    """0-based index of the last user turn, -1 if there is none."""
    roles = F.transform(messages, lambda m: m["role"])
    back = F.array_position(F.reverse(roles), "user")
    return F.when(back > 0, F.size(messages) - back).otherwise(-1).cast("int")


def merged(messages: Column, roles: Sequence[str] = ("user", "assistant"), sep: str = "") -> Column:
    """Neighbouring turns of one of ``roles`` as one turn; null contents count as empty."""
    none = F.array().cast(MESSAGES)

    def step(acc: Column, m: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = F.coalesce((last["role"] == m["role"]) & m["role"].isin(*roles), F.lit(False))
        joined = message(m["role"], F.concat(F.coalesce(last["content"], F.lit("")), F.lit(sep), F.coalesce(m["content"], F.lit(""))), last["loss"])
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(m)))

    return F.aggregate(messages.cast(MESSAGES), none, step)


def without_history_thinking(messages: Column) -> Column:
    """Assistant turns before the last user turn keep what follows their last </think>, trimmed."""
    last = last_user(messages)
    return F.transform(
        messages,
        lambda m, i: message(m["role"], F.when((m["role"] == "assistant") & (i < last), strip(F.substring_index(m["content"], "</think>", -1))).otherwise(m["content"]), m["loss"]),
    )


def with_empty_thinking(messages: Column, prefix: str = "<think>\n\n</think>\n\n") -> Column:
    """Assistant turns without a <think> get ``prefix``."""
    bare = lambda m: (m["role"] == "assistant") & ~m["content"].contains("<think>")
    return F.transform(messages, lambda m: message(m["role"], F.when(bare(m), F.concat(F.lit(prefix), m["content"])).otherwise(m["content"]), m["loss"]))


def loss_scales(messages: Column, strategy: str = "default") -> Column:
    """A weight per turn: the turn's own, else by strategy: 'default' assistant turns, 'last_round' those after the last user turn, 'all'."""
    last = last_user(messages)
    said = lambda m, i: {"default": m["role"] == "assistant", "last_round": (m["role"] == "assistant") & (i > last), "all": F.lit(True)}[strategy]
    return F.transform(messages, lambda m, i: F.coalesce(m["loss"], F.when(said(m, i), 1.0).otherwise(0.0)))


def without_answer(messages: Column) -> Column:
    """The turns but for an assistant turn at the end."""
    ends = F.try_element_at(messages, F.lit(-1))["role"] == "assistant"
    return F.when(ends, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages)


def with_answer(messages: Column, answer: Column) -> Column:
    """An assistant turn at the end, unless the last is one."""
    ends = F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False))
    return F.when(ends | answer.isNull(), messages.cast(MESSAGES)).otherwise(F.concat(messages.cast(MESSAGES), F.array(message("assistant", answer))))


def prompt_key(messages: Column) -> Column:
    """'role:content' of the turns before the first assistant turn, joined by '||'."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant")
    head = F.when(first > 0, F.slice(messages, F.lit(1), (first - 1).cast("int"))).otherwise(messages)
    return F.array_join(F.transform(head, lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "||")


def transcript(messages: Column) -> Column:
    """'Role: content' lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def chunks(tokens: Column, size: int) -> Column:
    """The array cut into parts of ``size``; none for an empty one."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i, size))


def truncated(tokens: Column, size: int, left: bool, protected: Sequence[str]) -> Column:
    """At most ``size`` tokens: protected ones stay, of the others the first (or with ``left`` the last)."""
    keep = F.array(*[F.lit(p) for p in protected])
    is_kept = lambda x: F.array_contains(keep, x)
    room = F.greatest(F.lit(size) - F.size(F.filter(tokens, is_kept)), F.lit(0))
    open_ = F.filter(F.transform(tokens, lambda x, i: F.when(~is_kept(x), i)), lambda i: i.isNotNull())
    chosen = F.slice(open_, F.greatest(F.size(open_) - room + 1, F.lit(1)), room) if left else F.slice(open_, F.lit(1), room)
    return F.when(F.size(tokens) <= size, tokens).otherwise(F.filter(tokens, lambda x, i: is_kept(x) | F.array_contains(chosen, i)))


def dialogue(text: Column, human: str = "Human:", assistant: str = "Assistant:") -> Column:
    """Messages of a text with speaker marks."""
    marked = F.filter(F.split(text, f"(?=\\n\\n{human}|\\n\\n{assistant})"), lambda t: F.trim(t) != "")
    return F.transform(
        marked,
        lambda t: message(F.when(strip(t).startswith(human), "user").otherwise("assistant"), strip(F.regexp_replace(strip(t), f"^(?:{human}|{assistant})", ""))),
    )


def react_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of 'Action:' and 'Action Input:' pairs."""
    names = F.regexp_extract_all(text, F.lit(r"Action:[ \t]*([^\n]+?)[ \t]*\n+Action Input:"), F.lit(1))
    inputs = F.regexp_extract_all(text, F.lit(r"Action Input:[ \t]*([^\n]*?)[ \t]*(?:\n|$)"), F.lit(1))
    return F.zip_with(names, inputs, lambda a, b: F.struct(a.alias("name"), b.alias("arguments")))


def inline_images(text: Column) -> tuple[Column, Column]:
    """(the text with <image> for each <img>..</img>, the paths)."""
    return F.regexp_replace(text, r"<img>.*?</img>", "<image>"), F.regexp_extract_all(text, F.lit(r"<img>(.*?)</img>"), F.lit(1))


def image_prefixed(text: Column, n: Column) -> Column:
    """The text with ``n`` image marks in front, unless it has one."""
    return F.when(text.contains("<image>"), text).otherwise(F.concat(F.repeat(F.lit("<image>"), n), text))


def views(df: DataFrame, keys: Sequence[str], positive: str, negatives: str) -> DataFrame:
    """keys, at, content, label: the positive (1) and then each negative (0)."""
    every = F.concat(F.array(F.col(positive)), F.coalesce(F.col(negatives), F.array().cast("array<string>")))
    return df.select(*keys, F.posexplode(every).alias("at", "content")).withColumn("label", (F.col("at") == 0).cast("int"))


def taxonomy(text: Column, rules: Sequence[tuple[str, str]], blocked: str | None = None) -> Column:
    """The label of the first pattern that the lower-case text has; null if it has none, or has ``blocked``."""
    low, out = F.lower(text), None
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return F.when(~low.rlike(blocked), out) if blocked else out


def recoded(text: Column, names: Mapping[str, str]) -> Column:
    """The entry of the lower-case trimmed text, null if it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.element_at(table, F.lower(F.trim(text)))


__all__ = [n for n, v in list(globals().items()) if callable(v) and not n.startswith("_") and getattr(v, "__module__", "") == __name__] + ["first_truthy"]
