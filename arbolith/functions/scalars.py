"""Column builders: truthiness, parsing of answers, vectors, and small arithmetic.

All are null-safe in the sense stated, stay in the JVM and are deterministic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- truthiness and numbers


def truthy(c: str | Column) -> Column:
    """The string, with the empty one as null."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*cs: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[truthy(c) for c in cs])


def safe_float(c: str | Column, default: float = 0.0) -> Column:
    """The number that the string spells, else ``default``."""
    return F.coalesce(col(c).try_cast("double"), F.lit(float(default)))


def suffix_number(c: str | Column) -> Column:
    """The digits after the last underscore as a number, else 0."""
    return F.coalesce(F.regexp_extract(col(c), r"_(\d+)$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def string_seed(c: str | Column) -> Column:
    """seed = seed * 131 + code of each character, modulo 2^32."""
    codes = F.split(col(c), "")
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, x: F.pmod(s * 131 + F.ascii(x), F.lit(2**32)))


def order_key(seed: int, *keys: str | Column) -> Column:
    """A deterministic random order: the md5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def cosine_schedule(step: Column, total: Column, low: float | Column, high: float | Column) -> Column:
    """high at step 0, low at step ``total``, half a cosine between."""
    high, low = (x if isinstance(x, Column) else F.lit(float(x)) for x in (high, low))
    return high - (high - low) * (1 - F.cos(F.pi() * step / total)) / 2


def warm_up(step: Column, warm: int, total: int) -> Column:
    """Linear to 1 over ``warm`` steps, then half a cosine to 0 at ``total``."""
    done = (step - warm) / max(1, total - warm)
    return F.when(step < warm, step / max(1, warm)).otherwise(F.greatest(F.lit(0.0), (1 + F.cos(F.pi() * done)) / 2))


# ---- texts


def strip(c: str | Column) -> Column:
    """Without the white space of Unicode at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normal_question(c: str | Column) -> Column:
    """Lower case, image marks and runs of white space as one space, trimmed."""
    marks = F.replace(F.lower(col(c)), F.lit("<image>"), F.lit(" "))
    return F.trim(F.regexp_replace(marks, r"\s+", " "))


#: Fixed value: a letter in a box.
BOXED = r"\\boxed\{\s*(?:\\text\{\s*)?([A-Za-z])\s*\}?\s*\}"


def boxed_letters(c: str | Column) -> Column:
    r"""All letters in \boxed{..}, with an optional \text{..} inside and a lost backslash-b mended, in upper case."""
    mended = F.replace(col(c), F.lit("\boxed"), F.lit("\\boxed"))
    found = F.regexp_extract_all(mended, F.lit(BOXED), F.lit(1))
    return F.transform(found, F.upper)


def unique_boxed(c: str | Column) -> Column:
    """The boxed letter, null if there is none or several differ."""
    letters = F.array_distinct(boxed_letters(c))
    return F.when(F.size(letters) == 1, letters[0])


def without_thinking(c: str | Column) -> Column:
    """The text without its <think> blocks, trimmed."""
    return strip(F.regexp_replace(col(c), r"(?is)<think>.*?</think>", ""))


def confidence(c: str | Column) -> Column:
    """'confidence: x' (above 1 as per cent), else 'n%', clamped to 0..1; null if neither is there."""
    stated = F.regexp_extract(F.lower(col(c)), r"confidence\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    percent = F.regexp_extract(col(c), r"([0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double")
    x = F.coalesce(F.when(stated > 1, stated / 100).otherwise(stated), percent / 100)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * F.when(x.isNotNull(), 1.0)


def judge_score(c: str | Column) -> Column:
    """The first of 10 or a digit, by 10; null if there is none."""
    return F.regexp_extract(col(c), r"(10|[0-9])", 1).try_cast("double") / 10


def letter_of(index: Column) -> Column:
    """A for 0; out of the alphabet counts as 0."""
    return F.char(F.lit(65) + F.when(index.between(0, 25), index).otherwise(0))


def answer_index(answer: str | Column, options: str | Column) -> Column:
    """0-based option: a number (0-based, or 1-based if it equals their count), a letter, an option's text; else 0."""
    text, size = F.trim(col(answer)), F.size(col(options))
    digits = F.when(text.rlike(r"^\d{1,9}$"), text.try_cast("int"))
    by_number = F.when(digits < size, digits).when(digits == size, digits - 1).when(digits.isNotNull(), 0)
    letter = F.ascii(F.upper(F.regexp_extract(text, r"^\[?['\"(]?([A-Za-z])['\")]?\]?\.?$", 1))) - 65
    by_letter = F.when(letter.between(0, size - 1), letter)
    by_text = F.nullif(F.array_position(F.transform(col(options), lambda o: F.lower(F.trim(o))), F.lower(text)).cast("int"), F.lit(0)) - 1
    return F.coalesce(by_number, by_letter, by_text, F.lit(0)).cast("int")


def answer_letter(answer: str | Column, n_options: Column) -> Column:
    """The letter that an answer names: a 0-based number, or the first letter A-Z in it; of a list its first item. Null out of range."""
    text = F.trim(col(answer))
    first = F.regexp_extract(text, r"""^\[\s*(?:'([^']*)'|"([^"]*)"|(\d+))\s*[,\]]""", 0)
    item = F.when(text.startswith("[") & (first != ""), F.regexp_replace(first, r"""^\[\s*['"]?|['"]?\s*[,\]]$""", "")).otherwise(text)
    item = F.upper(F.trim(item))
    number = item.rlike(r"^\d+$")
    at = F.when(number, item.try_cast("int")).otherwise(F.ascii(F.nullif(F.regexp_extract(item, "([A-Z])", 1), F.lit(""))) - 65)
    room = F.when(number, F.least(n_options, F.lit(26))).otherwise(F.when(n_options > 0, F.least(n_options, F.lit(26))).otherwise(26))
    return F.when(at.between(0, room - 1), F.char(at + 65))


def predicted_letter(c: str | Column, n_options: Column) -> Column:
    """The boxed letter, whatever the options; without one, or if boxes differ, the first after 'answer:', null beyond the options."""
    named = F.nullif(F.upper(F.regexp_extract(col(c), r"(?i)(?:answer|final answer)\s*[:：]\s*\(?\s*([A-Z])\s*\)?", 1)), F.lit(""))
    room = F.when(n_options > 0, F.least(n_options, F.lit(26))).otherwise(26)
    return F.coalesce(unique_boxed(c), F.when((F.ascii(named) - 65) < room, named))


#: How texts name a letter, in order; the first found counts.
PREDICTIONS = (
    r"\\boxed\{\s*([A-Ja-j])\s*\}",
    r"[Ff]inal [Aa]nswer\s*[:：]?\s*([A-Ja-j])\b",
    r"[Tt]he answer is\s*[:：]?\s*([A-Ja-j])\b",
    r"[Aa]nswer\s*[:：]?\s*([A-Ja-j])\b",
)


def stated_letter(c: str | Column) -> Column:
    """The boxed letter if there is one; else the first that a pattern of PREDICTIONS finds, in upper case."""
    found = [F.nullif(F.upper(F.regexp_extract(col(c), p, 1)), F.lit("")) for p in PREDICTIONS]
    return F.coalesce(unique_boxed(c), *found)


def bare_option(c: Column) -> Column:
    """An option without its '(A)', 'A.' or 'A:' in front."""
    return F.trim(F.regexp_replace(c, r"^\s*\(?[A-Z][).:]\s+", ""))


def options_text(options: str | Column) -> Column:
    """'(A) first' and so on, one line each."""
    return F.array_join(F.transform(col(options), lambda o, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), bare_option(o))), "\n")


def filled(template: str, values: Mapping[str, Column]) -> Column:
    """``template`` with every {{key}} replaced; null values become empty."""
    out = F.lit(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def media_kind(c: str | Column) -> Column:
    """image, audio, video or other, by the extension."""
    ext = F.lower(F.regexp_extract(col(c), r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return (
        F.when(ext.isin("jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff"), "image")
        .when(ext.isin("wav", "mp3", "flac", "ogg", "m4a"), "audio")
        .when(ext.isin("mp4", "avi", "mov", "mkv", "webm"), "video")
        .otherwise("other")
    )


def safe_name(c: str | Column) -> Column:
    """The id as a file name."""
    return F.replace(col(c), F.lit("/"), F.lit("__"))


def words(c: str | Column) -> Column:
    """Lower-case words between white space; none for blank texts."""
    t = F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def n_grams(tokens: Column, n: int) -> Column:
    """The runs of ``n`` tokens, joined by a space."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


# ---- rewards


def format_reward(c: str | Column) -> Column:
    """1 if the text is a <think> block and then an <answer> block to its end, else 0."""
    return F.coalesce(col(c).rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z").cast("double"), F.lit(0.0))


def react_reward(c: str | Column) -> Column:
    """1 if the text is a <think> block and then an action with its input, else 0."""
    return F.coalesce(col(c).rlike(r"(?s)\A<think>.*?</think>\s*Action:.*?Action Input:.*?\z").cast("double"), F.lit(0.0))


def repetition_penalty(c: str | Column, n: int, penalty: float) -> Column:
    """penalty * (1 - distinct / all n-grams); 0 for texts of fewer words."""
    grams = n_grams(words(c), n)
    share = F.size(F.array_distinct(grams)) / F.size(grams)
    return F.when(F.size(grams) > F.size(F.array_distinct(grams)), penalty * (1 - share)).otherwise(F.lit(0.0))


def overlong_penalty(length: Column, limit: int, margin: int) -> Column:
    """0 up to ``limit - margin``, then falling by one over the margin."""
    return F.least(-(length - (limit - margin)) / margin, F.lit(0.0))


def cosine_reward(correct: Column, length: Column, limit: int, right: tuple[float, float], wrong: tuple[float, float]) -> Column:
    """Cosine over the length: from ``right[1]`` at 0 to ``right[0]`` at the limit if correct; wrong ones the other way."""
    return F.when(correct, cosine_schedule(length, F.lit(limit), right[0], right[1])).otherwise(
        cosine_schedule(length, F.lit(limit), wrong[1], wrong[0])
    )


#: How completions state their letter, in order.
STATED = (
    r"<answer>\s*([A-J])\s*</answer>",
    r"\\boxed\{([A-J])\}",
    r"(?:answer|Answer)\s*(?:is|:)\s*\*?\*?\s*\(?([A-J])\)?",
    r"(?:correct|best)\s+(?:answer|option|choice)\s+is\s+\(?([A-J])\)?",
)


def flexible_answer(c: str | Column) -> Column:
    """The first letter that a pattern of STATED finds, else the last lone letter of the last 200 characters before a point, comma, space or the end."""
    found = [F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")) for p in STATED]
    lone = r"(?s)^(?:.*[^\p{L}\p{N}_])?([A-J])(?:[.,\s].*)?$"
    return F.coalesce(*found, F.nullif(F.regexp_extract(F.right(col(c), F.lit(200)), lone, 1), F.lit("")))


def stated_reward(c: str | Column) -> Column:
    """The number in 0..1 after 'Reward:', null if there is none."""
    return F.regexp_extract(col(c), r"Reward:\s*([0-1](?:\.\d+)?)", 1).try_cast("double")


# ---- vectors


def dot(a: str | Column, b: str | Column) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l1(a: str | Column, b: str | Column) -> Column:
    gaps = F.zip_with(col(a), col(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def l2(a: str | Column, b: str | Column) -> Column:
    gaps = F.zip_with(col(a), col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def unit(a: str | Column) -> Column:
    """The vector by its length."""
    n = norm(a)
    return F.transform(col(a), lambda x: x.cast("double") / n)


def softmax_entropy(logits: str | Column) -> Column:
    """Shannon entropy in nats of the softmax of the logits."""
    x = F.transform(col(logits), lambda v: v.cast("double"))
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    weighted = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top) * (v - top))
    return F.ln(total) - weighted / total


def padded(a: Column, n: int, value: int, left: bool = False) -> Column:
    """The array with ``value`` up to length ``n`` on the right or left; longer ones unchanged."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(n) - F.size(a)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def one_of(choices: Sequence[str], key: Column, seed: int = 42) -> Column:
    """A choice that depends on the key alone."""
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(choices)))
    return F.array(*[F.lit(c) for c in choices])[at.cast("int")]
