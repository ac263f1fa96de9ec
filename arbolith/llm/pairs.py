"""Broken prompt and response pairs, each with its defect."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.llm.truncation import truncated_values
from arbolith.storage import materialize
from arbolith.tables import latest

#: Templates are compared by shingles of so many words, from this similarity on.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of so many hashes; at SIMILAR a pair meets in some band with probability 0.985.
BANDS, ROWS = 8, 4
#: A template recurs if its answers belong to so many prompts, and tells something if it has so many words of its own.
RECURS, OWN = 3, 2
#: A recurring template reveals refusals if at most this share of the answers with it names an option or a value.
ANSWERS = 0.25
#: A word is topical if so large a share of the answers that have it have it from their own prompt.
TOPICAL = 0.05
#: Topical words are kept as a bit each in so many slots (512 KB), however many words there are.
SLOTS = 1 << 22
#: A copy covers so much of the prompt's words and has at most this share of others, or so many.
COPIED, NOVEL, NOVEL_WORDS = 0.75, 0.12, 2

# What stands for "no answer". Compared in lower case without outer marks.
PLACEHOLDERS = frozenset(
    "n/a na none null nil nan empty no_answer no-answer undefined unknown tbd todo missing - -- --- . .. ... … ? "
    "_ * # /".split()
) | {"no answer", "not available", "not applicable", "no response", "no reply", "no output", "to be done", ""}
CHOICE = re.compile(r"\\boxed\s*\{\s*(?:\\text\s*\{)?\s*[A-Za-z0-9]|(?:answer|choice|chosen|option)\W{0,4}\s*\(?[A-J]\b|\*\*\(?[A-J]\)?\*\*|→\s*[A-J]\b|\([A-J]\)\s*$|\"answer\"\s*:")
#: An option's letter alone at the end of a sentence.
LETTER = re.compile(r"(?<![A-Za-z0-9'’])[A-HJ](?=[\s.)\]*\"]*(?:$|\n|[.!?。]))")
#: Words and what ends a clause; letters of scripts without spaces are words of their own.
TOKEN = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}\p{Nd}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+|[.!?:;,](?=\s)|[。！？；：，\n]")
ASCII_TOKEN = re.compile(r"[0-9a-z]+|[.!?:;,](?=\s)|\n")
INVISIBLE = regex.compile(r"[\s\p{Cf}\p{Cc}\p{Z}\u115F\u1160\u3164\uFFA0\u2800]+")
ASCII_INVISIBLE = re.compile(r"[\x00-\x20\x7f]+")
WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
ASCII_WORD = re.compile(r"[0-9a-z]+")
EMPTY_BOX = re.compile(r"(?:(?:my |the )?(?:final )?answer(?: is)?\s*:?\s*)?\$*\\boxed\s*\{\s*(?:\\text\s*\{\s*\})?\s*\}\$*\.?", re.I)
MARKS = " <>()[]{}`*_\"'.$:|\\/~-"
# Frequent words of languages in Latin letters.
STOPWORDS = {
    "en": "the of and to in is that it for on with as are be by this which if then than from its at was not have has does when how what so",
    "fr": "si le la les des du et est une un que dans pour pas ne il elle sur avec au aux ce cette se qui plus par sont donc parce lorsque entre",
    "de": "der die das und ist nicht von den mit zu ein eine dem im auf für als auch es an werden aus wird dass weil nach bei muss wenn sich",
    "es": "si solo sobre el la los las de y es que en un una por con no para se del al lo como más su pero esta cuando porque hay entre según",
    "it": "il lo la gli le di è che un una per con non si del della sono nel alla come più ma quando perché questo",
    "pt": "os as de é que um uma para com não se do da no na por mais como mas quando porque são ao",
    "nl": "de het een en van is dat niet op te in voor met zijn als aan er maar om door bij wordt",
}
LANGUAGES = {w: tuple(k for k, v in STOPWORDS.items() if w in v.split()) for v in STOPWORDS.values() for w in v.split()}
# Letters that tell languages in Latin letters apart.
ACCENTS = {"ñ¿¡": ("es",), "óíú": ("es", "pt"), "á": ("es", "pt"), "ãõ": ("pt",), "ß": ("de",), "äöü": ("de",), "êâîôûœù": ("fr",), "èà": ("fr", "it"), "ç": ("fr", "pt"), "ìò": ("it",), "é": ("fr", "es")}
LETTERS = {c: names for chars, names in ACCENTS.items() for c in chars}
SCRIPTS = (
    ("ru", regex.compile(r"\p{Cyrillic}")),
    ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")),
    ("zh", regex.compile(r"\p{Han}")),
    ("ko", regex.compile(r"\p{Hangul}")),
    ("ar", regex.compile(r"\p{Arabic}")),
    ("el", regex.compile(r"\p{Greek}")),
    ("he", regex.compile(r"\p{Hebrew}")),
    ("hi", regex.compile(r"\p{Devanagari}")),
    ("th", regex.compile(r"\p{Thai}")),
)


def language(text: str, words: list[str] | None = None) -> str | None:
    """The language of running text: by script, or by frequent words in Latin letters; None if too little tells.

    ``words`` are its words in lower case, if known.
    """
    ascii_ = text.isascii()
    if not ascii_ and max(text) > "\u036f":  # beyond Latin letters and marks
        letters = sum(map(str.isalpha, text))
        for name, script in SCRIPTS:
            n = len(script.findall(text))
            if n >= 6 and n >= 0.4 * letters:
                return name
    words = words_of(text) if words is None else words
    if len(words) < 4:
        return None
    score: dict[str, int] = {}
    for names in filter(None, map(LANGUAGES.get, words)):
        for name in names:
            score[name] = score.get(name, 0) + 1
    if not ascii_:
        for c in set(text.lower()):
            for name in LETTERS.get(c, ()):
                score[name] = score.get(name, 0) + 1
    best = sorted(score.values(), reverse=True)[:2]
    if not best or best[0] < 2 and best[0] < 0.15 * len(words) or len(best) > 1 and best[0] == best[1]:
        return None
    return max(score, key=score.__getitem__)


def words_of(text: str) -> list[str]:
    """Runs of letters, marks and digits, in lower case."""
    return ASCII_WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in WORD.findall(text)]


def is_empty(answer: str | None, error: str | None) -> bool:
    """Nothing but white space, invisible characters, a placeholder, an empty box or block, or the error itself."""
    if not answer:
        return True
    seen = (ASCII_INVISIBLE if answer.isascii() else INVISIBLE).sub(" ", answer).strip()
    bare = seen.strip(MARKS)
    if not seen or bare.lower() in PLACEHOLDERS or any(map(EMPTY_BOX.fullmatch, (bare, seen, seen.replace("*", "").strip()))):
        return True
    own = INVISIBLE.sub(" ", error or "").strip()
    return bool(own) and bare == own.strip(MARKS)


def is_copy(prompt: list[str], answer: list[str]) -> bool:
    """All or nearly all of the prompt's words and next to nothing else; repeats of the prompt count once."""
    if len(prompt) < 3 or len(answer) < 3:
        return False
    known = set(prompt)
    if sum(w not in known for w in answer) > max(NOVEL_WORDS, NOVEL * len(answer)):
        return False
    a = Counter(answer)
    return sum(min(n, a[w]) for w, n in Counter(prompt).items()) >= COPIED * len(prompt)


class Look(NamedTuple):
    empty: bool
    copy: bool
    foreign: bool
    choice: bool
    said: str | None


QUOTING = re.compile(r"^\W*(?:you asked|the question (?:asks|is|was)|question|q|asked|prompt)\s*:\s*", re.I)


def look(prompt: str | None, answer: str | None, error: str | None) -> Look:
    """The checks of one pair, and what it says in clauses; ``choice``: it names an option, or a value the prompt hasn't."""
    if is_empty(answer, error):
        return Look(True, False, False, False, None)
    said = QUOTING.sub("", answer)
    a_words = words_of(said)
    p_words, known, target = _prompt(prompt or "")
    named = bool(CHOICE.search(answer))
    copy = not named and is_copy(p_words, a_words)
    foreign = False
    if target is not None and len(answer) > 8:
        spoken = language(said, a_words)
        foreign = spoken is not None and spoken != target
    text = clauses(answer, known)
    return Look(False, copy, foreign, named or not text or "#" in text or bool(LETTER.search(answer)), text)


@lru_cache(maxsize=4096)
def _prompt(prompt: str) -> tuple[list[str], frozenset[str], str | None]:
    words = words_of(prompt)
    return words, frozenset(words).union(_tokens(prompt)), language(prompt, words)


def _tokens(text: str) -> list[str]:
    return ASCII_TOKEN.findall(text.lower()) if text.isascii() else TOKEN.findall(text.lower())


def clauses(answer: str, known: frozenset[str]) -> str:
    """The clauses of ``answer``, one a line: its words in lower case, with _ before those of the prompt, and # for other numbers."""
    out, line = [], []
    for t in _tokens(answer):
        if t in known and t[0].isalnum():
            line.append("_" + t)
        elif t.isdigit():
            line.append("#")
        elif t[0].isalpha() or t.isalnum():
            line.append(t)
        elif line:
            out.append(" ".join(line))
            line = []
    if line:
        out.append(" ".join(line))
    return "\n".join(out)


@lru_cache(maxsize=1 << 18)
def slot(word: str) -> int:
    """The slot of a word, as Spark's xxhash64 of it gives it."""
    return xxhash.xxh64_intdigest(word, seed=42) & (SLOTS - 1)


def template(clause: str, topical: np.ndarray) -> str:
    """A line of :func:`clauses` with a _ for each run of topical words."""
    out: list[str] = []
    for w in clause.split(" "):
        if w[0] == "_" or w != "#" and topical[slot(w)]:
            if not out or out[-1] != "_":
                out.append("_")
        else:
            out.append(w)
    return " ".join(out)


def own_words(frame: str) -> int:
    return sum(w not in ("_", "#") for w in frame.split(" "))


def shingles(frame: str) -> set[int]:
    words = frame.split()
    n = max(1, len(words) - SHINGLE + 1)
    return {xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE])) for i in range(n)}


_MIX = np.random.default_rng(7).integers(1, 2**63, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def bands(frame: str) -> list[int]:
    """A bucket per band of the MinHash of the template's shingles."""
    x = np.fromiter(shingles(frame), np.uint64)[:, None]
    with np.errstate(over="ignore"):
        h = (x * _MIX[0] + _MIX[1]) ^ (x >> np.uint64(29)) * _MIX[1]
    low = h.min(axis=0).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(bytes([i]) + low[i].tobytes()) - 2**63 for i in range(BANDS)]


def similarity(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def looked(df: DataFrame, keys: list[str], prompt: str, answer: str, error: str, live: str | None = None) -> DataFrame:
    """keys and the checks of :func:`look`, in Arrow batches; rows that aren't ``live`` are not looked at."""
    kinds = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    use = F.coalesce(F.col(live), F.lit(False)) if live else F.lit(True)
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], use.alias("use"), *[F.when(use, F.col(c)).alias(f"t{i}") for i, c in enumerate((prompt, answer, error))])
    dead = Look(True, False, False, False, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in batches:
            got = [look(*r) if use else dead for use, *r in zip(*(c.to_pylist() for c in batch.columns[-4:]))]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *cols], names=[*names, *Look._fields])

    given = ", ".join(f"{n} {kinds[c]}" for c, n in zip(keys, names))
    out = rows.mapInArrow(run, f"{given}, empty boolean, copy boolean, foreign boolean, choice boolean, said string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], *Look._fields)


def topical_words(looks: DataFrame) -> np.ndarray:
    """A flag per slot: words that answers take from their prompts, counted over all answers in their prompt's language.

    Words that share a slot are counted together; the slots' number is fixed,
    so what the driver gets and broadcasts is 512 KB at any size.
    """
    words = looks.filter("said IS NOT NULL AND NOT foreign").select(F.explode(F.array_distinct(F.split("said", "[ \n]"))).alias("w"))
    own = F.col("w").startswith("_")
    word = F.when(own, F.substring("w", F.lit(2), F.length("w"))).otherwise(F.col("w"))
    at = F.xxhash64(word).bitwiseAND(F.lit(SLOTS - 1)) + 1  # the bitmap functions count from 1
    per = words.filter("w NOT IN ('', '#')").groupBy(at.alias("slot")).agg(F.count("*").alias("n"), F.sum(own.cast("long")).alias("own"))
    maps = (
        per.filter(F.col("own") >= TOPICAL * F.col("n"))
        .groupBy(F.bitmap_bucket_number("slot").alias("at"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        .collect()  # at most SLOTS / 32768 rows of 4 KB
    )
    out = np.zeros(SLOTS, dtype=bool)
    for r in maps:
        start = (r["at"] - 1) * 32768
        out[start : start + 32768] = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
    return out


def templates(looks: DataFrame, topical: np.ndarray) -> DataFrame:
    """row, prompt_id, choice, candidate, size and frame: every distinct template of every answer.

    An answer is a candidate, which may be a refusal, if it names no option or
    value and each of its clauses has a word that isn't topical; size is its
    number of templates.
    """
    packed = looks.sparkSession.sparkContext.broadcast(np.packbits(topical))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            at, frames, able, size = [], [], [], []
            for i, (said, choice) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())):
                own = {template(c, flags) for c in said.split("\n")}
                candidate = not choice and all(map(own_words, own))
                at += [i] * len(own)
                frames += own
                able += [candidate] * len(own)
                size += [len(own)] * len(own)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(c.take(where) for c in batch.columns[:3]), pa.array(able, pa.bool_()), pa.array(size, pa.int32()), pa.array(frames, pa.string())],
                names=["row", "prompt_id", "choice", "candidate", "size", "frame"],
            )

    said = looks.filter("said <> ''").select("row", "prompt_id", "choice", "said")
    return said.mapInArrow(run, "row long, prompt_id long, choice boolean, candidate boolean, size int, frame string")


def template_clusters(counted: DataFrame) -> DataFrame:
    """leader, frame, n, choices, prompts: each template with those it is similar to, and every one with itself.

    Templates are put into MinHash buckets, held against the most frequent of
    their bucket, the leader, and before that against their neighbour in it,
    and joined to whichever their shingles are similar enough to. Templates
    too short for any other to be similar enough are only alike if equal.
    """
    least = next(k for k in range(1, 100) if k / (k + 1) >= SIMILAR)  # shingles of the shortest that can meet a longer one
    long = counted.filter(F.size(F.split("frame", " ")) >= least + SHINGLE - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).to_pylist()
            where = pa.array(np.repeat(np.arange(len(text)), BANDS))
            hashes = pa.array([b for t in text for b in bands(t)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(where) for c in batch.columns), hashes], names=["frame", "n", "bucket"])

    member = materialize(long.select("frame", "n").mapInArrow(run, "frame string, n long, bucket long"), "buckets")
    leader = member.groupBy("bucket").agg(F.count("*").alias("size"), F.max(F.struct("n", "frame")).alias("lead")).filter("size > 1")
    near = member.join(leader.select("bucket", F.col("lead.frame").alias("leader")).hint("merge"), "bucket")
    beside = near.withColumn("leader", F.lag("frame").over(Window.partitionBy("bucket").orderBy("frame"))).filter("leader IS NOT NULL")
    pairs = near.select("leader", "frame").unionByName(beside.select("leader", "frame")).filter("leader <> frame").distinct()

    def words(c: str) -> Column:
        w = F.split(c, " ")
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))

    both = F.size(F.array_intersect(words("leader"), words("frame")))
    either = F.size(F.array_union(words("leader"), words("frame")))
    linked = pairs.filter(both >= SIMILAR * either)
    linked = linked.unionByName(linked.select(F.col("frame").alias("leader"), F.col("leader").alias("frame")))  # evidence counts both ways
    own = counted.select(F.col("frame").alias("leader"), "frame", "n", "choices", "prompts")
    return own.unionByName(linked.distinct().join(counted.hint("merge"), "frame").select(*own.columns))


def refusals(looks: DataFrame) -> DataFrame:
    """row: the answers that decline, from rows of :func:`looked` with ``row`` and ``prompt_id``.

    What an answer says is cut into clauses, and topical words are masked. A
    clause's template that recurs across unrelated prompts, while the answers
    with it (or with one similar to it) hardly ever name an option or a value,
    reveals refusals: it is what stands in an answer's place. An answer
    declines if it has such a template, names nothing itself, and consists of
    recurring templates only, so nothing in it is about its own question.

    No list of phrases is used. The share of answers is drawn towards that of
    the whole table by one answer, so that few cases prove nothing.
    """
    found = materialize(templates(looks, topical_words(looks)), "templates")
    counted = found.groupBy("frame").agg(
        F.count("*").alias("n"), F.sum(F.col("choice").cast("long")).alias("choices"), F.approx_count_distinct("prompt_id").alias("prompts"), F.max("candidate").alias("candidate")
    )
    counted = materialize(counted, "counted")
    usual = looks.filter("said IS NOT NULL").agg(F.coalesce(F.avg(F.col("choice").cast("double")), F.lit(0.0)).alias("usual"))
    judged = template_clusters(counted).groupBy(F.col("leader").alias("frame")).agg(*[F.sum(c).alias(c) for c in ("n", "choices", "prompts")])
    judged = judged.filter(F.col("prompts") >= RECURS).crossJoin(F.broadcast(usual))  # one row
    own = F.size(F.filter(F.split("frame", " "), lambda w: ~w.isin("_", "#")))
    tells = (own >= OWN) & (F.col("choices") + F.col("usual") <= ANSWERS * (F.col("n") + 1))
    judged = judged.join(counted.filter("candidate").select("frame").hint("merge"), "frame", "left_semi").select("frame", tells.alias("tells"))
    on = found.filter("candidate").join(judged.hint("merge"), "frame")
    per = on.groupBy("row").agg(F.count("*").alias("known"), F.first("size").alias("size"), F.max("tells").alias("tells"))
    return per.filter("tells AND known = size").select("row")


def pair_defects(
    df: DataFrame, keys: list[str], prompt: str, answer: str, error: str, source: str, order: list[str] | None = None, live: str | None = None
) -> DataFrame:
    """keys and ``defect`` of every defective pair: 'empty', 'truncated', 'refusal', 'copy' or 'language'.

    A pair has the first that holds of: empty (nothing but white space,
    invisible characters, a placeholder, an empty box or its own error),
    truncated (a lost tail, see :func:`truncated_values`; ``source`` names what
    wrote the answer), refusal (see :func:`refusals`), copy (nearly all of the prompt's words and no
    others), language (running text in another language than the prompt).

    With ``order`` only the current version of each key counts, and with
    ``live`` only if that column is true for it. A null prompt can be neither
    copied nor in another language; a null answer is empty; an empty table
    gives none; repeated rows without ``order`` give a row each; other columns
    aren't read.
    """
    order = order or []
    flag = [live] if live else []
    rows = df.select(*keys, *order, *flag, F.xxhash64(prompt).alias("prompt_id"), F.col(prompt).alias("__q"), F.col(answer).alias("__a"), F.col(error).alias("__e"), F.col(source).alias("__s"))
    at = rows.withColumn("__row", F.monotonically_increasing_id()) if not order else rows
    own = keys if order else [*keys, "__row"]
    if not order:
        at = materialize(at, "pairs")
    looks = looked(at, [*own, *order, *flag, "prompt_id"], "__q", "__a", "__e", live)
    if order:
        looks = latest(looks, keys, order)
    if live:
        looks = looks.filter(F.col(live))
    looks = materialize(looks.drop(*order, *flag).withColumn("row", F.monotonically_increasing_id()), "looks")
    cut = truncated_values(at, own, {"__a": "__s"}, order).filter("truncated").select(*own, F.lit(True).alias("cut"))
    same = [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(own)]
    cut = cut.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(own)], "cut")
    declined = refusals(looks).withColumn("refusal", F.lit(True))
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("cut"), "truncated")
        .when(F.col("refusal"), "refusal")
        .when(F.col("copy"), "copy")
        .when(F.col("foreign"), "language")
    )
    out = looks.drop("said").join(cut.hint("merge"), same, "left").join(declined.hint("merge"), "row", "left")
    return out.select(*keys, defect.alias("defect")).filter("defect IS NOT NULL")
