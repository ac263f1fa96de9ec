"""How a text ends: whole, certainly cut, or doubtful; JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of ending.
BLANK, WHOLE, MARKED, OPEN, ELLIPSIS, DOUBTFUL, BRIEF = range(7)

# What loggers and transports put in place of a lost tail.
MARKER = (
    r"(?:\uFFFD+"
    r"|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?"
    r"|[\[<({]\s*(?:cut|cut off|clipped|truncated|omitted|continued|more|snip|…|\.\.\.|\+\s?\d+\s?(?:chars|characters|bytes|tokens|more)?)\s*[\]>)}]"
    r"|\p{L}-)$"
)
ELLIPSIS_END = r"\s*(?:…|\.{3,})$"
TERMINAL = r"[.!?。！？؟।]['\"”’»)\]*_]*$"
#: A point after digits in a text of Chinese characters is a decimal point, as its sentences end otherwise.
HALF_NUMBER = r"\p{IsHan}\s*\d+\.$"
CLOSED = (
    r"(?:\*\*[^*\n]{1,60}\*\*|→\s*\(?[A-Z]\)?|(?:^|\s)\([A-Z]\)|\$\$|```|\$?\\boxed\s*\{(?:[^{}]|\{[^{}]*\})*\}\$?)$"
)
GROUP = r"(?:\s*(?:\([^()\n]{1,60}\)|\[[^\[\]\n]{1,60}\]))+$"
LIST_LINE = r"^\s*(?:[-*•]|\d{1,3}[.)])\s+\S"
LABEL_LINE = r"(?i:answer|choice|option|chosen|result)\b[^.!?\n]{0,14}\s\(?[A-Z]\)?$|^\S[^.!?\n]{0,24}:\s\S{1,12}$"
FORMULA = r"[=≈]\s*[-+]?\d"
# Words after which no text of these languages ends.
DANGLING = (
    "a an the of and or to in on at by with from for is are was were that which if when than as its their this "
    "und oder der die das den dem ein eine von mit zu im nicht weil dass "
    "le la les un une des du et ou de dans avec que qui pour est "
    "el los las una y o del con por para es"
).split()
DANGLING_END = r"\s(?:" + "|".join(DANGLING) + r")$"
#: The last word is looked for in so many last characters; one as long as that may be longer and is not judged.
LAST_WORD = 60


def with_ending(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: struct(kind int, last_word string, tail string) of the column ``text``.

    kind: BLANK null or white space; WHOLE ends as a text does (also lists of
    brackets, boxes and closed blocks); MARKED ends in a truncation mark or an
    incomplete escape or character; OPEN running text without an end; ELLIPSIS
    ends in dots, the author's or a log's; DOUBTFUL a list, formula or label,
    which needs no full stop; BRIEF at most six words without an end.
    last_word is the last run of letters in lower case, tail the last sentence.
    Each step is a projection of its own, so that Catalyst evaluates it once.
    """
    S, E, D, W, B, G, C, L, T = (f"__{out}_{x}" for x in "sedwbgclt")
    s, whole, base, core, line, tail = (F.col(x) for x in (S, W, B, C, L, T))

    def last(n: int) -> Column:
        return F.right(E, F.lit(n))

    def odd(mark: str) -> Column:
        return ((F.length(text) - F.length(F.replace(F.col(text), F.lit(mark), F.lit("")))) / len(mark)) % 2 == 1

    unclosed = odd("```") | odd("$$") | last(90).rlike(r"\\boxed\s*\{[^{}]*(?:\{[^{}]*)?$")
    words = F.size(F.split(core, r"\s+"))
    kind = (
        F.when(s.isNull() | (s == ""), BLANK)
        .when(whole, WHOLE)
        .when(last(40).rlike(MARKER), MARKED)
        .when(F.col(D), ELLIPSIS)
        .when(unclosed, OPEN)
        .when(last(90).rlike(CLOSED), WHOLE)
        .when(core == "", WHOLE)
        .when(F.col(G) & core.rlike(r"(?:[.!?。！？؟।]['\"”’»)\]*_]*|```|\$\$|:)$"), WHOLE)
        .when(line.rlike(LABEL_LINE), WHOLE)
        .when(F.right(core, F.lit(12)).rlike(DANGLING_END), OPEN)
        .when(line.rlike(LIST_LINE) | tail.rlike(FORMULA), F.when(F.col(G), WHOLE).otherwise(DOUBTFUL))
        .when((F.length(text) <= 60) & (words <= 6) & ~core.rlike(r"[.!?]\s|[。！？，\n]|\p{IsHan}{4}"), BRIEF)
        .otherwise(OPEN)
    )
    rtrim = F.expr("rtrim(concat(' ', chr(9), chr(10), chr(13), chr(11), chr(12)), {})".format(f"`{text}`"))
    return (
        df.withColumn(S, rtrim)
        .withColumn(E, F.right(S, F.lit(90)))
        .withColumn(D, last(3).rlike(r"(?:…|\.{3})$"))
        .withColumn(W, ~F.col(D) & last(12).rlike(TERMINAL) & ~last(24).rlike(HALF_NUMBER))
        .withColumn(B, F.when(F.col(D), F.regexp_replace(S, r"\s*(?:…|\.{3,})$", "")).when(~whole, s))
        .withColumn(G, last(1).isin(")", "]") & base.rlike(GROUP))
        .withColumn(C, F.trim(F.when(F.col(G), F.regexp_replace(B, GROUP, "")).otherwise(base)))
        .withColumn(L, F.substring_index(C, "\n", -1))
        .withColumn(T, F.regexp_replace(L, r"^.*[.!?]['\"”’»)\]]*\s+(?=\S)", ""))
        .withColumn(
            out,
            F.struct(
                kind.cast("int").alias("kind"),
                F.lower(F.regexp_extract(F.right(B, F.lit(LAST_WORD)), r"(\p{L}+)\P{L}*$", 1)).alias("last_word"),
                tail.alias("tail"),
            ),
        )
        .drop(S, E, D, W, B, G, C, L, T)
    )
