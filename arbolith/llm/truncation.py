"""Texts cut off by field limits or lost transfers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.llm.endings import BRIEF, DOUBTFUL, ELLIPSIS, LAST_WORD, MARKED, OPEN, WHOLE, with_ending
from arbolith.storage import materialize, small_side
from arbolith.tables import latest

#: Lengths within so many of each other make up the local level a spike is held against.
NEAR = 15
#: A spike has so many times the local level of values that end open, is so many standard deviations above it, and this share of its values ends open.
SPIKE_TIMES, SPIKE_SIGMA, SPIKE_OPEN = 3.0, 4.0, 0.4
#: Units of length that limits are set in; a word is what blanks separate.
UNITS = ("chars", "bytes", "words")
#: Dots are their author's if their last sentence surely has such a share of its source's values in the field,
#: or of all values of the field.
SOURCE_SHARE, FIELD_SHARE = 0.005, 0.001
#: Where whole values end in white space no more often than this, white space at the end is what a cut left.
BLANK_SHARE = 0.005


def field_endings(
    df: DataFrame, keys: Sequence[str], fields: Mapping[str, str], order: Sequence[str | Column] = ()
) -> DataFrame:
    """One row per key and field with text: keys, field_name, source, n_chars, n_bytes, n_words, kind, last_word, tail, blank_end.

    ``fields`` maps a text column to the column that names what wrote it. With
    ``order`` only the current version of each key counts. The features are
    made before the versions are compared, so no text is shuffled; tail is a
    hash of the last sentence with its numbers masked, for the kinds that need it.
    """
    rows = df
    for i, text in enumerate(fields):
        rows = with_ending(rows, text, f"__end{i}")
    parts = [
        F.struct(
            F.lit(text).alias("field_name"),
            F.col(source).cast("string").alias("source"),
            F.length(text).alias("n_chars"),
            F.octet_length(text).alias("n_bytes"),
            (F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) + 1).alias("n_words"),
            F.col(f"__end{i}.kind").alias("kind"),
            F.when(F.col(f"__end{i}.kind").isin(ELLIPSIS, DOUBTFUL, BRIEF), F.col(f"__end{i}.last_word")).alias("last_word"),
            F.when(F.col(f"__end{i}.kind").isin(ELLIPSIS, DOUBTFUL), F.xxhash64(F.regexp_replace(f"__end{i}.tail", r"\d+", "0"))).alias("tail"),
            F.right(text, F.lit(1)).rlike(r"\s").alias("blank_end"),
        )
        for i, (text, source) in enumerate(fields.items())
    ]
    rows = rows.select(*keys, *order, F.array(*parts).alias("__fields"))
    if order:
        rows = latest(rows, keys, order)
    return rows.select(*keys, F.explode("__fields").alias("f")).filter("f.kind > 0").select(*keys, "f.*")


def length_spikes(endings: DataFrame) -> DataFrame:
    """field_name, source, unit (of UNITS), n: lengths at which a limit cuts; dots of the author's (``common``) are no open end.

    A length is a spike if at least SPIKE_OPEN of its texts end open, and
    these are at least SPIKE_TIMES the mean number of such texts at the lengths
    within NEAR and exceed it by SPIKE_SIGMA standard deviations of a count. A
    limit that all texts of a source keep is its maximum; one that holds for
    some of them, as here, has longer texts above it, so a pile is looked for
    instead. Histograms are aggregated before the shuffle and have one row per
    length.
    """
    dots = (F.col("kind") == ELLIPSIS) & ~F.col("common")  # a log may put them in place of the rest
    is_open = (F.col("kind").isin(OPEN, MARKED) | dots).cast("int")
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"n_{u}").alias("n")) for u in UNITS]))
    hist = (
        endings.select("field_name", "source", is_open.alias("o"), units.alias("u"))
        .groupBy("field_name", "source", "u.unit", "u.n")
        .agg(F.count("*").alias("all"), F.sum("o").alias("open"))
    )
    near = Window.partitionBy("field_name", "source", "unit").orderBy("n").rangeBetween(-NEAR, NEAR)
    level = (F.sum("open").over(near) - F.col("open")) / (2 * NEAR)
    return (
        hist.withColumn("level", level)
        .filter(
            (F.col("open") >= SPIKE_OPEN * F.col("all"))
            & (F.col("open") >= SPIKE_TIMES * F.col("level"))
            & (F.col("open") - F.col("level") >= SPIKE_SIGMA * F.sqrt(F.col("level") + 1))
        )
        .select("field_name", "source", "unit", "n")
    )


def word_prefixes(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """word: the words inside the texts and their prefixes up to LAST_WORD letters; whole: whether it is a word itself.

    A text's last run of letters doesn't count, as it may be cut.
    """
    texts = df.select(F.explode(F.array(*fields)).alias("text")).filter("text <> ''")
    inner = F.slice(F.split("text", r"\P{L}+"), 1, F.greatest(F.size(F.split("text", r"\P{L}+")) - 2, F.lit(0)))
    words = (
        texts.select(F.explode(inner).alias("word"))
        .groupBy("word")
        .agg(F.lit(1).alias("__one"))
        .filter("word <> ''")
        .select(F.lower("word").alias("word"))
        .distinct()
    )
    lengths = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(LAST_WORD)))
    cuts = F.transform(lengths, lambda n: F.struct(F.substring("word", F.lit(1), n).alias("word"), (n == F.length("word")).alias("whole")))
    return words.select(F.explode(cuts).alias("x")).groupBy("x.word").agg(F.max("x.whole").alias("whole"))


def authors_dots(out: DataFrame) -> DataFrame:
    """tail, common: last sentences with dots that are their authors'.

    They are if the lower bound of the sentence's share of its source's or
    field's values is high enough. Values cut by other signs are no evidence.
    """
    c = F.col
    size = out.groupBy("field_name", "source").agg(F.count("*").alias("n")).withColumnsRenamed({"field_name": "__f", "source": "__s"})
    size = small_side(materialize(size.withColumn("all", F.sum("n").over(Window.partitionBy("__f"))), "sizes"))
    dotted = out.filter((c("kind") == ELLIPSIS) & ~c("torn") & ~c("blank_cut"))
    per = dotted.groupBy("tail", "field_name", "source").agg(F.count("*").alias("dotted"))
    same = (c("field_name") == c("__f")) & c("source").eqNullSafe(c("__s"))

    def surely(share: float, of: str) -> Column:
        return c("dotted") - 2 * F.sqrt("dotted") >= share * c(of)

    fields = per.join(size, same).groupBy("tail", "field_name")
    fields = fields.agg(F.max(surely(SOURCE_SHARE, "n")).alias("of_source"), F.sum("dotted").alias("dotted"), F.max("all").alias("all"))
    return fields.groupBy("tail").agg(F.max(c("of_source") | surely(FIELD_SHARE, "all")).alias("common")).filter("common")


def whole_lines(out: DataFrame) -> DataFrame:
    """tail, known: last lines of lists, formulas and labels that are the end of more values off the spikes than on them."""
    rows = out.filter((F.col("kind") == DOUBTFUL) & ~F.col("torn") & ~F.col("blank_cut"))
    per = rows.groupBy("tail").agg(F.sum(F.when(F.col("limited"), -1).otherwise(1)).alias("more"))
    return per.filter("more > 0").select("tail", F.lit(True).alias("known"))


def truncated_values(
    df: DataFrame, keys: Sequence[str], fields: Mapping[str, str], order: Sequence[str | Column] = ()
) -> DataFrame:
    """keys, field_name, source, truncated, cause ('limit', 'transfer' or null) for every non-blank value of every field.

    A value at a spike of its source's length histogram (characters, bytes or
    words) is cut by a limit unless it ends as a text does, in a line that is
    whole elsewhere, in dots of its author, or is a brief value of whole words.
    A value of another length is cut in transfer if it ends in a truncation
    mark or an incomplete character or escape, is running text without an end,
    ends in dots that aren't a closing sentence of a fair share of its source's
    or field's values, in white space where whole values next to never do, or
    is a list, formula or label that ends in a fragment of a word of the
    corpus. Null and blank values give no row, an empty table none; repeated
    rows of a key without ``order`` give a row each.
    """
    ends = materialize(field_endings(df, keys, fields, order), "endings")
    last = ends.select(F.col("last_word").alias("word")).filter(F.length("word").between(2, LAST_WORD - 1)).distinct()
    fragments = (
        last.join(word_prefixes(df, list(fields)).hint("merge"), "word")
        .filter(~F.col("whole"))
        .select(F.col("word").alias("last_word"), F.lit(True).alias("fragment"))
    )
    kind, whole = F.col("kind"), F.col("kind") == WHOLE
    tidy = ends.agg((F.count(F.when(whole & F.col("blank_end"), 1)) <= BLANK_SHARE * F.count(F.when(whole, 1))).alias("tidy"))
    out = _left(ends, fragments, "last_word").crossJoin(F.broadcast(tidy))  # one row
    out = out.withColumn("torn", F.coalesce("fragment", F.lit(False)))
    out = out.withColumn("blank_cut", kind.isin(WHOLE, DOUBTFUL) & F.col("blank_end") & F.col("tidy"))
    out = materialize(out.drop("fragment", "tidy", "last_word"), "torn")
    out = _left(out, authors_dots(out), "tail").withColumn("common", F.coalesce("common", F.lit(False)))
    out = materialize(out, "dots")
    at = length_spikes(out).groupBy(F.col("field_name").alias("__f"), F.col("source").alias("__s"))
    at = at.agg(*[F.collect_set(F.when(F.col("unit") == u, F.col("n"))).alias(u) for u in UNITS])
    at = small_side(materialize(at, "spikes"))  # a row per field and source
    same = (F.col("field_name") == F.col("__f")) & F.col("source").eqNullSafe(F.col("__s"))
    limited = F.lit(False)
    for u in UNITS:
        limited = limited | F.array_contains(u, F.col(f"n_{u}"))
    out = out.join(at, same, "left").withColumn("limited", F.coalesce(limited, F.lit(False))).drop(*UNITS, "__s", "__f")
    out = _left(out, whole_lines(out), "tail")
    common, known = F.col("common"), F.coalesce("known", F.lit(False))
    at_limit = F.col("limited") & (kind.isin(MARKED, OPEN) | ((kind == ELLIPSIS) & ~common) | ((kind == DOUBTFUL) & (F.col("torn") | ~known)) | ((kind == BRIEF) & F.col("torn")))
    elsewhere = kind.isin(MARKED, OPEN) | ((kind == ELLIPSIS) & ~common) | F.col("blank_cut") | (kind.isin(DOUBTFUL, BRIEF) & F.col("torn"))
    cause = F.when(at_limit, "limit").when(elsewhere, "transfer")
    return out.select(*keys, "field_name", "source", cause.isNotNull().alias("truncated"), cause.alias("cause"))


def _left(rows: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A left join in which rows with a null key, which are most, don't meet in one partition."""
    there = F.col(on).isNotNull()
    added = [F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c != on]
    joined = rows.filter(there).join(right.hint("merge"), on, "left")
    return joined.unionByName(rows.filter(~there).select("*", *added))


def truncation_rates(values: DataFrame) -> DataFrame:
    """field_name, source, n_values, n_truncated, n_limit, n_transfer, share of :func:`truncated_values`, per source and field."""
    n = F.sum(F.col("truncated").cast("long"))
    causes = [F.count(F.when(F.col("cause") == x, 1)).alias(f"n_{x}") for x in ("limit", "transfer")]
    return values.groupBy("field_name", "source").agg(
        F.count("*").alias("n_values"), n.alias("n_truncated"), *causes, F.round(n / F.count("*"), 6).alias("share")
    )
