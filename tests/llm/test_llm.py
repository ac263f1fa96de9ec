import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbolith.llm import encoding, endings, leaks, packing, pairs, queries, subjects, topn, truncation
from tests.compare import SMALL, assert_same, connect

has_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
has_ranks = pytest.mark.skipif(not os.path.exists(encoding.tokenizer_path()), reason="no vocabulary files")


@has_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert_same(queries.queries()[name](spark, SMALL), connect(), queries.oracle_sql()[name])


@has_tables
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_keys_are_unique(spark, name):
    rows = queries.queries()[name](spark, SMALL)
    keys = [c for c in ("task_id", "node_id", "field_name", "row_id", "part", "doc_id", "item_id", "subject", "source") if c in rows.columns]
    assert rows.count() == rows.select(*keys).distinct().count()


# ---- texts cut off


WHOLE = "It is done. And this ends too."
CASES = [
    (WHOLE, endings.WHOLE),
    ("Is it so?", endings.WHOLE),
    ('He said "yes."', endings.WHOLE),
    ("Shown before. [12]", endings.WHOLE),
    ("Shown before. (Units: kg)", endings.WHOLE),
    ("All good.\nAnswer: D", endings.WHOLE),
    ("So \\boxed{\\text{B}}", endings.WHOLE),
    ("x\n```\na = 1\n```", endings.WHOLE),
    ("由此可见。", endings.WHOLE),
    ("Measured. So option B h", endings.OPEN),
    ("由于湿度在78.", endings.OPEN),
    ("因此必须先检", endings.OPEN),
    ("It is done. And this en", endings.OPEN),
    ("It is done. And then the", endings.OPEN),
    ("This is one long running text that goes on (see item 4)", endings.OPEN),
    ("x\n```\na = 1", endings.OPEN),
    ("It is done. And th<cut>", endings.MARKED),
    ("It is done. And th [truncated]", endings.MARKED),
    ("It is done. And th (+39 chars)", endings.MARKED),
    ("It is done. And th��", endings.MARKED),
    ("It is done. And th\\u00", endings.MARKED),
    ("It is done. And th-", endings.MARKED),
    ("It is done. And th…", endings.ELLIPSIS),
    ("Step by step...", endings.ELLIPSIS),
    ("Parts:\n- first\n- second", endings.DOUBTFUL),
    ("Found it. So x = 14.2 nm", endings.DOUBTFUL),
    ("about 4 kg", endings.BRIEF),
    ("C", endings.BRIEF),
    (" \n ", endings.BLANK),
    ("", endings.BLANK),
    (None, endings.BLANK),
]


def test_endings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: r.k for r in endings.with_ending(df, "text", "end").select("i", F.col("end.kind").alias("k")).collect()}
    assert {CASES[i][0]: k for i, k in got.items()} == dict(CASES)


def test_limits_dots_and_fragments(spark):
    rng = np.random.default_rng(0)
    words = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma".split()
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(" ".join(rng.choice(words, rng.integers(4, 9))).capitalize() + "." for _ in range(rng.integers(2, 9)))
        source = "m1" if i % 2 else None
        if source and len(text) > 150 and text[149] not in ". ":
            text = text[:150]
            cut.add(str(i))
        elif i % 50 == 0:
            text += " And so on as before..."
        rows.append((str(i), 1, source, text, "clash"))
    rows += [("list", 1, None, "Parts: two.\n- alpha beta\n- gam", "x"), ("whole", 1, None, "Parts: two.\n- alpha beta\n- gamma", "x")]
    rows += [("dots", 1, None, "Alpha beta gam...", "x"), ("old", 1, None, "Alpha bet", "x"), ("old", 2, None, "Alpha beta.", "x"), (None, 1, None, None, None), ("long", 1, None, "Alpha beta." + " Alpha beta." * 20_000, "x")]
    rows += [(f"author{i}", 1, None, f"Alpha {i}. And so on as before...", "x") for i in range(20)]
    rows += [("blank", 1, None, "Alpha beta. Gamma delta. ", "x")]
    cut |= {"list", "dots", "blank"}
    df = spark.createDataFrame(rows, "k string, v int, m string, text string, kind string").repartition(4)
    got = truncation.truncated_values(df, ["k"], {"text": "m"}, ["v"])
    assert {r.k for r in got.filter("truncated").collect()} == cut
    causes = {r.k: r.cause for r in got.filter("truncated").collect()}
    assert {k for k, c in causes.items() if c == "limit"} == cut - {"list", "dots", "blank"}
    rates = truncation.truncation_rates(got).collect()
    assert {r.source: r.n_limit for r in rates} == {"m1": len(cut) - 3, None: 0}
    assert {r.source: r.n_truncated for r in rates} == {"m1": len(cut) - 3, None: 3}
    assert truncation.truncated_values(df.limit(0), ["k"], {"text": "m"}, ["v"]).count() == 0


def test_recurring_fragments_stay_cut_in_a_large_table(spark):
    n = F.col("id")
    plain = F.concat(F.lit("Alpha beta gamma. Delta "), F.repeat(F.lit("epsilon "), (n % 97).cast("int")), F.lit("zeta."))
    rows = spark.range(30_000).select(n.cast("string").alias("k"), F.when(n < 25, "Alpha beta. It...").when(n.between(100, 399), "Alpha beta. The rest is alike...").otherwise(plain).alias("text"))
    got = truncation.truncated_values(rows.withColumn("m", F.lit("x")), ["k"], {"text": "m"}).filter("truncated")
    assert {r.k for r in got.collect()} == {str(i) for i in range(25)}


def test_limits_in_words(spark):
    n = F.col("id")
    said = F.concat(F.repeat(F.lit("alpha beta. "), (n % 40).cast("int")), F.lit("gamma."))
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(42)), lambda i: F.repeat(F.lit("ab"), (1 + (i * (n + 3)) % 5).cast("int"))))
    rows = spark.range(4000).select(n.cast("string").alias("k"), F.lit("m").alias("m"), F.when(n % 10 == 0, long).otherwise(said).alias("text"))
    got = truncation.truncated_values(rows, ["k"], {"text": "m"})
    assert {(r.truncated, r.cause, int(r.k) % 10 == 0) for r in got.collect()} == {(True, "limit", True), (False, None, False)}


def test_very_long_words_and_lines(spark):
    rows = [("a", "x" * 100_000), ("b", "- " + "alpha " * 2000 + "beta"), ("c", "alpha beta. " * 3 + "alp" * 60)]
    df = spark.createDataFrame([(k, "m", t) for k, t in rows], "k string, m string, text string")
    assert truncation.truncated_values(df, ["k"], {"text": "m"}).count() == 3


def test_lines_on_a_limit_are_whole_only_if_most_end_so_elsewhere(spark):
    rows = [(f"open{i}", "alpha beta gamma delta epsilon zeta theta kappa lambda"[:40] + "eta iota alpha beta gam"[:20]) for i in range(30)]
    line = lambda head, n: head * ((n - len("\n- alpha")) // len(head) + 1)
    at = lambda n, tail: line("Gamma delta. ", n)[: n - len(tail)] + tail
    rows += [(f"cut{i}", at(60, "\n- alpha")) for i in range(6)] + [(f"off{i}", at(90 + i, "\n- alpha")) for i in range(2)]
    rows += [("whole", at(60, "\n- beta"))] + [(f"same{i}", at(120 + i, "\n- beta")) for i in range(3)]
    df = spark.createDataFrame([(k, "x", t) for k, t in rows], "k string, m string, text string")
    got = truncation.truncated_values(df, ["k"], {"text": "m"}).filter("truncated")
    assert {r.k for r in got.collect()} == {f"open{i}" for i in range(30)} | {f"cut{i}" for i in range(6)}


@pytest.mark.parametrize("pad", [" " * 200, "\n" * 200, "\u200b" * 200])
@pytest.mark.parametrize(("answer", "error"), [("N/A", None), ("\\boxed{}", None), ("HTTP 504: timed out.", "HTTP 504: timed out.")])
def test_padded_placeholders_are_empty(pad, answer, error):
    assert pairs.is_empty(pad + answer + pad, error)
    assert not pairs.is_empty(pad + "The mass is four kilograms." + pad, error)
    assert pairs.is_empty("- " * 200 + "N/A" + " -" * 200, None)


# ---- top N


@pytest.mark.parametrize("n", [1, 3])
def test_top_n_against_brute_force(spark, n):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        g = "hot" if i % 2 else f"g{rng.integers(300)}"
        ok = [True, False, None][rng.integers(3)]
        cost = [None, float("nan"), float(rng.integers(20))][min(2, rng.integers(8))]
        rows.append((None if i % 97 == 0 else g, f"n{i % 2900:05d}", ok, cost, 0, 0))
    df = spark.createDataFrame(rows, "g string, id string, ok boolean, cost double, rank int, `__band` int")
    first = F.when(F.col("ok"), 0).when(~F.col("ok"), 1)
    got = topn.top_n(df, ["g"], n, first, F.col("cost"), ["id"]).collect()
    want = {}
    for g, i, ok, cost, *_ in rows:
        missing = cost is None or cost != cost
        want.setdefault(g, []).append(({True: 0, False: 1, None: 9}[ok], missing, 0 if missing else cost, i))
    assert sorted((str(r.g), r.rank, r.id) for r in got) == sorted((str(g), k + 1, x[3]) for g, xs in want.items() for k, x in enumerate(sorted(xs)[:n]))
    assert topn.top_n(df.limit(0), ["g"], n, first, F.col("cost"), ["id"]).count() == 0


# ---- pairs


@pytest.mark.parametrize(
    ("prompt", "answer", "error", "defect"),
    [
        ("What is the mass of the box?", "The mass is four kilograms, as weighed. So it is light.", None, None),
        ("What is the mass of the box?", "C", "timed out", None),
        ("What is the mass of the box?", "about 4 kg", None, None),
        ("What is the mass of the box?", None, None, "empty"),
        ("What is the mass of the box?", "​ ", None, "empty"),
        ("What is the mass of the box?", "N/A", None, "empty"),
        ("What is the mass of the box?", "My final answer is \\boxed{}.", None, "empty"),
        ("What is the mass of the box?", "HTTP 504: timed out.", "HTTP 504: timed out.", "empty"),
        ("What is the mass of the box?", "The mass of the bo", None, "truncated"),
        ("What is the mass of the box?", "I'm sorry, but I can't help with this one. Please consult an expert.", None, "refusal"),
        ("What is the mass of the box?", "Je ne peux pas répondre à cette question.", None, "refusal"),
        ("What is the mass of the box?", "I'm sorry for the delay. The mass is four kilograms.", None, None),
        ("What is the mass of the box?", "I can't see the figure, but it isn't needed. The mass is four kilograms.", None, None),
        ("What is the mass of the box?", "WHAT IS THE MASS OF THE BOX?", None, "copy"),
        ("What is the mass of the box?", 'You asked: "What is the mass of the box?"', None, "copy"),
        ("What is the mass of the box?", "The question asks: What is the mass of the box? It weighs four kilograms, by the scale there.", None, None),
        ("What is the mass of the box?", "Die Masse ist nicht von der Farbe abhängig und muss gemessen werden.", None, "language"),
        (None, "The mass is four kilograms.", None, None),
    ],
)
def test_pair_looks(prompt, answer, error, defect):
    seen = pairs.look(prompt, answer, error)
    found = "empty" if seen.empty else "copy" if seen.copy else "language" if seen.foreign else None
    if defect == "refusal":  # what declines shows over all answers, but it names nothing itself
        assert not seen.choice and found in (None, "language")
    else:
        assert found == (None if defect == "truncated" else defect)


def test_what_an_answer_says_in_clauses():
    seen = pairs.look("What is the mass of box 7?", "The mass, as weighed, is that of box 7. Nothing else.", None)
    assert seen.said == "_the _mass\nas weighed\n_is that _of _box _7\nnothing else" and not seen.choice
    assert pairs.look("What is it?", "It weighs 4 kg.", None).choice
    assert pairs.look("什么是质量", "остаётся только вариант C.", None).choice
    assert pairs.look("q", "无法 回答", None).said == "无 法 回 答"
    topical = np.zeros(pairs.SLOTS, dtype=bool)
    topical[pairs.slot("mass")] = True
    assert pairs.template("no mass _box is off # limits", topical) == "no _ is off # limits"


def test_slots_are_those_of_spark(spark):
    words = ["mass", "größe", "质", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").bitwiseAND(F.lit(pairs.SLOTS - 1))).collect()
    assert [r[0] for r in got] == [pairs.slot(w) for w in words]


def _answers():
    """(prompt, answer, declines): answers of few kinds with options, some without, and two templates that decline."""
    rng = np.random.default_rng(3)
    nouns = [f"thing{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for i in range(400):
        a, b = rng.choice(nouns, 2, replace=False)
        tail = f" The answer is {'ABCD'[i % 4]}." if i % 5 else ""
        rows.append((f"What does the {a} do to the {b} in case {i}?", f"I'm sorry for the delay. The {a} drives the {b}.{tail}", False))
    for i in range(12):
        a, b = rng.choice(nouns, 2, replace=False)
        rows.append((f"What does the {a} do to the {b} in trial {i}?", f"Alas, the {b} lies beyond my remit. Kindly try elsewhere.", True))
        rows.append((f"What does the {a} do to the {b} in round {i}?", "Hier hilft leider gar nichts weiter.", True))
    return rows


def test_refusals_are_found_without_a_list_of_phrases(spark):
    rows = [(str(i), *r) for i, r in enumerate(_answers())]
    df = spark.createDataFrame(rows, "k string, q string, a string, declines boolean").withColumn("e", F.lit(None).cast("string")).withColumn("s", F.lit("m"))
    got = {r.k for r in pairs.pair_defects(df, ["k"], "q", "a", "e", "s").filter("defect = 'refusal'").collect()}
    assert got == {r[0] for r in rows if r[3]}


def test_pair_defects(spark):
    good = [(f"k{i}", f"What holds for part number {i} here?", f"Part {i} is held by the frame and the bolt, so the answer is {'ABCD'[i % 4]}.", None, "m") for i in range(60)]
    bad = [
        ("empty", "What holds for it here?", " ", None, "m"),
        ("cut", "What holds for it here?", "The frame and the bolt hold what the", None, "m"),
        ("copy", "What holds for it here?", "> What holds for it here?", None, "m"),
        ("language", "What holds for it here?", "Der Rahmen und die Schraube halten das Teil nicht fest.", None, "m"),
    ]
    bad += [(f"refusal{i}", f"What holds for part {i}?", "With regret, I am not able to give an answer here.", None, None) for i in range(5)]
    long = "I am not able to give an answer to this one as it was put to me by you {} today"
    bad += [(f"refusal_long{i}", f"Which of the {i} is it?", long.format("here"), None, None) for i in range(4)]
    df = spark.createDataFrame(good + bad, "k string, q string, a string, e string, s string").withColumn("opening", F.lit("clash"))
    got = {r.k: r.defect for r in pairs.pair_defects(df, ["k"], "q", "a", "e", "s").collect()}
    want = {k: k.rstrip("0123456789").split("_")[0] for k, *_ in bad} | {"cut": "truncated"}
    for i in range(4):
        want[f"refusal_long{i}"] = "truncated"  # it has no full stop
    assert got == want
    assert pairs.pair_defects(df.limit(0), ["k"], "q", "a", "e", "s").count() == 0


def test_repeated_pairs_give_a_row_each(spark):
    df = spark.createDataFrame([("k", "What is it?", "", None, None)] * 3, "k string, q string, a string, e string, s string")
    assert [r.defect for r in pairs.pair_defects(df, ["k"], "q", "a", "e", "s").collect()] == ["empty"] * 3


def test_cluster_recall_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    frames = []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10_000, 32)]
        frames.append(" ".join(base))
        for k in range(5):  # two of them may be similar without being so to the most frequent one
            frames.append(" ".join([*base[:-1], f"x{k}"]) if k % 2 else " ".join([f"y{k}", *base[1:]]))
    frames += ["no comment on it", "no comment"]
    rows = [(f, int(n), 0, 2, True) for f, n in zip(frames, rng.integers(1, 50, len(frames)))]
    counted = spark.createDataFrame(rows, "frame string, n long, choices long, prompts long, candidate boolean")
    found = {(r.leader, r.frame) for r in pairs.template_clusters(counted).collect()}
    similar = {(a, b) for a in frames for b in frames if a != b and pairs.similarity(a, b) >= pairs.SIMILAR}
    assert {(a, b) for a, b in found if a != b} <= similar
    assert {(f, f) for f in frames} <= found
    # linked, or linked to one and the same
    joined = {p for p in similar if p in found or any((p[0], x) in found and (x, p[1]) in found for x in frames)}
    assert len(joined) >= 0.9 * len(similar)


def test_minhash_meets_similar_openings():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(200):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 30)]
        met += bool(set(pairs.bands(" ".join(words))) & set(pairs.bands(" ".join([*words[:-1], "other"]))))
    assert met >= 190


# ---- packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=120))
def test_pack_fills_and_fits(sizes):
    lengths = np.array(sizes, dtype=np.int64)
    where = packing.pack(lengths, 50)
    totals = np.bincount(where, lengths, minlength=1) if len(lengths) else np.zeros(1)
    assert totals.max() <= 50
    least = -(-int(lengths.sum()) // 50)
    used = len(set(where[lengths > 0].tolist()))
    assert used <= max(1, 11 / 9 * max(least, int((lengths > 25).sum())) + 1)


def test_evened_keeps_lengths_and_lowers_the_spread():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.exponential(250, 3000), 1000).astype(np.int64)
    fit = packing._best_fit(np.sort(lengths)[::-1], 1000, [], 0)
    lengths = np.sort(lengths)[::-1].copy()
    got = packing.evened(lengths, fit)

    def spread(w):
        c = np.bincount(w, packing.cost(lengths.astype(float)))
        return c.std()

    assert (np.bincount(got, lengths) == np.bincount(fit, lengths)).all()
    assert spread(got) < 0.95 * spread(fit)
    assert len(packing.evened(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))) == 0


def test_containers_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    monkeypatch.setattr(packing, "COPIES", 7)
    rows = [(str(i % 300), (i * 37) % 90, "x") for i in range(700)] + [("hot", 5, "x")] * 300 + [(None, None, "x")] * 20 + [("long", 1234, "x")]
    df = spark.createDataFrame(rows, "k string, len long, container string")
    one, other = (sorted(map(str, packing.containers(d, "k", F.col("len"), 100).collect())) for d in (df.repartition(3), df.repartition(11, "len").sortWithinPartitions("k")))
    assert one == other and len(one) == len(rows) + 12


def test_containers(spark):
    rows = [(i, n, "x") for i, n in enumerate([0, None, 5, 100, 101, 250, 99, 1, 60, 40, 60, 40])] + [(3, 100, "x")]
    df = spark.createDataFrame(rows, "id long, n int, container string")
    got = packing.containers(df, "id", F.col("n"), 100).collect()
    per = {}
    for r in got:
        per[r.container] = per.get(r.container, 0) + r.length
    assert max(per.values()) <= 100
    assert len([c for c, n in per.items() if n]) == 9  # 856 units
    parts = {}
    for r in got:
        parts.setdefault(r.id, []).append((r.start, r.length))
    assert sorted(parts[5]) == [(0, 100), (100, 100), (200, 50)] and sorted(parts[4]) == [(0, 100), (100, 1)]
    assert len(parts[3]) == 2 and set(parts) == set(range(12))
    assert packing.containers(df.limit(0), "id", F.col("n"), 100).count() == 0
    with pytest.raises(ValueError):
        packing.containers(df, "id", F.col("n"), 0)


# ---- encoding

TEXTS = ["", None, "Hello world", "<|endoftext|> is text", "x" * 5000, " \n\t  ", "naïve café 你好 🙂‍🙂", "a1b2" * 20_000, "word " * 30_000, "\x1c\x85  x", "it's we'll\r\n'S"]


@has_ranks
def test_encoding_round_trip_and_pieces(spark):
    enc = encoding.encoding(encoding.tokenizer_path())
    for t in TEXTS:
        ids = encoding.encode(enc, t)
        assert encoding.decode(enc, ids.tolist()) == (t or "").encode()
        assert ids.tolist() == (enc.encode_ordinary(t) if t else [])
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "id int, text string, ids string")
    got = {r.id: r.ids for r in encoding.encoded(df, "id", "text").collect()}
    assert got == {i: encoding.encode(enc, t).tolist() for i, t in enumerate(TEXTS)}
    assert encoding.encoded(df.limit(0), "id", "text").count() == 0


@has_ranks
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=200))
def test_cuts_change_no_ids(text):
    enc = encoding.encoding(encoding.tokenizer_path())
    joined = [i for p in encoding.pieces(text, 5) for i in enc.encode_ordinary(p)]
    assert joined == enc.encode_ordinary(text)


@has_ranks
@has_tables
def test_same_ids_as_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(encoding.tokenizer_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.p6_ids(spark, SMALL).collect():
        assert list(r.ids) == other.encode(docs[r.doc_id] or "", add_special_tokens=False).ids


# ---- leaks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton_against_brute_force(items, text):
    a = leaks.Automaton([(str(i), s) for i, s in enumerate(items)], words=3)
    grams = {tuple(text[i : i + 3]) for i in range(len(text) - 2)}
    want = {str(i) for i, s in enumerate(items) if any(tuple(s[j : j + 3]) in grams for j in range(len(s) - 2))}
    assert set(a.found(text)) == want
    for at, n, _ in a.matches(text):
        longest = max(k for k in range(at + 2) if any(text[at - k + 1 : at + 1] == s[j : j + k] for s in items for j in range(len(s) - k + 1)))
        assert n == longest


def test_leaks_and_clean_texts(spark):
    q = " ".join(f"Word{i}" for i in range(20))
    docs = [(1, f"before {q.upper()} after"), (2, "x " + " -- ".join(q.split()[3:15]) + " y"), (3, " ".join(q.split()[:11])), (4, None), (5, ""), (1, f"before {q} after"), (6, "é" + q + "_" + q)]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([("a", q), ("b", "too short"), ("c", None), ("a", q)], "id string, question string")
    got = leaks.leaks(df, "doc_id", "text", items, "id", "question").collect()
    assert sorted((r.doc_id, r.item_id, r.n_words) for r in got) == [(1, "a", 20), (1, "a", 20), (2, "a", 12), (6, "a", 20)]
    clean = {r.doc_id: r.text for r in leaks.cleaned(df, "doc_id", "text", items, "id", "question").collect()}
    assert clean[1] == "before  after" and clean[2] == "x  y"
    assert leaks.leaks(df, "doc_id", "text", items.limit(0), "id", "question").count() == 0
    assert leaks.leaks(df.limit(0), "doc_id", "text", items, "id", "question").count() == 0


def test_short_items_copied_whole(spark):
    q = " ".join(f"w{i}" for i in range(14))
    df = spark.createDataFrame([(1, f"So who was first? {q}"), (2, "who was second"), (3, "")], "d int, text string")
    items = spark.createDataFrame([("a", q), ("b", "Who was first?"), ("c", "who"), ("d", " ")], "id string, q string")
    assert {(r.d, r.item_id) for r in leaks.leaks(df, "d", "text", items, "id", "q").collect()} == {(1, "a")}
    got = leaks.leaks(df, "d", "text", items, "id", "q", short=True).collect()
    assert {(r.d, r.item_id, r.n_words, r.coverage) for r in got} == {(1, "a", 14, 1.0), (1, "b", 3, 1.0), (1, "c", 1, 1.0), (2, "c", 1, 1.0)}


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 15)
    texts = [" ".join(f"q{k}w{i}" for i in range(13)) for k in range(4)]
    items = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, q string")
    df = spark.createDataFrame([(9, " ".join(texts))], "d int, text string")
    assert sorted(r.item_id for r in leaks.leaks(df, "d", "text", items, "id", "q").collect()) == ["0", "1", "2", "3"]
    assert leaks.cleaned(df, "d", "text", items, "id", "q").collect()[0].text.strip() == ""


# ---- subjects


def _corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = {"sky": "star galaxy orbit comet nebula quasar".split(), "food": "oven broth garlic pastry yeast saucepan".split()}
    code = "cache queue parser token buffer index".split()
    rows = []
    for i in range(n):
        labels = [s for s in words if rng.random() < 0.35]
        lines = [" ".join(rng.choice(code, 6)) for _ in range(6)]
        for s in labels:
            lines += ["def " + "_".join(rng.choice(words[s], 2)) + "(): # " + " ".join(rng.choice(words[s], 3)) for _ in range(5)]
        other = [s for s in words if s not in labels]
        if other and rng.random() < 0.3:
            lines += [f"# the {words[other[0]][0]} example"] * 3  # one borrowed word
        rng.shuffle(lines)
        rows.append(("\n".join(lines), "s", "python", labels))
    return rows


def test_subjects_on_held_out_documents(spark):
    model = subjects.fit(_corpus(300, 1), ["sky", "food", "never"])
    test = _corpus(300, 2)
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(test)] + [(900, None, None, None), (901, " ", "s", "x")], "doc_id int, text string, source string, lang string").withColumn("subject", F.lit("clash"))
    got = {(r.doc_id, r.subject) for r in subjects.classify(df, model).collect()}
    want = {(i, s) for i, r in enumerate(test) for s in r[3]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert subjects.classify(df.limit(0), model).count() == 0


def test_no_labels_no_subjects(spark):
    model = subjects.fit([], ["sky"])
    df = spark.createDataFrame([(1, "star star", "s", "x")], "doc_id int, text string, source string, lang string")
    assert subjects.classify(df, model).count() == 0


def test_label_spellings_and_bound(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "s", None) for i in range(5)], "doc_id int, text string, source string, lang string")
    rows = [(0, " SKY "), (0, "sky"), (1, None), (2, "Food"), (2, "sky"), (3, "unknown"), (77, "sky")]
    labels = spark.createDataFrame(rows, "doc_id int, subject string")
    got = {r[0]: r[3] for r in subjects.labelled_sample(docs, labels, ["sky", "food"])}
    assert got == {"t0": ["sky"], "t1": [], "t2": ["food", "sky"], "t3": []}
    assert len(subjects.labelled_sample(docs, labels, ["sky", "food"], limit=2)) <= 2
    assert len(subjects.labelled_sample(docs, labels, ["sky", "food"], chars=5)) == 2
    assert len(subjects.labelled_sample(docs, labels, ["sky", "food"], chars=1)) == 0
