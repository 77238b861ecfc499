from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import dedup, metrics, pairs, parsing, prompts, sampling


def ids(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("p"))


def test_pool_split_sizes(spark):
    for n in (0, 1, 9, 10, 19, 20):
        got = {r.pool: r["count"] for r in sampling.pool_split(ids(spark, n), "p").groupBy("pool").count().collect()}
        assert got.get("test", 0) == int(n * 0.10) and got.get("val", 0) == int(n * 0.05) and sum(got.values()) == n


def test_stratified_fills_shortfalls(spark):
    df = spark.createDataFrame([(i, 0 if i < 50 else 1) for i in range(53)], "k int, b int")
    for n in (1, 3, 10, 40, 100):
        got = sampling.stratified(df, "b", 4, n, "k", seed=1).collect()
        assert len(got) == min(n, 53) == len({r.k for r in got})
    assert sum(r.b for r in sampling.stratified(df, "b", 4, 40, "k", seed=1).collect()) == 3


def subs(spark):
    rows = [(lang, f"p{i % 4}", f"{lang}{i}", 5 + i, 20, "Accepted" if i % 3 else "Wrong Answer") for lang in ("a", "b") for i in range(24)]
    return spark.createDataFrame(rows, "lang string, problem_id string, submission_id string, n_lines int, max_chars int, status string")


def test_pairs(spark):
    s = subs(spark)
    pos = pairs.positives(s, "a", "b").collect()
    assert pos and all(r.problem_id1 == r.problem_id2 and r.accepted1 and r.accepted2 for r in pos)
    hard = pairs.hard_negatives(s, "a", "b").collect()
    assert hard and all(r.accepted1 != r.accepted2 for r in hard)
    easy = pairs.easy_negatives(s, "a", "b").collect()
    assert easy and all(r.problem_id1 != r.problem_id2 for r in easy)
    assert len({(r.submission_id1, r.submission_id2) for r in easy}) == len(easy)
    mixed = pairs.pair_records(pairs.mixed_pairs(s, "a", "b", 20, "t")).collect()
    assert len({r.pair_id for r in mixed}) == len(mixed) and {r.label for r in mixed} == {0, 1}
    assert sorted(map(str, mixed)) == sorted(map(str, pairs.pair_records(pairs.mixed_pairs(s, "a", "b", 20, "t")).collect()))


def test_hard_negatives_of_one_side(spark):
    rows = [("a", "p", "a1", 5, 9, "Accepted"), ("b", "p", "b1", 5, 9, "Wrong Answer"), ("a", "q", "a2", 5, 9, "Wrong Answer"), ("b", "q", "b2", 5, 9, "Accepted"), ("a", "r", "a3", 5, 9, "Accepted"), ("b", "r", "b3", 5, 9, "Accepted")]
    s = spark.createDataFrame(rows, subs(spark).schema)
    assert {(r.submission_id1, r.submission_id2) for r in pairs.hard_negatives(s, "a", "b").collect()} == {("a1", "b1"), ("a2", "b2")}


def test_positional_negatives(spark):
    side = lambda n, name: spark.range(n).select(F.col("id").alias("line_no"), F.col("id").alias(name))
    for n in (1, 2, 7):
        want = [(i, (i + 1) % n if (i + n // 3) % n == i else (i + n // 3) % n) for i in range(n)]
        assert sorted((r.l, r.r) for r in pairs.offset_negatives(side(n, "l"), side(n, "r"), n).collect()) == sorted(want)
    for m, n in ((1, 5), (2, 5), (4, 7), (4, 100)):
        want = [(i, j) for i in range(m) for j in range(m) if i != j][:n]
        assert sorted((r.l, r.r) for r in pairs.ordered_negatives(side(m, "l"), side(m, "r"), m, n).collect()) == want


def test_ranks_are_the_global_order(spark):
    df = spark.range(500)
    got = pairs.ranks(df, sampling.seeded("x", "id"), "id").orderBy("rank").collect()
    want = df.orderBy(sampling.seeded("x", "id"), "id").collect()
    assert [r.id for r in got] == [r.id for r in want] and [r["rank"] for r in got] == list(range(500))


def test_exclusions(spark):
    s = subs(spark)
    found = pairs.positives(s, "a", "b").withColumn("pair_id", F.concat("submission_id1", "submission_id2"))
    train = s.where("submission_id in ('a1', 'b2')").select("submission_id")
    left = pairs.drop_either_side(found, train).collect()
    assert not {x for r in left for x in (r.submission_id1, r.submission_id2)} & {"a1", "b2"}


def test_contamination(spark):
    words = "the quick brown fox jumps over the lazy dog and runs far away into the deep woods"
    left = spark.createDataFrame([(1, words), (2, "x" * 60), (3, ""), (4, words + "!")], "t long, s string")
    right = spark.createDataFrame([(10, words), (11, "nothing like it at all, truly different text"), (12, "abc")], "r long, s string")
    sides = [dedup.banded(dedup.minhash(df, k, "s"), k) for df, k in ((left, "t"), (right, "r"))]
    exact = dedup.verified(dedup.candidates(*sides, "t", "r"), left, right, "t", "r", "s")
    got = {(r.t, r.best) for r in dedup.contaminated(exact, "t", "r").collect()}
    assert got == {(1, 10), (4, 10), (3, 12)}  # two texts without shingles are alike
    edge = spark.createDataFrame([(1, 2, 0.7), (3, 4, 0.7000001)], "t long, r long, similarity double")
    assert [r.t for r in dedup.contaminated(edge, "t", "r").collect()] == [3]


def test_metrics_edges(spark):
    m = lambda rows: metrics.binary_metrics(spark.createDataFrame(rows, "label int, pred int"), "label", "pred").first()
    none = m([(1, None), (0, None)])
    assert (none.n_parseable, none.f1, none.accuracy, none.response_rate) == (0, 0.0, 0.0, 0.0)
    assert m([(1, 0), (0, 0)]).precision == 0.0
    assert m([(0, 1), (0, 0)]).recall == 0.0
    some = m([(1, 1), (1, None), (0, 0), (0, 1)])
    assert (some.precision, some.recall, some.recall_all) == (0.5, 1.0, 0.5)


def test_chat_records(spark):
    rows = spark.createDataFrame([("p", 1, None, "C++", "int x;", "Java", "int y;", "1.png", "2.png")], "pair_id string, label int, neg_type string, lang1 string, code1 string, lang2 string, code2 string, image1 string, image2 string")
    got = {r["mode"]: r for r in prompts.chat_records(rows).collect()}
    assert set(got) == set(prompts.MODES) and got["b1"].image_paths is None and got["b1ctrl"].image_paths == ["__black__"] * 2
    assert got["b1"].messages[1].content_parts is None and len(got["b3"].messages[1].content_parts) == 5
    assert got["b2"].messages[2].content_text == "Yes"


def test_parsing(spark):
    assert parsing.layout_python("if x : NEW_LINE INDENT y = 1 NEW_LINE DEDENT z") == "if x :\n    y = 1\nz"
    assert parsing.layout_braces("int f ( ) { x ; } y ;") == "int f ( ) {\n    x ;\n}\ny ;"
    assert parsing.layout_python("") == parsing.layout_braces("  ") == ""
    docs = spark.createDataFrame([(1, "def a():\n  pass\n\n\ndef b():\n  pass"), (2, "def ("), (3, None)], "k int, code string")
    assert [(r.k, r.name, r.start, r.end) for r in parsing.python_functions(docs, "k", "code").collect()] == [(1, "a", 1, 2), (1, "b", 5, 6)]


def test_layouts_of_tokens(spark):
    """Marks count as whole tokens only; braces and semicolons end lines."""
    rows = [
        (1, "if x : NEW_LINE INDENT y = A_NEW_LINE_B NEW_LINE NEW_LINE DEDENT DEDENT z", True, "if x :\n    y = A_NEW_LINE_B\nz"),
        (2, "def f : NEW_LINE INDENT return xNEW_LINE", True, "def f :\n    return xNEW_LINE"),
        (3, "int f ( ) { x ; if ( y ) { z ; } } } w", False, "int f ( ) {\n    x ;\n    if ( y ) {\n        z ;\n    }\n}\n}\nw"),
        (4, "", True, ""),
        (5, None, False, ""),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "k int, tokens string, python boolean")
    assert {r.k: r.code for r in parsing.laid_out(df, "k", "tokens", F.col("python")).collect()} == {r[0]: r[3] for r in rows}


def test_ranks_by_parts(spark):
    import hashlib
    import random

    r = random.Random(1)
    keys = [r.randrange(-(1 << 62), 1 << 62) for _ in range(300)] + list(range(50))
    df = spark.createDataFrame([(k, "a" if i % 3 else "b") for i, k in enumerate(keys)], "k long, g string")
    assert {x.k: x.rank for x in sampling.ranks_by_id(df, "k").collect()} == {k: i for i, k in enumerate(sorted(keys))}
    group = {k: "a" if i % 3 else "b" for i, k in enumerate(keys)}
    for got, order in ((sampling.ranks_by_id(df, "k", ["g"]), lambda k: k), (sampling.ranks(df, sampling.seeded(7, "k"), "k", group=["g"]), lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())):
        want = {k: i for g in "ab" for i, k in enumerate(sorted((k for k in keys if group[k] == g), key=order))}
        assert {x.k: x["rank"] for x in got.collect()} == want
    assert sampling.ranks_by_id(df.where("false"), "k").count() == 0


def test_slots_and_replacements(spark):
    clones = spark.createDataFrame([(i * 7,) for i in range(40)], "item_id long")
    targets = spark.range(100).select(F.col("id").alias("slot"))
    got = {r.item_id: r.slot for r in pairs.assign_slots(clones, targets, F.lit(1) + F.col("item_id") % 2, "item_id").collect()}
    want, at = {}, 0
    for i in range(40):
        want[i * 7] = at
        at += 1 + i * 7 % 2
    assert got == {k: v for k, v in want.items() if v < 100}
    failed, spare = (spark.createDataFrame([(x,) for x in some], "id long") for some in ([9, 3, 5], [2, 8]))
    assert {(r.failed, r.spare, r.k) for r in pairs.zip_replacement(failed, spare, "id").collect()} == {(3, 2, 1), (5, 8, 2)}


def test_brace_functions():
    code = """namespace N { class A {
  /* void no() { */
  private int f(
      int a) {
    for (;;) { g(a); }
    while (x) { }
  }
  int h() { return "}".length(); }
  abstract int none();
}}
static void main2(char **v) { struct s { int y; } z; }
"""
    assert parsing.braced(code) == [("f", 3, 7), ("h", 8, 8), ("main2", 11, 11)]
    assert parsing.braced("") == parsing.braced("}}}{{{") == [] and parsing.braced("int f() {" * 20_000) == []
