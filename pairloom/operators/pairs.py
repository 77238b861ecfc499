"""Labelled pairs of submissions: positives, hard and easy negatives, and pairings by position.

Submissions are rows (lang, problem_id, submission_id, n_lines, max_chars, status). No join here is a cross
join: negatives meet by seeded rank, so each left row gets a bounded number of partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators.sampling import numbered, ranks, ranks_by_id, sample_per_group, seeded, stratified, with_parts

ACCEPTED, WRONG = "Accepted", "Wrong Answer"
SIDE = ("lang", "problem_id", "submission_id", "n_lines", "max_chars")


def side(subs: DataFrame, n: int) -> DataFrame:
    """The columns of one side of a pair, marked 1 or 2."""
    return subs.select(*[F.col(c).alias(f"{c}{n}") for c in SIDE], (F.col("status") == ACCEPTED).alias(f"accepted{n}"))


def pick(subs: DataFrame, lang: str, status: str, per_problem: int | None, seed: object) -> DataFrame:
    """Up to per_problem random submissions of a language and status for each problem."""
    found = subs.where((F.col("lang") == lang) & (F.col("status") == status))
    return sample_per_group(found, ["problem_id"], "submission_id", per_problem, f"{seed}:{lang}:{status}") if per_problem else found


def same_problem(left: DataFrame, right: DataFrame, neg_type: str | None) -> DataFrame:
    """Every pair of both sides within a problem; sides are sampled before, so a problem gives a bounded number."""
    a, b = side(left, 1), side(right, 2)
    return a.join(b, a["problem_id1"] == b["problem_id2"]).withColumn("neg_type", F.lit(neg_type).cast("string")).withColumn("longest", F.greatest("n_lines1", "n_lines2"))


def positives(subs: DataFrame, l1: str, l2: str, per_side: int = 3, seed: object = 42) -> DataFrame:
    return same_problem(pick(subs, l1, ACCEPTED, per_side, seed), pick(subs, l2, ACCEPTED, per_side, seed), None)


def hard_negatives(subs: DataFrame, l1: str, l2: str, per_side: int = 3, seed: object = 42) -> DataFrame:
    """One side accepted and one wrong, on the same problem."""
    one = same_problem(pick(subs, l1, ACCEPTED, per_side, seed), pick(subs, l2, WRONG, per_side, seed), "hard")
    two = same_problem(pick(subs, l1, WRONG, per_side, seed), pick(subs, l2, ACCEPTED, per_side, seed), "hard")
    return one.unionByName(two)


def both_accepted(subs: DataFrame, l1: str, l2: str) -> DataFrame:
    """Problems with accepted submissions in both languages."""
    got = subs.where((F.col("status") == ACCEPTED) & F.col("lang").isin(l1, l2)).groupBy("problem_id").agg(F.countDistinct("lang").alias("n"))
    return got.where("n = 2").select("problem_id")


def easy_negatives(subs: DataFrame, l1: str, l2: str, per_left: int = 3, seed: object = 42) -> DataFrame:
    """Accepted submissions of different problems: each left row meets per_left right rows by rank, never all.

    Right rows are ranked by seeded order; a left row's i-th partner is the right row at
    (hash(left, i) mod right rows), an equi-join. Partners of the same problem and repeated pairs are left out.
    """
    problems = both_accepted(subs, l1, l2)
    left = pick(subs, l1, ACCEPTED, None, seed).join(problems, "problem_id", "left_semi")
    right = pick(subs, l2, ACCEPTED, None, seed).join(problems, "problem_id", "left_semi")
    ranked = ranks(side(right, 2), seeded(seed, "submission_id2"), "submission_id2")
    n = F.broadcast(right.agg(F.count("*").alias("many")))  # one row
    slot = F.conv(F.substring(seeded(seed, "submission_id1", F.lit("draw"), "draw"), 1, 8), 16, 10).cast("long") % F.col("many")
    drawn = side(left, 1).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_left - 1)))).join(n).where("many > 0").withColumn("rank", slot).drop("many")
    met = drawn.join(ranked, "rank").where("problem_id1 <> problem_id2")
    return met.drop("rank", "draw").distinct().withColumn("neg_type", F.lit("easy")).withColumn("longest", F.greatest("n_lines1", "n_lines2"))


def mixed_pairs(subs: DataFrame, l1: str, l2: str, n: int, tag: str, seed: object = 42, per_side: int = 3) -> DataFrame:
    """n pairs, half positive, a quarter hard and a quarter easy, each stratified by the longer side's lines."""
    n_pos, n_hard = n // 2, n // 4
    out = None
    for kind, label, found, most in (("pos", 1, positives(subs, l1, l2, per_side, seed), n_pos), ("hard", 0, hard_negatives(subs, l1, l2, per_side, seed), n_hard), ("easy", 0, easy_negatives(subs, l1, l2, per_side, seed), n - n_pos - n_hard)):
        key = ["submission_id1", "submission_id2"]
        some = stratified(found.withColumn("bucket", text.bucket(F.col("longest"))), "bucket", len(text.BUCKETS), most, *key, seed=f"{seed}:{kind}")
        some = numbered(some.withColumn("kind", F.lit(kind)).withColumn("label", F.lit(label)), ["kind"], [seeded(f"{seed}:{kind}", *key), *map(F.col, key)])
        out = some if out is None else out.unionByName(some)
    return out.withColumn("pair_id", F.format_string(f"{tag}_%s_%06d", "kind", F.col("number").cast("int"))).drop("number")


def code_struct(n: int, extension: Column | None = None) -> Column:
    """One side of a pair as a struct with its paths."""
    c = lambda name: F.col(f"{name}{n}").cast("string")
    end = extension if extension is not None else F.lit("txt")
    return F.struct(
        c("lang").alias("lang"), c("problem_id").alias("problem_id"), c("submission_id").alias("submission_id"), F.col(f"accepted{n}").alias("is_accepted"),
        F.col(f"n_lines{n}").alias("n_lines"), F.col(f"max_chars{n}").alias("max_chars"),
        F.concat(F.lit("data/"), c("problem_id"), F.lit("/"), c("lang"), F.lit("/"), c("submission_id"), F.lit("."), end).alias("rel_path"),
        F.concat(F.lit("images/"), c("problem_id"), F.lit("/"), c("lang"), F.lit("/"), c("submission_id"), F.lit(".png")).alias("image_rel_path"),
    )


def pair_records(pairs: DataFrame) -> DataFrame:
    """pair_id, label, neg_type, code1, code2."""
    return pairs.select("pair_id", "label", "neg_type", code_struct(1).alias("code1"), code_struct(2).alias("code2"))


def by_position(left: DataFrame, right: DataFrame, position: str = "line_no") -> DataFrame:
    """Rows at the same position; the longer side's rest has no partner."""
    return left.join(right, position)


def offset_negatives(left: DataFrame, right: DataFrame, n: int, position: str = "line_no") -> DataFrame:
    """Row i of the left with row (i + n div 3) mod n of the right, or its next row where that is i itself."""
    at = (F.col(position) + n // 3) % n
    at = F.when(at == F.col(position), (F.col(position) + 1) % n).otherwise(at)
    return left.withColumn("partner", at).join(right.withColumnRenamed(position, "partner"), "partner")


def ordered_negatives(left: DataFrame, right: DataFrame, m: int, n: int, position: str = "line_no") -> DataFrame:
    """The first n pairs (i, j), i <> j, of m rows in the order of i, then j; by formula, not by a loop."""
    spark = left.sparkSession
    k = spark.range(min(n, m * (m - 1)) if m > 1 else 0).withColumnRenamed("id", "k")
    i, j = F.floor(F.col("k") / max(m - 1, 1)).cast("long"), F.col("k") % max(m - 1, 1)
    k = k.select("k", i.alias("i"), (j + (j >= i).cast("long")).alias("j"))
    return k.join(left.withColumnRenamed(position, "i"), "i").join(right.withColumnRenamed(position, "j"), "j")


def cross_problem_negatives(subs: DataFrame, used: DataFrame, seed: object, draws: int = 2) -> DataFrame:
    """One random submission of each of two problems, for unordered problem pairs that are not in used (p, q)."""
    one = sample_per_group(subs, ["problem_id"], "submission_id", 1, seed).select("problem_id", "submission_id")
    ranked = ranks(one, seeded(seed, "problem_id"), "problem_id")
    n = F.broadcast(one.agg(F.count("*").alias("many")))
    a = ranked.join(n).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("to", (F.col("rank") + F.col("draw")) % F.col("many"))
    b = ranked.select(F.col("rank").alias("to"), F.col("problem_id").alias("problem_id2"), F.col("submission_id").alias("submission_id2"))
    met = a.join(b, "to").where("problem_id <> problem_id2").withColumn("p", F.least("problem_id", "problem_id2")).withColumn("q", F.greatest("problem_id", "problem_id2"))
    met = met.join(used, ["p", "q"], "left_anti")
    return met.select(F.col("problem_id").alias("problem_id1"), F.col("submission_id").alias("submission_id1"), "problem_id2", "submission_id2").distinct()


def random_partners(rows: DataFrame, group: str, key: str, same: bool, seed: object) -> DataFrame:
    """Each row with a partner of the same group, or of another, by seeded rank."""
    if same:
        sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
        a = ranks(rows.select(group, key), seeded(seed, key), key, group=[group])
        b = a.select(group, F.col(key).alias("partner"), F.col("rank").alias("next"))
        a = a.join(sizes, group).withColumn("next", (F.col("rank") + 1) % F.col("n"))
        return a.join(b, [group, "next"]).where(F.col(key) != F.col("partner")).select(group, key, "partner")
    ranked = ranks(rows.select(group, key), seeded(seed, key), key)
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    slot = F.conv(F.substring(seeded(f"{seed}:partner", key), 1, 8), 16, 10).cast("long") % F.col("n")
    a = ranked.select(group, key).join(n).withColumn("slot", slot)
    b = ranked.select(F.col("rank").alias("slot"), F.col(group).alias("g2"), F.col(key).alias("partner"))
    return a.join(b, "slot").where(F.col(group) != F.col("g2")).select(group, key, "partner")


def zip_replacement(failed: DataFrame, spare: DataFrame, key: str) -> DataFrame:
    """The k-th failed row with the k-th spare one, from 1, in the order of a whole number."""
    at = lambda df, name: ranks_by_id(df.select(key), key).select(F.col(key).alias(name), (F.col("rank") + 1).alias("k"))
    return at(failed, "failed").join(at(spare, "spare"), "k")


def assign_slots(clones: DataFrame, targets: DataFrame, per_clone: Column, order: str) -> DataFrame:
    """Clone fragments dealt to numbered targets (slot) by a running count of per_clone, in the order of a whole number."""
    parts = with_parts(clones.withColumn("wanted", per_clone.cast("long")), order)
    sums = parts.groupBy("part").agg(F.sum("wanted").alias("sum"))  # at most 65,536 rows
    before = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("wanted").over(Window.partitionBy("part").orderBy(order)) - F.col("wanted")
    slots = parts.withColumn("within", within).join(sums.select("part", before.alias("before")), "part").withColumn("slot", F.col("before") + F.col("within"))
    return slots.drop("part", "wanted", "within", "before").join(targets, "slot")


def within_problem(found: DataFrame, used: DataFrame, need: int, seed: object, times: int = 3) -> DataFrame:
    """Pairs of which neither side is used, at most `times` as many as needed, in seeded order: a distributed top-n."""
    key = ["submission_id1", "submission_id2"]
    named = found.withColumn("pair_id", F.concat_ws("_", *key))
    return drop_either_side(named, used).orderBy(seeded(seed, *key), *key).limit(times * need)


def exclude(subs: DataFrame, used: DataFrame, key: str = "submission_id") -> DataFrame:
    """Submissions that are not in used."""
    return subs.join(used.select(key).distinct(), key, "left_anti")


def drop_either_side(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """Pairs of which neither side is a training submission."""
    seen = pairs.select("pair_id", F.explode(F.array("submission_id1", "submission_id2")).alias("submission_id")).join(train.select("submission_id").distinct(), "submission_id", "left_semi")
    return pairs.join(seen.select("pair_id").distinct(), "pair_id", "left_anti")
