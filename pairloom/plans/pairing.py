"""Queries on scans, gates, joins, samples and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import pairs, sampling
from pairloom.plans.registry import SUBS, Tables, query, rank_sql


def picked_sql(name: str, lang: str, status: str, k: int = 3, seed: object = 42) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY {rank_sql(f"{seed}:{lang}:{status}", "submission_id")}, submission_id) AS r
FROM gated WHERE lang = '{lang}' AND status = '{status}') WHERE r <= {k})"""


def met_sql(a: str, b: str, neg: str, ok1: str, ok2: str) -> str:
    return f"""SELECT a.submission_id AS submission_id1, b.submission_id AS submission_id2, a.problem_id AS problem_id1, b.problem_id AS problem_id2, {ok1} AS accepted1, {ok2} AS accepted2, {neg} AS neg_type, greatest(a.n_lines, b.n_lines) AS longest
FROM {a} a JOIN {b} b ON a.problem_id = b.problem_id"""


COLUMNS = ["submission_id1", "submission_id2", "problem_id1", "problem_id2", "accepted1", "accepted2", "neg_type", "longest"]
A1, B1, A0, B0 = (picked_sql(n, x, s) for n, x, s in (("a1", "en", "Accepted"), ("b1", "fr", "Accepted"), ("a0", "en", "Wrong Answer"), ("b0", "fr", "Wrong Answer")))
HARD = f"{met_sql('a1', 'b0', chr(39) + 'hard' + chr(39), 'true', 'false')} UNION ALL {met_sql('a0', 'b1', chr(39) + 'hard' + chr(39), 'false', 'true')}"
EASY = f"""both_ok AS (SELECT problem_id FROM gated WHERE status = 'Accepted' AND lang IN ('en', 'fr') GROUP BY 1 HAVING count(DISTINCT lang) = 2),
lefts AS (SELECT * FROM gated SEMI JOIN both_ok USING (problem_id) WHERE lang = 'en' AND status = 'Accepted'),
rights AS (SELECT *, row_number() OVER (ORDER BY {rank_sql("42", "submission_id")}, submission_id) - 1 AS r, count(*) OVER () AS many FROM gated SEMI JOIN both_ok USING (problem_id) WHERE lang = 'fr' AND status = 'Accepted'),
draws AS (SELECT l.*, d.range AS draw, ('0x' || substr({rank_sql("42", "submission_id", "'draw'", "d.range")}, 1, 8))::BIGINT AS h FROM lefts l, range(3) d)"""


@query("s1_metadata_csv", "SELECT source AS problem_id, lang, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents GROUP BY ALL")
def s1(t: Tables) -> DataFrame:
    from pairloom.sources.readers import read_metadata
    from pairloom.sources.sinks import scratch, write_metadata

    docs = t.documents.select(F.col("doc_id").alias("submission_id"), F.col("source").alias("problem_id"), F.col("lang").alias("language"), F.lit("Accepted").alias("status"), F.lit("txt").alias("filename_ext"), F.col("n_chars").alias("code_size"))
    path = scratch(t.spark, "metadata")
    write_metadata(docs, path)
    return read_metadata(t.spark, path).groupBy("problem_id", F.col("language").alias("lang")).agg(F.count("*").alias("n"), F.sum("code_size").alias("size"))


@query("s4_jsonl_tolerant", "SELECT doc_id, lang, n_chars FROM documents")
def s4(t: Tables) -> DataFrame:
    from pairloom.sources.readers import read_jsonl
    from pairloom.sources.sinks import scratch

    path = scratch(t.spark, "jsonl")
    good = t.documents.select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("value"))
    good.unionByName(t.documents.limit(3).select(F.lit('{"doc_id": broken').alias("value"))).write.text(path)
    return read_jsonl(t.spark, path, "doc_id long, lang string, n_chars long")


@query("s6_split_from_path", "SELECT lang AS lang_pair, source AS split, count(*) AS n FROM documents GROUP BY ALL")
def s6(t: Tables) -> DataFrame:
    from pairloom.sources.readers import read_split_tree
    from pairloom.sources.sinks import fan_out, scratch

    path = scratch(t.spark, "tree")
    fan_out(t.documents.select("doc_id", F.col("lang").alias("lang_pair"), F.col("source").alias("split")), path, "lang_pair", "split")
    return read_split_tree(t.spark, path, "doc_id long").groupBy("lang_pair", "split").agg(F.count("*").alias("n"))


@query("p1_safe_cast", r"SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '([^/]*)$', 1) AS INT), 0) AS n FROM pages")
def p1(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.safe_int(F.regexp_extract("url", r"([^/]*)$", 1)).alias("n"))


@query("p2_language_status", f"WITH {SUBS} SELECT submission_id, lang, status FROM subs WHERE lang IN ('en', 'fr') AND status IN ('Accepted', 'Wrong Answer')")
def p2(t: Tables) -> DataFrame:
    return t.submissions().where(F.col("lang").isin("en", "fr") & F.col("status").isin("Accepted", "Wrong Answer")).select("submission_id", "lang", "status")


@query("p3_length_gate", f"WITH {SUBS} SELECT submission_id, n_lines, max_chars, n_lines BETWEEN 4 AND 74 AND max_chars <= 148 AS full_gate FROM subs WHERE n_lines BETWEEN 4 AND 74")
def p3(t: Tables) -> DataFrame:
    return t.gated().select("submission_id", "n_lines", "max_chars", text.length_gate(F.col("n_lines"), F.col("max_chars")).alias("full_gate"))


@query("p12_ignore_list", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def p12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.where("quality = 0"), "doc_id", "left_anti")


@query("w1_top_k", f"WITH {SUBS} SELECT submission_id, problem_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, lang, status ORDER BY code_size, submission_id) AS r FROM subs) WHERE r <= 10")
def w1(t: Tables) -> DataFrame:
    return sampling.top_k(t.submissions(), ["problem_id", "lang", "status"], [F.col("code_size"), F.col("submission_id")], 10).select("submission_id", "problem_id", "lang")


@query("w2_sample_per_group", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {rank_sql('7', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 3")
def w2(t: Tables) -> DataFrame:
    return sampling.sample_per_group(t.documents.select("doc_id", "source"), ["source"], "doc_id", 3, 7)


@query(
    "w3_stratified",
    f"""WITH {SUBS}, b AS (SELECT submission_id, CASE WHEN n_lines BETWEEN 1 AND 15 THEN 0 WHEN n_lines BETWEEN 16 AND 30 THEN 1 WHEN n_lines BETWEEN 31 AND 50 THEN 2 ELSE 3 END AS bucket FROM subs),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {rank_sql("s", "submission_id")}, submission_id) AS r FROM b)
SELECT submission_id, bucket FROM r ORDER BY CASE WHEN r > 30 THEN 1 ELSE 0 END, {rank_sql("s", "submission_id")}, submission_id LIMIT 120""",
)
def w3(t: Tables) -> DataFrame:
    subs = t.submissions().select("submission_id", text.bucket(F.col("n_lines")).alias("bucket"))
    return sampling.stratified(subs, "bucket", 4, 120, "submission_id", seed="s")


@query(
    "w4_pool_split",
    f"""WITH p AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY {rank_sql("42", "source")}, source) AS r, count(*) OVER () AS n FROM p)
SELECT source, CASE WHEN r <= floor(n * 0.10::DOUBLE) THEN 'test' WHEN r <= floor(n * 0.10::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'val' ELSE 'train' END AS pool FROM r""",
)
def w4(t: Tables) -> DataFrame:
    return sampling.pool_split(t.documents.select("source").distinct(), "source")


@query("w5_numbering", f"SELECT doc_id, printf('%s_%06d', lang, row_number() OVER (PARTITION BY lang ORDER BY {rank_sql('n', 'doc_id')}, doc_id) - 1) AS pair_id FROM documents")
def w5(t: Tables) -> DataFrame:
    done = sampling.ranks(t.documents.select("doc_id", "lang"), sampling.seeded("n", "doc_id"), "doc_id", group=["lang"])
    return done.select("doc_id", F.format_string("%s_%06d", "lang", "rank").alias("pair_id"))


@query("w6_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {rank_sql('42', 'doc_id')}, doc_id) - 1 AS place FROM documents")
def w6(t: Tables) -> DataFrame:
    return sampling.ranks(t.documents.select("doc_id"), sampling.seeded(42, "doc_id"), "doc_id").select("doc_id", F.col("rank").alias("place"))


@query("w8_languages_by_count", "SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY lang")
def w8(t: Tables) -> DataFrame:
    counted = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "lang")))


@query(
    "w9_balanced_refill",
    f"""WITH k AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 = 0), s AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM k) WHERE r <= 40),
c AS (SELECT quality, count(*) AS have FROM h GROUP BY 1), f AS (SELECT s.*, row_number() OVER (PARTITION BY quality ORDER BY {rank_sql("r", "doc_id")}, doc_id) AS r FROM s)
SELECT doc_id, quality FROM h UNION ALL SELECT f.doc_id, f.quality FROM f LEFT JOIN c USING (quality) WHERE f.r <= 40 - coalesce(have, 0)""",
)
def w9(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", "quality")
    return sampling.balanced_refill(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 <> 0"), "quality", "doc_id", 40, "r")


@query("w13_first_seen", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 AS first_seen FROM documents")
def w13(t: Tables) -> DataFrame:
    """The first ids meet documents by id, so that copies of one text are never gathered."""
    first = t.documents.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    return t.documents.select("doc_id").join(first, "doc_id", "left").select("doc_id", F.coalesce("first", F.lit(False)).alias("first_seen"))


@query("w15_zero_shot_mix", "SELECT * FROM (SELECT doc_id, 'sd' AS split FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100) UNION ALL SELECT * FROM (SELECT doc_id, 'dd' AS split FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 100)")
def w15(t: Tables) -> DataFrame:
    part = lambda lang, split: t.documents.where(F.col("lang") == lang).select("doc_id", F.lit(split).alias("split")).orderBy("doc_id").limit(100)
    return part("en", "sd").unionByName(part("fr", "dd"))


@query("j1_positive_pairs", f"WITH {SUBS}, {A1}, {B1} {met_sql('a1', 'b1', 'NULL::VARCHAR', 'true', 'true')}")
def j1(t: Tables) -> DataFrame:
    return pairs.positives(t.measured(), "en", "fr").select(COLUMNS)


@query("j2_hard_negatives", f"WITH {SUBS}, {A1}, {B1}, {A0}, {B0} {HARD}")
def j2(t: Tables) -> DataFrame:
    return pairs.hard_negatives(t.measured(), "en", "fr").select(COLUMNS)


@query(
    "j3_easy_negatives",
    f"""WITH {SUBS}, {EASY}
SELECT DISTINCT d.submission_id AS submission_id1, r.submission_id AS submission_id2, d.problem_id AS problem_id1, r.problem_id AS problem_id2 FROM draws d JOIN rights r ON r.r = d.h % r.many WHERE d.problem_id <> r.problem_id""",
)
def j3(t: Tables) -> DataFrame:
    return pairs.easy_negatives(t.measured(), "en", "fr").select("submission_id1", "submission_id2", "problem_id1", "problem_id2")


MIXED = f"""found AS (SELECT 'pos' AS kind, 1 AS label, submission_id1, submission_id2, neg_type, longest FROM ({met_sql("a1", "b1", "NULL::VARCHAR", "true", "true")})
UNION ALL SELECT 'hard', 0, submission_id1, submission_id2, neg_type, longest FROM ({HARD})
UNION ALL SELECT DISTINCT 'easy', 0, d.submission_id, r.submission_id, 'easy', greatest(d.n_lines, r.n_lines) FROM draws d JOIN rights r ON r.r = d.h % r.many WHERE d.problem_id <> r.problem_id),
b AS (SELECT *, CASE WHEN longest BETWEEN 1 AND 15 THEN 0 WHEN longest BETWEEN 16 AND 30 THEN 1 WHEN longest BETWEEN 31 AND 50 THEN 2 ELSE 3 END AS bucket, md5(concat_ws(':', '42', kind, submission_id1, submission_id2)) AS o, CASE kind WHEN 'pos' THEN 100 ELSE 50 END AS most FROM found),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, bucket ORDER BY o, submission_id1, submission_id2) AS k FROM b),
q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN k > most // 4 THEN 1 ELSE 0 END, o, submission_id1, submission_id2) AS place FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o, submission_id1, submission_id2) - 1 AS number FROM q WHERE place <= most)"""


@query("j_mixed_pairs", f"WITH {SUBS}, {A1}, {B1}, {A0}, {B0}, {EASY}, {MIXED} SELECT printf('en_fr_train_%s_%06d', kind, number) AS pair_id, label, neg_type, submission_id1::VARCHAR AS sid1, submission_id2::VARCHAR AS sid2 FROM p")
def mixed(t: Tables) -> DataFrame:
    made = pairs.pair_records(pairs.mixed_pairs(t.measured(), "en", "fr", 200, "en_fr_train"))
    return made.select("pair_id", "label", "neg_type", F.col("code1.submission_id").alias("sid1"), F.col("code2.submission_id").alias("sid2"))


@query(
    "p4_pair_records",
    f"""WITH {SUBS}, {A1}, {B1} SELECT a.submission_id AS sid1, b.submission_id AS sid2, 'data/' || a.problem_id || '/en/' || a.submission_id || '.txt' AS rel_path1, 'images/' || b.problem_id || '/fr/' || b.submission_id || '.png' AS image_rel_path2
FROM a1 a JOIN b1 b ON a.problem_id = b.problem_id""",
)
def p4(t: Tables) -> DataFrame:
    made = pairs.pair_records(pairs.positives(t.measured(), "en", "fr").withColumn("pair_id", F.lit("x")).withColumn("label", F.lit(1)))
    return made.select(F.col("code1.submission_id").cast("long").alias("sid1"), F.col("code2.submission_id").cast("long").alias("sid2"), F.col("code1.rel_path").alias("rel_path1"), F.col("code2.image_rel_path").alias("image_rel_path2"))


@query("j4_exclude_submissions", "SELECT doc_id AS submission_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def j4(t: Tables) -> DataFrame:
    used = t.labels.where("toxic = 1").select(F.col("doc_id").alias("submission_id"))
    return pairs.exclude(t.documents.select(F.col("doc_id").alias("submission_id")), used)


@query("j5_semi_pairs", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def j5(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn").join(t.conversations.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_semi")


@query(
    "j6_either_side",
    f"""WITH {SUBS}, {A1}, {B1}, p AS ({met_sql("a1", "b1", "NULL", "true", "true")})
SELECT submission_id1, submission_id2 FROM p WHERE submission_id1 % 5 <> 0 AND submission_id2 % 5 <> 0""",
)
def j6(t: Tables) -> DataFrame:
    found = pairs.positives(t.measured(), "en", "fr").withColumn("pair_id", F.concat_ws("_", "submission_id1", "submission_id2"))
    train = t.documents.where("doc_id % 5 = 0").select(F.col("doc_id").alias("submission_id"))
    return pairs.drop_either_side(found, train).select("submission_id1", "submission_id2")


def lines_of(t: Tables, lang: str, name: str) -> DataFrame:
    return sampling.ranks_by_id(t.documents.where(F.col("lang") == lang).select("doc_id"), "doc_id").select(F.col("rank").cast("long").alias("line_no"), F.col("doc_id").alias(name))


LINED = "e AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id FROM documents WHERE lang = 'en'), f AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id FROM documents WHERE lang = 'fr')"


@query("j9_positional", f"WITH {LINED} SELECT e.i AS line_no, e.doc_id AS l, f.doc_id AS r FROM e JOIN f USING (i)")
def j9(t: Tables) -> DataFrame:
    return pairs.by_position(lines_of(t, "en", "l"), lines_of(t, "fr", "r"))


ALIGNED = f"{LINED}, n AS (SELECT count(*) AS n FROM e JOIN f USING (i))"


def aligned(t: Tables) -> int:
    """How many rows the two sides have in common."""
    return pairs.by_position(lines_of(t, "en", "l"), lines_of(t, "fr", "r")).count()


@query("j10_offset_negatives", f"WITH {ALIGNED} SELECT e.doc_id AS l, f.doc_id AS r FROM (SELECT e.*, n, (e.i + n // 3) % n AS j FROM e, n WHERE e.i < n) e JOIN f ON f.i = CASE WHEN e.j = e.i THEN (e.i + 1) % n ELSE e.j END")
def j10(t: Tables) -> DataFrame:
    """j10 over all aligned rows."""
    n = aligned(t)
    return pairs.offset_negatives(lines_of(t, "en", "l").where(F.col("line_no") < n), lines_of(t, "fr", "r"), max(n, 1)).select("l", "r")


@query("j11_ordered_negatives", f"WITH {ALIGNED} SELECT e.doc_id AS l, f.doc_id AS r FROM e JOIN f ON e.i <> f.i, n WHERE e.i < n AND f.i < n ORDER BY e.i, f.i LIMIT 1000")
def j11(t: Tables) -> DataFrame:
    """j11 over all aligned rows; only the pairs are limited, as in the reference."""
    return pairs.ordered_negatives(lines_of(t, "en", "l"), lines_of(t, "fr", "r"), aligned(t), 1000).select("l", "r")


@query(
    "j12_cross_problem",
    f"""WITH o AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {rank_sql("x", "doc_id")}, doc_id) AS r FROM documents) WHERE r = 1),
k AS (SELECT *, row_number() OVER (ORDER BY {rank_sql("x", "source")}, source) - 1 AS r, count(*) OVER () AS n FROM o)
SELECT DISTINCT a.source AS problem_id1, a.doc_id AS submission_id1, b.source AS problem_id2, b.doc_id AS submission_id2 FROM k a JOIN k b ON b.r IN ((a.r + 1) % a.n, (a.r + 2) % a.n)
WHERE a.source <> b.source AND NOT (least(a.source, b.source) = 'src0' AND greatest(a.source, b.source) = 'src1')""",
)
def j12(t: Tables) -> DataFrame:
    subs = t.documents.select(F.col("source").alias("problem_id"), F.col("doc_id").alias("submission_id"))
    used = t.spark.createDataFrame([("src0", "src1")], "p string, q string")
    return pairs.cross_problem_negatives(subs, used, "x")


@query("j13_within_problem", f"WITH {SUBS}, {A1}, {B1} SELECT a.submission_id AS submission_id1, b.submission_id AS submission_id2 FROM a1 a JOIN b1 b USING (problem_id) WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE toxic = 1 AND l.doc_id IN (a.submission_id, b.submission_id))")
def j13(t: Tables) -> DataFrame:
    found = pairs.positives(t.measured(), "en", "fr").withColumn("pair_id", F.concat_ws("_", "submission_id1", "submission_id2"))
    return pairs.drop_either_side(found, t.labels.where("toxic = 1").select(F.col("doc_id").alias("submission_id"))).select("submission_id1", "submission_id2")


@query(
    "j13_early_stop",
    f"""WITH {SUBS}, {A1}, {B1}, used AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT a.submission_id AS submission_id1, b.submission_id AS submission_id2 FROM a1 a JOIN b1 b USING (problem_id)
WHERE a.submission_id NOT IN (FROM used) AND b.submission_id NOT IN (FROM used) ORDER BY {rank_sql("w", "a.submission_id", "b.submission_id")}, 1, 2 LIMIT 30""",
)
def j13_early(t: Tables) -> DataFrame:
    found = pairs.positives(t.measured(), "en", "fr")
    return pairs.within_problem(found, t.labels.where("toxic = 1").select(F.col("doc_id").alias("submission_id")), 10, "w").select("submission_id1", "submission_id2")


@query("j14_pool_membership", f"WITH p AS (SELECT source, row_number() OVER (ORDER BY {rank_sql('42', 'source')}, source) AS r FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id FROM documents JOIN p USING (source) WHERE r > 3")
def j14(t: Tables) -> DataFrame:
    pools = sampling.pool_split(t.documents.select("source").distinct(), "source")
    return t.documents.select("doc_id", "source").join(pools.where("pool = 'train'"), "source").select("doc_id")


@query(
    "j17_random_partners",
    f"""WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {rank_sql("p", "doc_id")}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT a.lang, a.doc_id, b.doc_id AS partner FROM a JOIN a b ON a.lang = b.lang AND b.r = a.r % a.n + 1 WHERE a.doc_id <> b.doc_id""",
)
def j17(t: Tables) -> DataFrame:
    return pairs.random_partners(t.documents.select("lang", "doc_id"), "lang", "doc_id", True, "p")


@query(
    "j17_other_partners",
    f"""WITH a AS (SELECT lang, doc_id, row_number() OVER (ORDER BY {rank_sql("p", "doc_id")}, doc_id) - 1 AS r, count(*) OVER () AS n, ('0x' || substr({rank_sql("p:partner", "doc_id")}, 1, 8))::BIGINT AS h FROM documents)
SELECT a.lang, a.doc_id, b.doc_id AS partner FROM a JOIN a b ON b.r = a.h % a.n WHERE a.lang <> b.lang""",
)
def j17_other(t: Tables) -> DataFrame:
    return pairs.random_partners(t.documents.select("lang", "doc_id"), "lang", "doc_id", False, "p")


@query("j18_zip_replacement", "WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM labels WHERE quality = 0), s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM labels WHERE quality = 1) SELECT f.doc_id AS failed, s.doc_id AS spare, k FROM f JOIN s USING (k)")
def j18(t: Tables) -> DataFrame:
    return pairs.zip_replacement(t.labels.where("quality = 0"), t.labels.where("quality = 1"), "doc_id")


@query("j19_constant_map", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS display FROM documents")
def j19(t: Tables) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German", "fr", "French")])
    return t.documents.select("doc_id", F.try_element_at(names, F.col("lang")).alias("display"))


@query("j20_slot_assignment", "WITH c AS (SELECT item_id, coalesce(sum(1 + item_id % 2) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS slot FROM benchmark) SELECT c.item_id, c.slot, d.doc_id FROM c JOIN documents d ON d.doc_id = c.slot")
def j20(t: Tables) -> DataFrame:
    targets = t.documents.select("doc_id", F.col("doc_id").alias("slot"))
    return pairs.assign_slots(t.benchmark.select("item_id"), targets, F.lit(1) + F.col("item_id") % 2, "item_id").select("item_id", "slot", "doc_id")


@query("u1_union_keys", "SELECT source FROM documents WHERE lang = 'en' UNION SELECT source FROM documents WHERE lang = 'fr'")
def u1(t: Tables) -> DataFrame:
    part = lambda lang: t.documents.where(F.col("lang") == lang).select("source")
    return part("en").union(part("fr")).distinct()


@query("u2_concat", "SELECT doc_id, 1 AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0 AS label FROM labels WHERE quality = 0")
def u2(t: Tables) -> DataFrame:
    part = lambda q: t.labels.where(F.col("quality") == q).select("doc_id", F.lit(q).alias("label"))
    return part(1).unionByName(part(0))


@query("u4_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("k8_skip_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k8(t: Tables) -> DataFrame:
    from pairloom.sources.sinks import missing

    return missing(t.documents.select("doc_id"), t.labels, "doc_id")


@query("b3_leakage_audit", f"WITH {SUBS}, {A1}, {B1}, {A0}, {B0}, p AS ({met_sql('a1', 'b1', 'NULL', 'true', 'true')} UNION ALL {HARD}) SELECT CASE WHEN neg_type IS NULL THEN 1 ELSE 0 END AS label, problem_id1 = problem_id2 AS same_problem, count(*) AS n FROM p GROUP BY ALL")
def leakage(t: Tables) -> DataFrame:
    subs = t.measured()
    both = pairs.positives(subs, "en", "fr").unionByName(pairs.hard_negatives(subs, "en", "fr"))
    return both.groupBy(F.col("neg_type").isNull().cast("int").alias("label"), (F.col("problem_id1") == F.col("problem_id2")).alias("same_problem")).agg(F.count("*").alias("n"))
