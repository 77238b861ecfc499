"""Queries on text functions, aggregates, contamination, prompts, scores and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import dedup, metrics, parsing, prompts, sampling
from pairloom.plans.registry import LINES, SUBS, WIDEST, Tables, normal_sql, query, shingles_sql, signature_sql
from pairloom.sources.sinks import scratch

B_SQL = "CASE WHEN n BETWEEN 1 AND 15 THEN 0 WHEN n BETWEEN 16 AND 30 THEN 1 WHEN n BETWEEN 31 AND 50 THEN 2 ELSE 3 END"
C = F.col


@query("f1_line_count", f"SELECT doc_id, {LINES} AS n FROM documents")
def f1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.line_count(C("text")).alias("n"))


@query("f2_widest_line", f"SELECT doc_id, {WIDEST} AS width FROM documents")
def f2(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.widest(C("text")).alias("width"))


@query("f3_bucket", f"SELECT doc_id, {B_SQL} AS bucket FROM (SELECT doc_id, {LINES} AS n FROM documents)")
def f3(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.bucket(text.line_count(C("text"))).alias("bucket"))


@query("f4_normalize", f"SELECT doc_id, md5({normal_sql('text')}) AS digest FROM documents")
def f4(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.normalize(C("text"))).alias("digest"))


SHINGLED = f"""n AS (SELECT doc_id, {normal_sql("text")} AS s FROM documents)"""


@query("f5_shingles", f"WITH {SHINGLED}, c AS (SELECT doc_id, string_split(s, '') AS c FROM n) SELECT doc_id, len(list_distinct(list_transform(range(1, greatest(len(c) - 3, 1)), lambda i: c[i] || c[i+1] || c[i+2] || c[i+3] || c[i+4]))) AS n FROM c")
def f5(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.shingles(text.normalize(C("text")))).alias("n"))


def _normal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", text.normalize(C("text")).alias("s"))


SIGNED = f"{SHINGLED}, {signature_sql('n', 'doc_id', 128)}"


@query("f6_minhash", f"WITH {SIGNED} SELECT doc_id, i AS place, v AS value FROM sig")
def f6(t: Tables) -> DataFrame:
    return _signed(t).select("doc_id", F.posexplode("signature").alias("place", "value"))


@query("f7_band_keys", f"WITH {SIGNED} SELECT doc_id, band, band_key FROM bands")
def f7(t: Tables) -> DataFrame:
    return dedup.banded(_signed(t), "doc_id")


def _signed(t: Tables) -> DataFrame:
    return dedup.minhash(_normal(t), "doc_id", "s")


def _sides(t: Tables) -> DataFrame:
    """Documents with the side they are on: even ids are test, odd ids train."""
    return _normal(t).select("doc_id", "s", F.md5("s").alias("digest"), F.when(C("doc_id") % 2 == 0, "test").otherwise("train").alias("side"))


def _distinct_texts(t: Tables) -> DataFrame:
    """One document of each normalized text on each side, its smallest; copies on one side need no pairs of their own."""
    return _sides(t).groupBy("digest", "side").agg(F.min("doc_id").alias("doc_id"), F.first("s").alias("s"))


def _candidates(docs: DataFrame) -> DataFrame:
    bands = dedup.banded(dedup.minhash(docs, "doc_id", "s"), "doc_id")
    left, right = bands.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "test_id"), bands.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "train_id")
    return dedup.candidates(left, right, "test_id", "train_id")


FIRST = f"""{SHINGLED}, first AS (SELECT md5(s) AS digest, doc_id % 2 AS side, min(doc_id) AS doc_id FROM n GROUP BY ALL), r AS (SELECT doc_id, s FROM first JOIN n USING (doc_id)), {signature_sql('r', 'doc_id', 128)},
met AS (SELECT DISTINCT a.doc_id AS test_id, b.doc_id AS train_id FROM bands a JOIN bands b ON a.band = b.band AND a.band_key = b.band_key WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1)"""


@query("j7_lsh_candidates", f"WITH {FIRST} SELECT test_id, train_id FROM met")
def j7(t: Tables) -> DataFrame:
    """Pairs of texts across the sides, each named by its smallest document there; j7_membership names the others."""
    return _candidates(_distinct_texts(t))


@query("j7_membership", f"WITH {SHINGLED} SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'test' ELSE 'train' END AS side, min(doc_id) OVER (PARTITION BY md5(s), doc_id % 2) AS first_id FROM n")
def j7_membership(t: Tables) -> DataFrame:
    """Every document with the smallest one of its text on its side."""
    docs = _sides(t).drop("s")
    return docs.join(docs.groupBy("digest", "side").agg(F.min("doc_id").alias("first_id")), ["digest", "side"]).select("doc_id", "side", "first_id")


@query(
    "j8_contaminated",
    f"""WITH {FIRST}, sim AS (SELECT test_id, train_id, CASE WHEN len(x.g) = 0 AND len(y.g) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) END AS similarity FROM met JOIN g x ON x.doc_id = test_id JOIN g y ON y.doc_id = train_id),
best AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY similarity DESC, train_id) AS k FROM sim)
SELECT n.doc_id AS test_id, similarity, train_id AS best FROM best JOIN first f ON f.doc_id = test_id JOIN n ON md5(n.s) = f.digest AND n.doc_id % 2 = 0 WHERE k = 1 AND similarity > 0.7""",
)
def j8(t: Tables) -> DataFrame:
    """Every contaminated test document, copies included; best is the smallest train document of the most similar text."""
    docs = _distinct_texts(t)
    found = dedup.contaminated(dedup.best_in_bands(docs.select(F.when(C("side") == "test", 0).otherwise(1).alias("side"), C("doc_id").alias("id"), "s")), "test_id", "train_id")
    path = scratch(t.spark, "tests")  # read twice
    _sides(t).where("side = 'test'").select(C("doc_id").alias("member"), "digest").write.parquet(path)
    tests = t.spark.read.parquet(path)
    members = tests.join(tests.groupBy("digest").agg(F.min("member").alias("test_id")), "digest")
    return members.join(found, "test_id").select(C("member").alias("test_id"), "similarity", "best")


@query(
    "j8_exact_pairs",
    f"""WITH {SHINGLED}, first AS (SELECT md5(s) AS digest, doc_id % 2 AS side, min(doc_id) AS doc_id FROM n GROUP BY ALL), g AS (SELECT doc_id, {shingles_sql("c")} AS g FROM (SELECT doc_id, string_split(s, '') AS c FROM first JOIN n USING (doc_id))),
u AS (SELECT doc_id, unnest(g) AS h FROM g), i AS (SELECT a.doc_id AS test_id, b.doc_id AS train_id, count(*)::DOUBLE AS n FROM u a JOIN u b ON a.h = b.h WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY ALL),
j AS (SELECT test_id, train_id, n / (len(x.g) + len(y.g) - n) AS similarity FROM i JOIN g x ON x.doc_id = test_id JOIN g y ON y.doc_id = train_id
UNION ALL SELECT x.doc_id, y.doc_id, 1.0::DOUBLE FROM g x JOIN g y ON len(x.g) = 0 AND len(y.g) = 0 AND x.doc_id % 2 = 0 AND y.doc_id % 2 = 1)
SELECT * FROM j WHERE similarity > 0.7""",
)
def j8_exact(t: Tables) -> DataFrame:
    """All pairs of texts across the sides above the threshold, each text named by its smallest document there."""
    docs = _distinct_texts(t)
    sides = [docs.where(C("side") == n).select(C("doc_id").alias(f"{n}_id"), "s") for n in ("test", "train")]
    return dedup.similar(*sides, "test_id", "train_id", "s")


@query("j8_exact_copies", f"WITH {SHINGLED} SELECT md5(s) AS digest, count(*) AS n, min(doc_id) AS first_id FROM n GROUP BY ALL HAVING count(*) > 1")
def j8_copies(t: Tables) -> DataFrame:
    return _normal(t).groupBy(F.md5("s").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("u3_jaccard", "SELECT a.item_id, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS j FROM (SELECT item_id, list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5))) AS s FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, list_distinct(list_transform(range(1, length(text) - 3), lambda i: substr(text, i, 5))) AS s FROM benchmark) b USING (item_id)")
def u3(t: Tables) -> DataFrame:
    s = t.benchmark.select("item_id", text.shingles(C("text")).alias("s"))
    return s.join(s.select((C("item_id") - 1).alias("item_id"), C("s").alias("s2")), "item_id").select("item_id", F.round(text.jaccard(C("s"), C("s2")), 6).alias("j"))


@query("f8_signature_agreement", f"WITH t AS (SELECT item_id, text AS s FROM benchmark), {signature_sql('t', 'item_id', 128)} SELECT a.item_id, count(*) FILTER (a.v = b.v) / 128.0::DOUBLE AS agreement FROM sig a JOIN sig b ON b.item_id = a.item_id + 1 AND a.i = b.i GROUP BY 1")
def f8(t: Tables) -> DataFrame:
    s = dedup.minhash(t.benchmark, "item_id", "text")
    return s.join(s.select((C("item_id") - 1).alias("item_id"), C("signature").alias("s2")), "item_id").select("item_id", dedup.agreement(C("signature"), C("s2")).alias("agreement"))


ANSWER = "CASE WHEN lower(s) LIKE 'yes%' THEN 1 WHEN lower(s) LIKE 'no%' THEN 0 END"


@query("f9_parse_answer", rf"SELECT conv_id, turn, {ANSWER} AS pred FROM (SELECT *, regexp_replace(regexp_replace(said, '<think>.*?</think>', '', 'gs'), '^\s+|\s+$', '', 'g') AS s FROM (SELECT *, CASE conv_id % 3 WHEN 0 THEN '<think>no</think> Yes, ' WHEN 1 THEN 'Nothing ' ELSE '' END || text AS said FROM conversations))")
def f9(t: Tables) -> DataFrame:
    said = F.concat(F.when(C("conv_id") % 3 == 0, "<think>no</think> Yes, ").when(C("conv_id") % 3 == 1, "Nothing ").otherwise(""), C("text"))
    return t.conversations.select("conv_id", "turn", text.parse_answer(said).alias("pred"))


@query("f10_code_blocks", r"SELECT item_id, md5(text) AS first_block, 2 AS n_blocks, 'C++' AS second_language FROM benchmark")
def f10(t: Tables) -> DataFrame:
    said = prompts.user_text(F.lit("Python"), C("text"), F.lit("C++"), F.lit("x = 1"))
    tagged = F.replace(said, F.lit("```c++"), F.lit("```cpp"))
    return t.benchmark.select("item_id", F.md5(F.get(text.code_blocks(tagged), F.lit(0))).alias("first_block"), F.size(text.code_blocks(tagged)).alias("n_blocks"), F.get(text.language_headers(tagged), F.lit(1)).alias("second_language"))


@query("f11_markdown_tag", "SELECT DISTINCT lang, replace(replace(replace(lower(lang || ' C++#'), '+', 'p'), '#', 'sharp'), ' ', '') AS tag FROM documents")
def f11(t: Tables) -> DataFrame:
    return t.documents.select("lang").distinct().select("lang", text.markdown_tag(F.concat("lang", F.lit(" C++#"))).alias("tag"))


@query("f12_prompts", "SELECT item_id, md5('" + prompts.INSTRUCTION + "' || chr(10) || chr(10) || 'Code 1 (language: Python):' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'Code 2 (language: Java):' || chr(10) || '```java' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'Answer:') AS digest FROM benchmark")
def f12(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.md5(prompts.user_text(F.lit("Python"), C("text"), F.lit("Java"), C("text"))).alias("digest"))


def _chat(t: Tables) -> DataFrame:
    pairs = t.benchmark.select(C("item_id").cast("string").alias("pair_id"), (C("item_id") % 2).cast("int").alias("label"), F.lit(None).cast("string").alias("neg_type"), F.lit("Python").alias("lang1"), C("text").alias("code1"), F.lit("Java").alias("lang2"), C("text").alias("code2"), F.lit("a.png").alias("image1"), F.lit("b.png").alias("image2"))
    return prompts.chat_records(pairs)


@query("p15_modes", "SELECT m.mode, b.item_id::VARCHAR AS pair_id, CASE b.item_id % 2 WHEN 1 THEN 'Yes' ELSE 'No' END AS answer, CASE m.mode WHEN 'b1' THEN NULL WHEN 'b1ctrl' THEN '__black__,__black__' ELSE 'a.png,b.png' END AS images, CASE m.mode WHEN 'b1' THEN 0 ELSE 2 END AS n_images FROM benchmark b, (VALUES ('b1'), ('b1ctrl'), ('b2'), ('b3')) m(mode)")
def p15(t: Tables) -> DataFrame:
    images = F.coalesce(F.size(F.filter(C("messages")[1]["content_parts"], lambda p: p["type"] == "image")), F.lit(0))
    return _chat(t).select("mode", "pair_id", "answer", F.array_join("image_paths", ",").alias("images"), F.greatest(images, F.lit(0)).alias("n_images"))


LEAD = "'" + prompts.INSTRUCTION + "' || chr(10) || chr(10) || 'Code 1 (language: Python):'"
ONE, TWO = ("'```" + x + "' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10)" for x in ("python", "java"))


@query(
    "f12_mode_texts",
    f"""SELECT mode, item_id::VARCHAR AS pair_id, md5(CASE mode WHEN 'b1' THEN {LEAD} || chr(10) || {ONE} || 'Code 2 (language: Java):' || chr(10) || {TWO} || 'Answer:'
WHEN 'b3' THEN {LEAD} || '<image>' || chr(10) || chr(10) || 'Code 2 (language: Java):' || '<image>' || chr(10) || chr(10) || 'Answer:'
ELSE {LEAD} || '<image>' || {ONE} || 'Code 2 (language: Java):' || '<image>' || {TWO} || 'Answer:' END) AS digest, '{prompts.SYSTEM}' AS system FROM benchmark, (VALUES ('b1'), ('b1ctrl'), ('b2'), ('b3')) m(mode)""",
)
def f12_modes(t: Tables) -> DataFrame:
    """What each mode says, with a mark for each image."""
    user = C("messages")[1]
    parts = F.array_join(F.transform(user["content_parts"], lambda p: F.when(p["type"] == "image", "<image>").otherwise(p["text"])), "")
    return _chat(t).select("mode", "pair_id", F.md5(F.coalesce(user["content_text"], parts)).alias("digest"), C("messages")[0]["content_text"].alias("system"))


@query("p9_p10_plain_text", "SELECT m.mode, b.item_id::VARCHAR AS pair_id, 2 AS n_left, contains('x', 'x') AS asks FROM benchmark b, (VALUES ('b1'), ('b1ctrl'), ('b2'), ('b3')) m(mode)")
def p9(t: Tables) -> DataFrame:
    user = C("messages")[1]
    return _chat(t).select("mode", "pair_id", F.size(prompts.without_answer(C("messages"))).alias("n_left"), prompts.plain(user["content_text"], user["content_parts"]).endswith("Answer:").alias("asks"))


@query("f13_rebuilt_prompt", "SELECT item_id, md5('Lead' || chr(10) || chr(10) || 'Code 1 (language: Python):' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'Code 2 (language: Java):' || chr(10) || '```java' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) || 'Answer:') AS digest FROM benchmark")
def f13(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.md5(prompts.rebuilt(prompts.user_text(F.lit("Python"), C("text"), F.lit("Java"), C("text")), "Lead")).alias("digest"))


@query("k14_stringified", "SELECT doc_id, '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' AS json FROM documents")
def k14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.to_json(F.struct("lang", C("n_chars").alias("n"))).alias("json"))


@query("f14_is_python", r"SELECT page_id, starts_with(c, 'def ') OR (contains(c, 'def ') AND contains(c, ':') AND NOT contains(split_part(c, 'def ', 1), '{')) AS python FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'def f(): ' ELSE 'x { def ' END || html AS c FROM pages)")
def f14(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.is_python(F.concat(F.when(C("page_id") % 2 == 0, "def f(): ").otherwise("x { def "), C("html"))).alias("python"))


#: Snippets of each language, so that every branch is taken.
SNIPPETS = ("def f(x): return x", "int main() { std::cout << 1; }", "using System; class A {}", "import java.util.List;", "plain words", "p->next = q;", "public static void main() {}", "Console.WriteLine(1);", "if x: elif y", "foreach (var x in y) {}")
DETECTED = ("python", "cpp", "csharp", "java", None, "cpp", "java", "csharp", "python", "csharp")


@query("f15_detect_language", "SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(DETECTED) if x) + " END AS found FROM documents")
def f15(t: Tables) -> DataFrame:
    snippet = F.get(F.array(*map(F.lit, SNIPPETS)), (C("doc_id") % 10).cast("int"))
    return t.documents.select("doc_id", text.detect_language(snippet).alias("found"))


@query("f16_f17_layout")
def f16(t: Tables) -> DataFrame:
    tokens = F.concat(F.lit("if x : NEW_LINE INDENT y = 1 ; { "), C("text"), F.lit(" } DEDENT z"))
    return parsing.laid_out(t.documents.select("doc_id", tokens.alias("tokens"), "lang"), "doc_id", "tokens", C("lang") == "en").select("doc_id", F.md5("code").alias("digest"))


def _cleanup_sql(c: str) -> str:
    for pattern, to in text.cleanup_rules():
        to = to.replace("$1", "\\1").replace("$2", "\\2")
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


@query("f18_cleanup", f"SELECT page_id, md5({_cleanup_sql('html')}) AS digest FROM pages")
def f18(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.cleanup(C("html"))).alias("digest"))


@query("f19_truncate", f"SELECT doc_id, least({LINES}, 12) AS n, {LINES} > 12 AS cut, md5(CASE WHEN {LINES} > 12 THEN array_to_string(string_split(text, chr(10))[1:11], chr(10)) || chr(10) || '// ... <truncated>' ELSE regexp_replace(text, '\\n$', '') END) AS digest FROM documents")
def f19(t: Tables) -> DataFrame:
    short = text.truncate_lines(C("text"), 12)
    return t.documents.select("doc_id", text.line_count(short).alias("n"), short.endswith("<truncated>").alias("cut"), F.md5(short).alias("digest"))


@query("f20_ascii_only", r"SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')) AS digest FROM documents")
def f20(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.ascii_only(C("text"))).alias("digest"))


@query("f21_pick_font", f"WITH {SUBS} SELECT submission_id, CASE WHEN max_chars > 100 THEN CASE WHEN n_lines <= 15 THEN 20 WHEN n_lines <= 30 THEN 16 ELSE 13 END ELSE CASE WHEN n_lines <= 15 THEN 26 WHEN n_lines <= 30 THEN 20 WHEN n_lines <= 45 THEN 16 ELSE 13 END END AS font FROM subs")
def f21(t: Tables) -> DataFrame:
    return t.submissions().select("submission_id", text.pick_font(C("n_lines"), C("max_chars")).alias("font"))


@query("f22_font_by_width", f"WITH {SUBS}, s AS (SELECT *, greatest(least(CASE WHEN n_lines <= 15 THEN 24 WHEN n_lines <= 30 THEN 18 WHEN n_lines <= 45 THEN 14 ELSE 12 END, least(floor(1220.0::DOUBLE / (greatest(max_chars, 1) * 0.8::DOUBLE))::INT, 24)), 10) AS size FROM subs) SELECT submission_id, size, n_lines > 45 AND size <= 12 AS truncated FROM s")
def f22(t: Tables) -> DataFrame:
    return t.submissions().select("submission_id", text.pick_font_size(C("n_lines"), C("max_chars")).alias("f")).select("submission_id", "f.size", "f.truncated")


FIT = "coalesce(" + ", ".join(f"CASE WHEN n_lines * 1.6::DOUBLE * {s} + 48 <= {h} AND max_chars * 0.8::DOUBLE * {s} + 48 <= {w} THEN {s} END" for w, h in ((1120, 896), (896, 1120)) for s in text.FONT_STEPS) + ", 9)"


@query("f23_fit_font", f"WITH {SUBS} SELECT submission_id, {FIT} AS font FROM subs")
def f23(t: Tables) -> DataFrame:
    return t.submissions().select("submission_id", text.fit_font(C("n_lines"), C("max_chars")).alias("font"))


@query("f24_slug", "SELECT DISTINCT lang, replace(lower(lang || '+'), '+', 'p') || '_' || lower(lang || '++') AS slug FROM documents")
def f24(t: Tables) -> DataFrame:
    return t.documents.select("lang").distinct().select("lang", text.slug(F.concat("lang", F.lit("+")), F.concat("lang", F.lit("++"))).alias("slug"))


@query("f25_f26_paths", r"SELECT page_id, array_extract(string_split(url, '.'), -1) AS ext, array_to_string(regexp_extract_all(array_extract(string_split(url, '/'), -1), '[0-9]+'), ',') AS numbers FROM pages")
def f25(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.extension(C("url")).alias("ext"), F.array_join(text.file_numbers(C("url")), ",").alias("numbers"))


@query("f27_xml_escape", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS digest FROM pages")
def f27(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.xml_escape(C("html"))).alias("digest"))


@query("f28_numbering", r"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '```(cpp|c\+\+|c\b)?', '')), chr(10))) AS digest FROM documents")
def f28(t: Tables) -> DataFrame:
    """Every line of the text with a number before it, stripped of it."""
    number = F.concat((C("doc_id") % 10 + 1).cast("string"), F.lit(")"))
    stripped = F.transform(F.split("text", "\n", -1), lambda line: text.strip_numbering(F.concat(number, line)))
    return t.documents.select("doc_id", F.md5(F.array_join(stripped, "\n")).alias("digest"))


@query("f29_fragments", "SELECT item_id, md5(text) AS first, md5('tail') AS second FROM benchmark")
def f29(t: Tables) -> DataFrame:
    cut = text.split_fragments(F.concat(F.regexp_replace("text", "\n+", "\n"), F.lit("\n\ntail")))
    return t.benchmark.select("item_id", cut.alias("x")).select("item_id", F.md5("x.first").alias("first"), F.md5("x.second").alias("second"))


@query("f29_python_fragments", "SELECT item_id, md5('def f' || item_id || '():' || chr(10) || '  ' || md5(text)) AS first, md5('def g():' || chr(10) || '  ' || length(text)) AS second FROM benchmark")
def f29_python(t: Tables) -> DataFrame:
    said = F.concat(F.lit("def f"), C("item_id").cast("string"), F.lit("():\n  "), F.md5("text"), F.lit("\ndef g():\n  "), F.length("text").cast("string"))
    return t.benchmark.select("item_id", text.split_fragments(said, python=True).alias("x")).select("item_id", F.md5("x.first").alias("first"), F.md5("x.second").alias("second"))


@query("k13_f30_insertion", "SELECT item_id, 1 AS line, 4 AS indent, md5('class A {' || chr(10) || 'NEW' || chr(10) || '    int x;' || chr(10) || text) AS digest FROM benchmark")
def k13(t: Tables) -> DataFrame:
    said = F.concat(F.lit("class A {\n    int x;\n"), C("text"))
    at = text.insertion_point(said)
    return t.benchmark.select("item_id", at["line"].alias("line"), at["indent"].alias("indent"), F.md5(text.insert_at(said, at["line"], F.lit("NEW"))).alias("digest"))


@query("f31_python_functions", "SELECT item_id, 'f' || item_id AS name, 1 AS \"start\", 2 AS \"end\" FROM benchmark")
def f31(t: Tables) -> DataFrame:
    code = F.concat(F.lit("def f"), C("item_id").cast("string"), F.lit("():\n    return 1\nx = 2\n"))
    return parsing.python_functions(t.benchmark.select("item_id", code.alias("code")), "item_id", "code")


@query("f31_brace_functions", "SELECT doc_id, 'f' || i AS name, 2 + i * 4 AS \"start\", 4 + i * 4 AS \"end\" FROM (SELECT doc_id, unnest(range(doc_id % 4)) AS i FROM documents)")
def f31_braces(t: Tables) -> DataFrame:
    """Classes of as many methods as the id says, with braces in comments and strings, and blocks that are no methods."""
    method = lambda i: F.concat(F.lit("\n  public static int f"), i.cast("string"), F.lit("(int x)\n  { if (x > 0) { return 1; } // }\n    char c = '}'; String s = \"{\"; }\n"))
    code = F.concat(F.lit("class A {"), F.array_join(F.transform(F.filter(F.sequence(F.lit(0).cast("long"), C("doc_id") % 4), lambda i: i < C("doc_id") % 4), method), ""), F.lit("}"))
    return parsing.brace_functions(t.documents.select("doc_id", code.alias("code")), "doc_id", "code")


@query("s14_f32_log_entries", "SELECT item_id, round(item_id / 10.0::DOUBLE, 6) AS loss, item_id::DOUBLE AS epoch FROM benchmark")
def s14(t: Tables) -> DataFrame:
    from pairloom.sources.readers import log_entries

    said = F.concat(F.lit(" 5%|x| 1/9\r{'loss': "), (C("item_id") / 10).cast("string"), F.lit(", 'epoch': "), C("item_id").cast("string"), F.lit("}\rdone"))
    return t.benchmark.select("item_id", F.explode(log_entries(said)).alias("e")).select("item_id", F.round("e.loss", 6).alias("loss"), "e.epoch")


@query("d9_f33_printed_dict", "SELECT doc_id, lang, n_chars AS n, doc_id % 2 = 0 AS ok FROM documents")
def d9(t: Tables) -> DataFrame:
    printed = F.concat(F.lit("{'lang': '"), C("lang"), F.lit("', 'n': "), C("n_chars").cast("string"), F.lit(", 'ok': "), F.when(C("doc_id") % 2 == 0, "True").otherwise("False"), F.lit(", 'x': None}"))
    got = F.from_json(text.literal_to_json(printed), "lang string, n long, ok boolean, x string")
    return t.documents.select("doc_id", got.alias("g")).select("doc_id", "g.lang", "g.n", "g.ok")


@query("s7_k10_blocks", "SELECT item_id, 2 AS n_parts, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS first FROM benchmark")
def s7(t: Tables) -> DataFrame:
    from pairloom.sources.readers import clone_blocks
    from pairloom.sources.sinks import block_text

    blocks = clone_blocks(block_text(C("text"), F.lit("second")))
    return t.benchmark.select("item_id", F.explode(blocks).alias("p")).select("item_id", F.size("p").alias("n_parts"), F.md5(F.get("p", F.lit(0))).alias("first"))


@query("k10_pairings", "SELECT a.source, a.lang AS lang1, b.lang AS lang2 FROM (SELECT DISTINCT source, lang FROM documents) a JOIN (SELECT DISTINCT source, lang FROM documents) b ON a.source = b.source AND a.lang < b.lang")
def k10(t: Tables) -> DataFrame:
    return parsing.language_pairings(t.documents.select("source", "lang").distinct(), "source", "lang")


@query("w10_function_ranges", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents), s AS (SELECT doc_id, line_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nx FROM l WHERE line LIKE 'The%'), e AS (SELECT doc_id, max(line_no) AS eof FROM l GROUP BY 1) SELECT doc_id, line_no::INT AS \"start\", coalesce(nx - 2, eof)::INT AS \"end\" FROM s JOIN e USING (doc_id)")
def w10(t: Tables) -> DataFrame:
    lines = parsing.numbered_lines(t.documents, "doc_id", "text")
    return parsing.function_ranges(lines, "doc_id", C("line").startswith("The"))


@query("w11_sections", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text <> ''), s AS (SELECT *, sum(CASE WHEN line LIKE 'The%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l) SELECT doc_id, section::BIGINT AS section, min(line_no)::INT AS \"first\", max(line_no)::INT AS \"last\" FROM s GROUP BY ALL")
def w11(t: Tables) -> DataFrame:
    return parsing.sections(parsing.numbered_lines(t.documents, "doc_id", "text"), "doc_id", C("line").startswith("The"))


@query("w12_running_counter", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations WHERE role = 'user'")
def w12(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("step"))


@query("w14_head_limit", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def w14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy("doc_id").limit(50)


@query("w16_steps_to_epochs", "SELECT page_id, CAST(regexp_extract('checkpoint-' || page_id * 10, '-([0-9]+)$', 1) AS DOUBLE) / 1250 AS epoch FROM pages")
def w16(t: Tables) -> DataFrame:
    name = F.concat(F.lit("checkpoint-"), (C("page_id") * 10).cast("string"))
    return t.pages.select("page_id", (F.regexp_extract(name, "-([0-9]+)$", 1).cast("double") / 1250).alias("epoch"))


@query("p13_similarity_band", "SELECT doc_id, CASE WHEN n_chars % 101 > 75 THEN NULL WHEN n_chars % 101 > 50 THEN 'type-3' ELSE 'type-4' END AS band FROM documents")
def p13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", parsing.similarity_band(C("n_chars") % 101).alias("band"))


@query("p14_input_first", "SELECT conv_id, CASE WHEN list_contains(r, 'system') THEN 'system' END AS first FROM (SELECT conv_id, list(role) AS r FROM conversations GROUP BY 1)")
def p14(t: Tables) -> DataFrame:
    roles = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("r"))
    return roles.select("conv_id", F.get(parsing.with_input_first(C("r"), F.lit("system")), F.lit(0)).alias("first"))


@query("p11_non_empty", "SELECT conv_id, turn FROM conversations WHERE trim(text) <> ''")
def p11(t: Tables) -> DataFrame:
    return t.conversations.where(F.trim("text") != "").select("conv_id", "turn")


@query("p7_field_update", "SELECT doc_id, n_chars + 1 AS n FROM documents")
def p7(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.struct("lang", C("n_chars").alias("n")).alias("r")).withColumn("r", C("r").withField("n", C("r.n") + 1)).select("doc_id", "r.n")


@query("a1_counts", f"WITH {SUBS} SELECT lang, status, count(*) AS n FROM subs GROUP BY ALL")
def a1(t: Tables) -> DataFrame:
    return t.submissions().groupBy("lang", "status").agg(F.count("*").alias("n"))


@query("a2_problems", "SELECT lang, count(DISTINCT source) AS problems, count(*) AS subs FROM documents GROUP BY 1")
def a2(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.countDistinct("source").alias("problems"), F.count("*").alias("subs"))


@query("a3_overlap", f"WITH {SUBS}, p AS (SELECT problem_id, bool_or(lang = 'en' AND status = 'Accepted') AS a, bool_or(lang = 'fr' AND status = 'Accepted') AS b, bool_or(lang = 'en' AND status = 'Wrong Answer') AS c, bool_or(lang = 'fr' AND status = 'Wrong Answer') AS d FROM subs GROUP BY 1) SELECT count(*) FILTER (a AND b) AS both_accepted, count(*) FILTER ((a AND d) OR (c AND b)) AS hard FROM p")
def a3(t: Tables) -> DataFrame:
    has = lambda lang, status: F.bool_or((C("lang") == lang) & F.coalesce(C("status") == status, F.lit(False)))
    p = t.submissions().groupBy("problem_id").agg(has("en", "Accepted").alias("a"), has("fr", "Accepted").alias("b"), has("en", "Wrong Answer").alias("c"), has("fr", "Wrong Answer").alias("d"))
    return p.agg(F.count_if(C("a") & C("b")).alias("both_accepted"), F.count_if((C("a") & C("d")) | (C("c") & C("b"))).alias("hard"))


@query("a4_a11_matrix", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def a4(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("a5_length_summary", "SELECT lang, count(n_chars) AS n, min(n_chars) AS min, round(quantile_cont(n_chars, 0.25), 1) AS p25, round(quantile_cont(n_chars, 0.5), 1) AS median, round(avg(n_chars), 1) AS mean, round(quantile_cont(n_chars, 0.75), 1) AS p75, round(quantile_cont(n_chars, 0.9), 1) AS p90, round(quantile_cont(n_chars, 0.95), 1) AS p95, max(n_chars) AS max FROM documents GROUP BY 1")
def a5(t: Tables) -> DataFrame:
    return metrics.summary(t.documents, "n_chars", "lang")


@query("a6_threshold_counts", "SELECT c.t AS threshold, count(*) FILTER (d.n_chars % 1000 / 1000.0::DOUBLE > c.t) AS n FROM documents d, (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8), (0.9)) c(t) GROUP BY 1")
def a6(t: Tables) -> DataFrame:
    counts = [F.struct(F.lit(x).alias("threshold"), F.count_if(C("n_chars") % 1000 / 1000.0 > x).alias("n")) for x in (0.5, 0.6, 0.7, 0.8, 0.9)]
    return t.documents.agg(F.array(*counts).alias("a")).select(F.inline("a"))


SCORED = "(SELECT l.doc_id, d.lang, l.quality AS label, CASE WHEN d.n_chars % 7 = 0 THEN NULL WHEN d.n_chars > 800 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id))"


def _scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", F.when(C("n_chars") % 7 == 0, None).when(C("n_chars") > 800, 1).otherwise(0).alias("pred"))
    return t.labels.select("doc_id", C("quality").alias("label")).join(docs, "doc_id")


METRICS = f"""c AS (SELECT lang, count(*) AS n_total, count(pred) AS n_parseable, count(*) FILTER (label = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND pred = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND pred = 0)::DOUBLE AS fn, count(*) FILTER (label = 0 AND pred = 0)::DOUBLE AS tn, count(*) FILTER (label = 1)::DOUBLE AS gold FROM {SCORED} GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN gold = 0 THEN 0 ELSE tp / gold END AS recall_all FROM c),
r AS (SELECT lang, n_total, n_parseable, round(n_parseable::DOUBLE / n_total, 9) AS response_rate, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1, round((tp + tn) / n_parseable, 9) AS accuracy, round((tp + tn) / n_total, 9) AS accuracy_all FROM m)"""


@query("a7_binary_metrics", f"WITH {METRICS} SELECT * FROM r")
def a7(t: Tables) -> DataFrame:
    m = metrics.binary_metrics(_scored(t), "label", "pred", "lang")
    return m.select("lang", "n_total", "n_parseable", *[F.round(c, 9).alias(c) for c in ("response_rate", "precision", "recall", "f1", "accuracy", "accuracy_all")])


@query("a8_macro_f1", f"WITH {METRICS} SELECT round(avg(f1), 3) AS macro_f1 FROM r")
def a8(t: Tables) -> DataFrame:
    return metrics.macro(metrics.binary_metrics(_scored(t), "label", "pred", "lang"))


@query("a9_length_histogram", f"SELECT bucket, n, round(100 * n / sum(n) OVER (), 2) AS percent FROM (SELECT {B_SQL} AS bucket, count(*) AS n FROM (SELECT {LINES} AS n FROM documents) GROUP BY 1)")
def a9(t: Tables) -> DataFrame:
    return metrics.shares(t.documents.select(text.bucket(text.line_count(C("text"))).alias("bucket")), ["bucket"], [])


@query("a10_positive_problems", f"WITH {SUBS} SELECT count(DISTINCT problem_id) AS n FROM subs WHERE status = 'Accepted'")
def a10(t: Tables) -> DataFrame:
    return t.submissions().where("status = 'Accepted'").agg(F.countDistinct("problem_id").alias("n"))


@query("a12_font_matrix", f"WITH {SUBS}, f AS (SELECT lang, {FIT} AS font FROM subs), c AS (SELECT lang, font, count(*) AS n FROM f GROUP BY ALL) SELECT lang, font, n, round(100 * n / sum(n) OVER (PARTITION BY lang), 2) AS percent FROM c")
def a12(t: Tables) -> DataFrame:
    return metrics.shares(t.submissions().select("lang", text.fit_font(C("n_lines"), C("max_chars")).alias("font")), ["lang", "font"], ["lang"])


@query("a13_id_set", "SELECT DISTINCT conv_id FROM conversations")
def a13(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id").distinct()


@query("a14_group_lists", "WITH r AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 1000 AS part FROM documents) SELECT source, part, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest FROM r GROUP BY ALL")
def a14(t: Tables) -> DataFrame:
    """The ids of each group, in lists of a thousand at most: a group may hold a third of all rows."""
    ranked = sampling.ranks_by_id(t.documents.select("source", "doc_id"), "doc_id", ["source"])
    listed = ranked.groupBy("source", F.floor(C("rank") / 1000).alias("part")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return listed.select("source", "part", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(C("ids").cast("array<string>"), ",")).alias("digest"))


@query("a15_status_prefix", "SELECT split_part(url, ':', 1) AS status, count(*) AS n FROM pages GROUP BY 1")
def a15(t: Tables) -> DataFrame:
    return t.pages.groupBy(F.substring_index("url", ":", 1).alias("status")).agg(F.count("*").alias("n"))


@query("a16_a17_first_last", "SELECT source, lang, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY ALL")
def a16(t: Tables) -> DataFrame:
    from pairloom.operators.sampling import first_wins

    docs = t.documents.select("source", "lang", "doc_id")
    first, last = first_wins(docs, ["source", "lang"], [C("doc_id")]), first_wins(docs, ["source", "lang"], [F.desc("doc_id")])
    return first.withColumnRenamed("doc_id", "first_id").join(last.withColumnRenamed("doc_id", "last_id"), ["source", "lang"])


@query("a18_shortfall", "SELECT quality, count(*) AS have, greatest(500 - count(*), 0) AS shortfall FROM labels GROUP BY 1")
def a18(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality").agg(F.count("*").alias("have")).withColumn("shortfall", F.greatest(500 - C("have"), F.lit(0)))


@query("a19_row_max", f"WITH {SUBS} SELECT problem_id, max(greatest(n_lines, max_chars)) AS most FROM subs GROUP BY 1")
def a19(t: Tables) -> DataFrame:
    return t.submissions().groupBy("problem_id").agg(F.max(F.greatest("n_lines", "max_chars")).alias("most"))


@query("j15_j16_a20_outcomes", f"SELECT label, pred, second, count(*) AS n FROM (SELECT label, pred, CASE WHEN doc_id % 3 = 0 THEN label ELSE 0 END AS second FROM {SCORED}) GROUP BY ALL")
def a20(t: Tables) -> DataFrame:
    return metrics.outcomes(_scored(t).withColumn("second", F.when(C("doc_id") % 3 == 0, C("label")).otherwise(0)), "label", "pred", "second")


@query("a20_rescue_rate", f"SELECT count(*) AS missed, count(*) FILTER (second = label) AS rescued, round(count(*) FILTER (second = label)::DOUBLE / count(*), 9) AS rate FROM (SELECT label, pred, CASE WHEN doc_id % 3 = 0 THEN label ELSE 0 END AS second FROM {SCORED}) WHERE pred IS DISTINCT FROM label")
def rescue(t: Tables) -> DataFrame:
    got = metrics.rescue_rate(_scored(t).withColumn("second", F.when(C("doc_id") % 3 == 0, C("label")).otherwise(0)), "label", "pred", "second")
    return got.withColumn("rate", F.round("rate", 9))


@query("a21_stage_counts", "SELECT stage, n, round(100 * n / sum(n) OVER (), 2) AS percent FROM (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'kept' END AS stage, count(*) AS n FROM labels GROUP BY 1)")
def a21(t: Tables) -> DataFrame:
    stage = F.when(C("toxic") == 1, "toxic").when(C("quality") == 0, "poor").otherwise("kept")
    return metrics.shares(t.labels.select(stage.alias("stage")), ["stage"], [])


@query("x4_dropout_decision", "SELECT doc_id, ('0x' || substr(md5('drop:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 AS dropped FROM documents")
def x4(t: Tables) -> DataFrame:
    from pairloom.operators.sampling import seeded

    u = F.conv(F.substring(seeded("drop", "doc_id"), 1, 8), 16, 10).cast("double") / 4294967296.0
    return t.documents.select("doc_id", (u < 0.3).alias("dropped"))


@query("b9_class_mix", "SELECT lang, round(avg(quality), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def class_mix(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.round(F.avg("quality"), 6).alias("share"))
