"""Personal data by base patterns and bootstrapped contexts, in DataFrame functions only.

Base spans (e-mail, ip, card, phone) come from four regular expressions. They are the seeds of a graph of lexical
patterns and instances, with strings in the shape of digests (SEED) as the seeds of a fifth kind, secret. An
instance is an identifier-like string; it can be of a kind if its shape (lengths of its groups of digits, and
which groups hold letters) is that of LEAST_KNOWN seeds of the kind or more, or is theirs without the first group.
A pattern is what stands around it: one, two or three words before, alone or with the word after. Patterns are
scored by the share of their distinct instances that are known; with LEAST_KNOWN known ones or more and a
confidence of PATTERN or more they are trusted. An instance is scored by the best trusted pattern of each of its
contexts, jointly over different contexts; from INSTANCE on it is known. This is repeated until no new instance
is found. Seeds of the fifth kind, and known instances in trusted contexts, are added as spans; strings that touch
a base span are not.

The expressions are those of the base rules with boundaries and possessive quantifiers, which change no match
but keep long tokens linear. Null and empty texts have no spans; long texts and tokens are read whole. Each row is
its own, repeated or not. Ties (spans of several kinds at one place) all stay, in the order of KINDS. An empty
table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.frames import kept, texts

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings that could be identifiers: they start where a token starts and hold a digit or an at sign.
CANDIDATE = r"(?<![A-Za-z0-9._%+@#/()-])[A-Za-z._%+#/()-]*+[0-9@](?:[A-Za-z0-9._%+@#/()-]*[0-9A-Za-z])?"
#: Hexadecimal strings as long as digests and keys, digits and letters among them.
SEED = r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"
LEAST_KNOWN, PATTERN, INSTANCE = 3, 0.8, 0.9


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    worth = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    """Whether a match of a base expression is a span."""
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    n = F.length(digits(m))
    card = n.between(14, 19) & luhn(F.when(n.between(1, 19), digits(m)).otherwise("0"))
    return F.when(kind == "email", True).when(kind == "ip", m.rlike(rf"^{part}(?:\.{part}){{3}}$")).when(kind == "card", card).otherwise(n.between(10, 15))


def _words(gap: Column) -> Column:
    """The words of a gap between matches, in lower case, without punctuation around those that hold more."""
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    said = F.filter(F.split(F.lower(gap), " ", -1), lambda w: w != "")
    return F.transform(said, lambda w: F.when(bare(w) == "", w).otherwise(bare(w)))


def _patterns(before: Column, after: Column) -> Column:
    """What stands around a span, the most general first: one to three words before, and with the word after."""
    blank = lambda c: F.translate(c, "\t\n\x0b\x0c\r", "     ")
    left = F.concat(F.array(*[F.lit("^")] * 3), _words(F.substring_index(blank(before), " ", -9)))  # the last pieces, whatever their length
    right = F.get(F.concat(_words(F.substring_index(F.ltrim(blank(after)), " ", 1)), F.array(F.lit("$"))), F.lit(0))
    lead = [F.array_join(F.slice(left, -n, n), " ") for n in (1, 2, 3)]
    return F.array(*(F.concat(x, F.lit(" _")) for x in lead), *(F.concat_ws(" _ ", x, right) for x in lead))


def _places(found: Column, gaps: Column, kind: str) -> Column:
    """Array of (kind, i, gap, said, patterns): each match, how far it is from the one before, and its patterns."""
    both = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("said"), gap.alias("before")))
    both = F.zip_with(F.filter(both, lambda x: x["said"].isNotNull()), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda x, gap: F.struct(x["said"].alias("said"), x["before"].alias("before"), gap.alias("after")))
    return F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["before"]).alias("gap"), x["said"].alias("said"), _patterns(x["before"], x["after"]).alias("patterns")))


def occurrences(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, digest, kind, start, stop, said, patterns): matches of the base expressions, and candidates (kind "?").

    rid tells rows apart. A row without any match has one row here, of no kind. Texts are read once.
    """
    text, none = F.col("text"), F.expr("cast(array() as array<struct<kind:string,i:int,gap:int,said:string,patterns:array<string>>>)")
    asked = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(BASE["card"]), "phone": text.contains("+"), "?": text.rlike("[0-9@]")}
    cut = {k: (F.when(ask, F.regexp_extract_all(text, F.lit(BASE.get(k, CANDIDATE)), F.lit(0))), F.when(ask, F.split(text, BASE.get(k, CANDIDATE), -1))) for k, ask in asked.items()}
    parts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("digest"), *(c.alias(f"{n}{i}") for i, pair in enumerate(cut.values()) for n, c in zip("mg", pair)))
    places = [F.coalesce(_places(F.col(f"m{i}"), F.col(f"g{i}"), k), none) for i, k in enumerate(cut)]
    found = parts.select("rid", "doc_id", "digest", F.explode_outer(F.concat(*places)).alias("x")).select("rid", "doc_id", "digest", "x.*")
    found = kept(found, "occurrences")  # only what was found goes on
    order = Window.partitionBy("rid", "kind").orderBy("i")
    start = F.sum("gap").over(order) + F.sum(F.length("said")).over(order) - F.length("said")
    return found.select("rid", "doc_id", "digest", "kind", start.alias("start"), (start + F.length("said")).alias("stop"), "said", "patterns")


def shape(said: Column) -> Column:
    """The groups of letters and digits in a string: the length of groups of digits, w for others."""
    groups = F.regexp_extract_all(said, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(groups, lambda g: F.when(g.rlike("^[0-9]+$"), F.length(g).cast("string")).otherwise("w"))


def induced(seeds: DataFrame) -> DataFrame:
    """(kind, shape) of LEAST_KNOWN different seeds (kind, said) or more, whole or without the first group."""
    whole = shape(F.col("said"))
    shapes = F.when(F.size(whole) > 1, F.array(whole, F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0))))).otherwise(F.array(whole))
    told = seeds.select("kind", "said").distinct().select("kind", F.explode(shapes).alias("shape"))
    return told.groupBy("kind", F.array_join("shape", "-").alias("shape")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_KNOWN).select("kind", "shape")


def trusted(edges: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Patterns (kind, pattern) and discovered instances (kind, said) of the graph edges (kind, said, context, pattern, known).

    Runs to a fixed point: known instances only grow in number, so it ends.
    """
    patterns = instances = None
    while True:
        met = edges.groupBy("kind", "pattern", "said").agg(F.max("known").alias("known"))
        scored = met.groupBy("kind", "pattern").agg(F.sum("known").alias("f"), F.count("*").alias("n"))
        scored = scored.where((F.col("f") >= LEAST_KNOWN) & (F.col("f") < F.col("n")) & (F.col("f") / F.col("n") >= PATTERN))
        good = kept(scored.select("kind", "pattern", (F.col("f") / F.col("n")).alias("confidence")), "patterns")
        best = edges.where("known = 0").join(good, ["kind", "pattern"]).groupBy("kind", "said", "context").agg(F.max("confidence").alias("confidence"))
        joint = 1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))
        new = kept(best.groupBy("kind", "said").agg(joint.alias("joint")).where(F.col("joint") >= INSTANCE).select("kind", "said"), "instances")
        if new.isEmpty():
            return patterns, instances
        patterns = good.select("kind", "pattern") if patterns is None else kept(patterns.unionByName(good.select("kind", "pattern")).distinct(), "trusted")
        instances = new if instances is None else instances.unionByName(new)  # new ones were unknown before
        known = edges.join(new.withColumn("found", F.lit(1)), ["kind", "said"], "left")
        edges = kept(known.select("kind", "said", "context", "pattern", F.greatest("known", F.coalesce("found", F.lit(0))).alias("known")), "edges")


def graph(seeds: DataFrame, free: DataFrame) -> DataFrame:
    """Edges of seeds and free candidates (kind, said, patterns), each once."""
    rows = seeds.select("kind", "said", "patterns", F.lit(1).alias("known")).unionByName(free.select("kind", "said", "patterns", F.lit(0).alias("known")))
    rows = rows.select("kind", "said", F.element_at("patterns", -1).alias("context"), F.explode("patterns").alias("pattern"), "known")
    return rows.groupBy("kind", "said", "context", "pattern").agg(F.max("known").alias("known"))


def span_rows(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, digest, kind, start, stop, base): the spans of every row; rows without any have one of no kind."""
    found = kept(occurrences(texts(docs)), "places")
    base = found.where(F.col("kind").isin(*BASE)).where(valid(F.col("kind"), F.col("said")))
    taken = base.select(F.col("rid").alias("r"), F.col("start").alias("s"), F.col("stop").alias("e"))
    free = found.where("kind = '?'").join(taken, (F.col("rid") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("stop") > F.col("s")), "left_anti")
    free = kept(free.withColumn("shape", F.array_join(shape(F.col("said")), "-")), "candidates")
    secret = free.where(F.col("said").rlike(SEED)).drop("shape").withColumn("kind", F.lit("secret"))
    seeds = base.unionByName(secret.select(base.columns))
    shapes = kept(induced(seeds), "shapes")
    free = kept(free.where(~F.col("said").rlike(SEED)).drop("kind").join(shapes, "shape"), "free")
    patterns, instances = trusted(kept(graph(seeds, free), "graph"))
    columns = ["rid", "doc_id", "digest", "kind", "start", "stop"]
    rows = base.select(*columns, F.lit(True).alias("base")).unionByName(secret.select(*columns, F.lit(False).alias("base")))
    rows = rows.unionByName(found.groupBy("rid", "doc_id", "digest").agg(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), F.lit(False).alias("base")))
    if instances is not None:
        more = free.join(instances, ["kind", "said"]).withColumn("pattern", F.explode("patterns")).join(patterns, ["kind", "pattern"])
        rows = rows.unionByName(more.select(*columns, F.lit(False).alias("base")).distinct())
    return rows


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans, found): one row for each row of docs.

    The counts by kind and base_sha256 are of base spans; spans lists all, n_added counts those beyond the base.
    found is spans as an array of structs.
    """
    place = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    one = F.struct(F.col("start"), place.alias("n"), F.col("stop"), F.col("kind"), F.col("base"))
    grouped = span_rows(docs).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("found"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("found", lambda x: x["base"])
    count = lambda k: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return grouped.select("doc_id", "digest", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: ~x["base"])).cast("long").alias("n_added"), F.size("found").cast("long").alias("n_spans"), "found")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; overlapping spans become one.

    n_chars, where docs has it, follows the text.
    """
    own = lambda c: next(n for i in range(len(docs.columns) + 1) if (n := f"{c}_{i}") not in docs.columns)
    i, d, f = own("doc"), own("digest"), own("found")
    found = spans(docs).where(F.size("found") > 0).groupBy(F.col("doc_id").alias(i), F.col("digest").alias(d)).agg(F.first("found").alias(f))
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(d)), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        part = F.concat(text.substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.when(x["start"] >= acc["at"], F.struct(x["stop"].alias("at"), F.array_append(acc["parts"], part).alias("parts"))).otherwise(F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), acc["parts"].alias("parts")))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr((acc["at"] + 1).cast("int"), F.length(text)))
    new = F.when(F.col(f).isNull(), F.col("text")).otherwise(F.aggregate(f, start, step, rest))
    n = own("new")  # under a name of its own: within a lambda, "text" would mean the new column beside it
    made = joined.withColumn(n, new)
    return made.select(*(F.col(n).alias("text") if c == "text" else F.when(F.col(f).isNull(), F.col(c)).otherwise(F.length(n)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes))
