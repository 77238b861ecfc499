from __future__ import annotations

import hashlib
import math
import random
import re

from helpers import empty, odd, odd_rows
from pyspark.sql import functions as F

from pairloom.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, said):
    d = re.sub("[^0-9]", "", said)
    if kind == "ip":
        return all(int(x) <= 255 for x in said.split("."))
    if kind == "card":
        worth = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])]
        return 14 <= len(d) <= 19 and sum(worth) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), n, m.end(), k) for n, (k, r) in enumerate(RULES.items()) for m in re.finditer(r, text or "") if fine(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def fuzz():
    r = random.Random(5)
    bits = ["a@b.c", "x.y@", "@", ".", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111 ", "+1 (407) 555-1352", "+", "(", "-", " ", "é", "_", "%", "1.2.3.4", ".5.6.7", "Zz", "0000000000", "\n", "😀", "a@b.c_d@e.f"]
    rows = [(100 + i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(1500)]
    return rows + [(5000 + i, t) for i, t in enumerate(["a" * 3000, "1 " * 3000, "1" * 3000 + "@", "a.b@c-" * 500, "+1 " * 3000, "1." * 3000, "00000000001.2.3.4"])]


def test_base_spans(spark):
    rows = fuzz()
    want = {i: brute(t) for i, t in rows}
    for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = ",".join(f"{x['kind']}:{x['start']}:{x['stop']}" for x in r.found if x["base"])
        assert base == want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in base.split(",")) for k in RULES)
        assert set(base.split(",")) <= set(r.spans.split(",")) or not base


def test_odd_rows(spark):
    rows = pii.spans(odd(spark)).collect()
    assert len(rows) == len(odd_rows()) and all(r.spans == "" for r in rows)
    assert pii.spans(empty(spark)).count() == 0
    red = pii.redacted(odd(spark))
    assert red.columns == odd(spark).columns
    assert sorted(map(str, red.collect())) == sorted(map(str, odd(spark).collect()))


def told(spark):
    rows = [(i, f"please call me at +1 (407) 555-{1000 + i} now") for i in range(20)]
    rows += [(50, "please call me at 407-555-9999 or 1"), (51, "order 407-555-1111"), (52, "mail a@b.org, a@b.org"), (None, "mail a@b.org"), (53, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("i", F.lit(1))


def test_contexts_discover_identifiers(spark):
    got = {r.doc_id: (r.spans, r.n_added, r.n_phone) for r in pii.spans(told(spark)).collect()}
    assert got[50] == ("phone:18:30", 1, 0)
    assert got[51] == ("", 0, 0)
    assert got[0] == ("phone:18:35", 0, 1)


def test_redaction(spark):
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(told(spark)).collect()}
    assert got[50] == ("please call me at <PHONE> or 1", 30)
    assert got[51][0] == "order 407-555-1111" and got[53] == (None, None)
    assert got[52][0] == "mail <EMAIL>, <EMAIL>" and got[None][0] == "mail <EMAIL>"


def brute_fixed_point(rows):
    """Known strings by plain rounds over (kind, said, patterns, known)."""
    known = {(k, s) for k, s, _, y in rows if y}
    least, trusted = set(known), set()
    while True:
        instances = {}
        for k, s, patterns, _ in rows:
            for p in patterns:
                instances.setdefault((k, p), set()).add(s)
        trust = {}
        for (k, p), said in instances.items():
            f = sum((k, s) in known for s in said)
            if pii.LEAST_KNOWN <= f < len(said) and f / len(said) >= pii.PATTERN:
                trust[k, p] = f / len(said)
        joint = {}
        for k, s, patterns, _ in rows:
            best = max([trust[k, p] for p in patterns if (k, p) in trust], default=0)
            if (k, s) not in known and best:
                joint.setdefault((k, s), {})[patterns[-1]] = best
        new = {x for x, contexts in joint.items() if 1 - math.prod(1 - c for c in contexts.values()) >= pii.INSTANCE}
        if not new:
            return known - least, trusted
        known, trusted = known | new, trusted | set(trust)


def keys_and_tokens():
    r = random.Random(3)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(38)) + "a7" for _ in range(60)]
    texts = [f'so {r.choice("abc")} token = "{h}" end' for h in hexes]
    texts += [f'so token = "key{i}x9" end' for i in range(5)]  # found in the first round
    texts += [f"apikey: key{i}x9 ok" for i in range(5)] + ["apikey: zz8z8 ok", "apikey: zz8z8 fine", "apikey: zz8z8"]  # the last in the second
    texts += ["zz8z8 elsewhere", "room b12 here", "a" * 100_000 + ' token = "late9" end']
    return [(i, t) for i, t in enumerate(texts)]


def test_rounds_go_on_to_a_fixed_point(spark):
    docs = spark.createDataFrame(keys_and_tokens(), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    said = {i: [t[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[i].spans.split(",") if x)] for i, t in keys_and_tokens()}
    assert all(said[i] and got[i].n_added == 1 for i in range(60))
    assert [said[i] for i in range(60, 70)] == [[f"key{i % 5}x9"] for i in range(10)]
    assert said[70] == said[71] == said[72] == ["zz8z8"]
    assert said[73] == said[74] == [] and said[75] == ["late9"]


def test_graph_like_brute_force(spark):
    r = random.Random(9)
    rows = []
    for _ in range(900):
        k, n = r.choice(["phone", "secret"]), r.randrange(60)
        a, b, c, d = (r.choice("uvwxyz"[: r.randint(2, 6)]) for _ in range(4))
        rows.append((k, f"s{n}", [f"{a} _", f"{b} {a} _", f"{c} {b} {a} _", f"{a} _ {d}", f"{b} {a} _ {d}", f"{c} {b} {a} _ {d}"], int(n < 50)))
    frame = spark.createDataFrame(rows, "kind string, said string, patterns array<string>, known int")
    patterns, instances = pii.trusted(pii.graph(frame.where("known = 1"), frame.where("known = 0")))
    want, trust = brute_fixed_point(rows)
    assert want and {(x.kind, x.said) for x in instances.collect()} == want
    assert {(x.kind, x.pattern) for x in patterns.collect()} == trust


def test_patterns(spark):
    got = {r.said: r.patterns for r in pii.occurrences(spark.createDataFrame([(1, 'My  phone,\nthen: +1 407 555 1234. Next b@c.d "x1"')], "doc_id long, text string")).where("kind <> '?' or said = 'x1'").collect()}
    assert got["+1 407 555 1234"] == ["then _", "phone then _", "my phone then _", "then _ .", "phone then _ .", "my phone then _ ."]
    assert got["b@c.d"][0] == "next _"
    assert got["x1"][-1].endswith('" _ "')


def test_clashing_and_null_rows_keep_their_number(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a@b.c"), (2, "")], "doc_id long, text string").selectExpr("*", "'x' as patterns", "1 as m0", "2 as g0", "3 as shape")
    assert sorted((str(r.doc_id), r.n_spans) for r in pii.spans(docs).collect()) == [("1", 0), ("1", 0), ("2", 0), ("None", 1)]
