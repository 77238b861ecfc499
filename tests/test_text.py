from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lines_and_widths(spark):
    rows = ["", "a", "a\n", "a\n\n", "a\r\nb", "a\rb", "a\u2028b", "\n"]
    assert values(spark, rows, text.line_count) == [len(r.splitlines()) for r in rows]
    wide = ["a\tb", "\t\tx", "abcd\te", "ab\t", "", "x\nlonger"]
    assert values(spark, wide, text.widest) == [max([len(x.expandtabs(4)) for x in r.splitlines()], default=0) for r in wide]


def test_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 15, 16, 30, 31, 50, 51, 74, 75)], "n int")
    assert [r.b for r in df.select(text.bucket(F.col("n")).alias("b")).collect()] == [3, 0, 0, 1, 1, 2, 2, 3, 3, 3]


def test_normalize(spark):
    assert values(spark, ["#include <x>\nA", "a // b\nC", "a/* x\ny */b", "x = 7 // 2"], text.normalize) == ["a", "a c", "ab", "x = 7"]


def test_shingles_and_jaccard(spark):
    assert values(spark, ["abcd", "abcde", "aaaaaaa"], lambda c: F.size(text.shingles(c))) == [0, 1, 1]
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(text.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_safe_int(spark):
    assert values(spark, [None, "", "abc", "12"], text.safe_int) == [0, 0, 0, 12]


def test_parse_answer(spark):
    rows = ["<think>no</think> Yes", "nothing", "", "Maybe", "  YES!", "<think>\nyes\n</think>\nNo"]
    assert values(spark, rows, text.parse_answer) == [1, 0, None, None, 1, 0]


def test_detect_language(spark):
    rows = ["def f(x): return x", "std::cout << 1;", "using System;", "import java.util.List;", "words", "", "a->b"]
    assert values(spark, rows, text.detect_language) == ["python", "cpp", "csharp", "java", None, None, "cpp"]


def test_cleanup(spark):
    rows = ["foo ( a [ i ] , b ) ;", "i ++ ; a + = 1 ; x = = y && ! = z", "java . util . *", "f ( ) { }"]
    assert values(spark, rows, text.cleanup) == ["foo(a[i], b);", "i++; a += 1; x == y && != z", "java.util.*", "f() {}"]
    assert values(spark, ["if x :"], lambda c: text.cleanup(c, python=True)) == ["if x:"]


def test_truncate_and_fragments(spark):
    assert values(spark, ["a\nb\nc", "a\nb"], lambda c: text.truncate_lines(c, 2, "...")) == ["a\n...", "a\nb"]
    assert values(spark, ["one\n\ntwo\nx", "single"], lambda c: text.split_fragments(c)["second"]) == ["two\nx", ""]
    assert values(spark, ["def a:\n 1\ndef b:\n 2"], lambda c: text.split_fragments(c, python=True)["second"]) == ["def b:\n 2"]


def test_numbering_and_escape(spark):
    assert values(spark, ["1. x", "10) y", "11. z", "```cpp int", "```c++ a", "```java"], text.strip_numbering) == [" x", " y", "11. z", " int", " a", "java"]
    assert values(spark, ["a<b>&"], text.xml_escape) == ["a&lt;b&gt;&amp;"]


def test_literal_to_json(spark):
    assert values(spark, ["{'a': True, 'b': None}"], text.literal_to_json) == ['{"a": true, "b": null}']


def test_fonts(spark):
    df = spark.createDataFrame([(10, 50), (10, 150), (60, 150), (200, 500)], "n int, m int")
    got = df.select(text.pick_font(F.col("n"), F.col("m")).alias("a"), text.fit_font(F.col("n"), F.col("m")).alias("b")).collect()
    assert [r.a for r in got] == [26, 20, 13, 13]
    assert got[3].b == 9
