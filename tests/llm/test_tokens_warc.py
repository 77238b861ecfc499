from __future__ import annotations

import gzip
import random
import re
import time

import numpy as np
import public_tokenizers as P
import pytest
from helpers import empty, odd, odd_rows

from pairloom.llm import tokens, warc

PATH, EOD = P.path("byte_bpe_50k.tiktoken"), 50256


@pytest.mark.parametrize("block", [1 << 20, 100, 7])
def test_counts(spark, block):
    coder = tokens.tokenizer(PATH, P.PATTERN)
    want = sorted((str(i), len(coder.encode_ordinary(t or ""))) for i, t, *_ in odd_rows())
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.counts(odd(spark), PATH, P.PATTERN, EOD, block).collect()) == want
    assert tokens.counts(empty(spark), PATH, P.PATTERN, EOD, block).count() == 0


@pytest.mark.parametrize("largest, block", [(50_256, 3), (50_256, 1 << 20), (200_000, 2)])
def test_flat_files(spark, tmp_path, largest, block):
    """Files cut into byte ranges, against a walk over their identifiers."""
    r, want = np.random.default_rng(1), []
    for n in range(4):
        ids = r.choice([5, 6, 7, EOD, largest], 40 + n)
        ids.astype(tokens.width(largest)).tofile(tmp_path / f"{n} x.bin")
        cuts = [-1, *np.flatnonzero(ids == EOD).tolist()]
        want += [b - a - 1 for a, b in zip(cuts, cuts[1:])] + ([len(ids) - 1 - cuts[-1]] if cuts[-1] < len(ids) - 1 else [])  # the last is cut off
    flat = tokens.read_flat(spark, f"file://{tmp_path}", largest, block)
    assert flat.count() == sum(-(-(40 + n) // block) for n in range(4))
    assert sorted(r.n_tokens for r in tokens.scan(flat, EOD, largest).collect()) == sorted(want)


def test_identifiers_over_16_bits_need_32():
    assert tokens.width(65_535).itemsize == 2 and tokens.width(65_536).itemsize == 4


def test_a_file_that_is_cut_within_an_identifier(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        tokens.read_flat(spark, f"file://{tmp_path}", 50_000).collect()


def test_a_long_text(spark):
    said = "a word and " * 100_000
    got = tokens.counts(spark.createDataFrame([(1, said), (2, "x")], "doc_id long, text string"), PATH, P.PATTERN, EOD, 1000).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(tokens.tokenizer(PATH, P.PATTERN).encode_ordinary(said)), 2: 1}


PAGES = [
    (1, "http://a.example/x", "<html><title>T &amp; t</title><script>var a='<p>';</script><body><p>One<b>two</b></p><!-- no --><a href='/y'>link</a> 3 < 4</body>"),
    (2, None, None),
    (3, "http://b.example/", ""),
    (None, "http://c.example/", "<p>ü" * 2000),
    (1, "http://a.example/x", "<html><title>T &amp; t</title><script>var a='<p>';</script><body><p>One<b>two</b></p><!-- no --><a href='/y'>link</a> 3 < 4</body>"),
]


def test_derivatives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'x' as record", "1 as n_bytes")
    rows = warc.derivatives(df).collect()
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        headers, block = warc.parse(bytes(r.record))
        assert headers["warc-refers-to"] == r.refers_to and block == r.content.encode() and headers["warc-block-digest"] == warc.digest(block)
        assert int(headers["content-length"]) == r.n_bytes
    one = {r.warc_type: r for r in rows if r.page_id == 1}
    assert one["conversion"].content == "T & t\nOnetwo\nlink 3 < 4"
    assert "outlink: /y" in one["metadata"].content and "title: T & t" in one["metadata"].content
    source, _ = warc.parse(warc.response(*PAGES[0]))
    assert one["metadata"].refers_to == source["warc-record-id"] and one["conversion"].source_digest == source["warc-payload-digest"]
    assert len({r.record_id for r in rows}) == 8  # the repeated page repeats its records
    assert warc.derivatives(df.where("false")).count() == 0


def test_files(spark, tmp_path):
    raw = [warc.response(*p) for p in PAGES[:3]]
    (tmp_path / "a.warc").write_bytes(warc.record("warcinfo", "<urn:x>", "text/plain", b"hi", []) + b"".join(raw))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    rows = warc.from_files(spark, f"file://{tmp_path}").collect()
    assert len(rows) == 12 and {re.sub(r".*/", "", r.path) for r in rows} == {"a.warc", "b.warc.gz"}
    with pytest.raises(ValueError):
        warc.parse(raw[0][:-30])


@pytest.mark.parametrize("bit", ["<a ", "<!-", "<title ", "<script>", "</p", "<!--", "<a href=", '<a href="', "<p>", "&amp;", "<a b=c href=d ", "</script", "<"])
def test_a_megabyte_of_markup_is_linear(bit):
    page = bit * ((1 << 20) // len(bit))
    began = time.process_time()
    warc.derive(warc.response(1, "http://a.example", page))
    assert time.process_time() - began < 5  # a second or two on an idle core


def brute_text(page):
    """The same rules by Python's own parser, for pages it reads alike."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden, self.title, self.inside, self.links = [], 0, None, False, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in warc.HIDDEN
            self.inside = self.inside or (tag == "title" and self.title is None)
            self.title = "" if tag == "title" and self.title is None else self.title
            self.parts.append("\n" if tag in warc.LINES else "")
            self.links += [v for k, v in attrs if k == "href" and tag == "a" and v is not None]

        def handle_endtag(self, tag):
            self.hidden -= tag in warc.HIDDEN
            self.inside = self.inside and tag != "title"
            self.parts.append("\n" if tag in warc.LINES else "")

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)
                if self.inside:
                    self.title += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = "".join(reader.parts).split("\n")
    return "\n".join(x for line in lines if (x := " ".join(line.split()))), None if reader.title is None else " ".join(reader.title.split()), reader.links


def test_pages_like_another_parser():
    r, bits = random.Random(2), ["<p>", "</p>", "<b>", "</b>", "<br/>", "<li class='x'>", "<a href='/y?a=1&amp;b=2'>", '<A class="k" HREF="z">', "</a>", "<!-- <p>no -->", "<style>p {}</style>", "<div>", "</div>", "word", " two words ", "&amp;", "&lt;", "é", "\n", "<h2>", "</h2>"]
    for _ in range(300):
        page = "<html><title>T &amp; " + r.choice("abc") + "</title><body>" + "".join(r.choice(bits) for _ in range(r.randint(0, 40))) + "</body></html>"
        assert warc.told(page) == brute_text(page)


def test_damaged_files_name_the_place():
    good = warc.response(*PAGES[0])
    for raw in (b"WARC/1.1\r\nWARC-Type: x\r\n\r\nabc", good + b"WARC/1.1\r\nno end", gzip.compress(good)[:-20] + b"zzzz" * 9):
        with pytest.raises(ValueError):
            [warc.parse(x) for x in warc.records(raw)]
