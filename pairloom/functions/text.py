"""Column expressions over source text; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Universal newlines, as str.splitlines() knows them.
LINE_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029])"
BLANKS = r"[ \t\n\r\f\x0B]"


def lines(text: Column) -> Column:
    """The lines of a text without their ends; an empty text has none, and a last end opens no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, LINE_END + r"\z", ""), LINE_END, -1))


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def width(line: Column, tab: int = 4) -> Column:
    """The width of a line with its tabs expanded."""
    parts = F.split(line, "\t", -1)
    stops = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(0), lambda a, x: (F.floor((a + F.length(x)) / tab).cast("int") + 1) * tab)
    return F.when(line.contains("\t"), stops + F.length(F.element_at(parts, -1))).otherwise(F.length(line))


def widest(text: Column, tab: int | None = 4) -> Column:
    """The width of the widest line; tab=None counts characters as they are."""
    measure = F.length if tab is None else lambda x: width(x, tab)
    return F.coalesce(F.array_max(F.transform(lines(text), measure)), F.lit(0))


#: Line-count buckets.
BUCKETS = ((1, 15), (16, 30), (31, 50), (51, 74))


def bucket(n: Column) -> Column:
    """The bucket of a line count; what is in none, 0 included, is in the last."""
    return reduce(lambda c, b: c.when(n.between(*b[1]), b[0]), list(enumerate(BUCKETS))[1:], F.when(n.between(*BUCKETS[0]), 0)).otherwise(len(BUCKETS) - 1)


def length_gate(n_lines: Column, max_chars: Column | None = None, low: int = 4, high: int = 74, widest_line: int | None = 148) -> Column:
    """Whether a submission's size is within limits; a limit of None is off."""
    ok = n_lines.between(low, high)
    return ok if widest_line is None or max_chars is None else ok & (max_chars <= widest_line)


def normalize(code: Column, comments: bool = True) -> Column:
    """Comments out (whatever the language), blanks collapsed, trimmed, lower case."""
    if comments:
        code = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"#[^\n]*", ""), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.lower(F.trim(F.regexp_replace(code, BLANKS + "+", " ")))


def shingles(text: Column, k: int = 5) -> Column:
    """The distinct substrings of k characters; fewer characters, none."""
    # the array of one is a binding: within a lambda an expression would be evaluated anew for each element
    windows = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - (k - 1)), lambda i: F.array_join(F.slice(c, i, k), ""))
    made = F.transform(F.array(F.split(text, "")), lambda c: F.when(F.size(c) < k, F.array().cast("array<string>")).otherwise(windows(c)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.get(made, F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def safe_int(text: Column) -> Column:
    """A whole number, or 0 for what is none."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def parse_answer(text: Column) -> Column:
    """1 for a text that begins with yes, 0 with no, after thinking is cut out; else null."""
    said = F.lower(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), rf"^{BLANKS}+|{BLANKS}+$", ""))
    return F.when(said.startswith("yes"), 1).when(said.startswith("no"), 0)


def code_blocks(text: Column) -> Column:
    """The fenced blocks of a prompt."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```\w*\n(.*?)\n```"), F.lit(1))


def language_headers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"Code\s+\d+\s+\(language:\s*([^)]+)\)"), F.lit(1))


def markdown_tag(lang: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lower(lang), F.lit("+"), F.lit("p")), F.lit("#"), F.lit("sharp")), F.lit(" "), F.lit(""))


def occurrences(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def is_python(code: Column) -> Column:
    c = F.regexp_replace(code, rf"^{BLANKS}+", "")
    return c.startswith("def ") | (c.contains("def ") & c.contains(":") & ~F.substring_index(c, "def ", 1).contains("{"))


def detect_language(code: Column) -> Column:
    """The language that a snippet's marks tell; null for none. Earlier rules win."""
    c = F.regexp_replace(code, rf"^{BLANKS}+|{BLANKS}+$", "")
    has = lambda *marks: reduce(lambda a, b: a | b, (c.contains(m) for m in marks))
    foreign = ~has("System.") & ~has("java.")
    # fixed values: the marks of each language, in the order in which they are tried
    rules = [
        ("python", has("def ") & has(":") & (occurrences(c, "{") < occurrences(c, "def "))),
        ("python", c.startswith("def ") | (has("self.") & has("def "))),
        ("python", has("elif ", "    pass") & ~has("{")),
        ("cpp", has("#include", "std::", "cout <<", "cin >>")),
        ("cpp", has("::") & foreign),
        ("cpp", has("->") & foreign),
        ("csharp", has("System.Windows", "System.Collections", "System.IO")),
        ("csharp", has("Console.WriteLine", "Console.Write(", "Console.Read")),
        ("csharp", has("using System", "namespace ")),
        ("csharp", has("var ") & has("foreach")),
        ("csharp", has(" bool ") & has("System.") & ~has("java.")),
        ("java", has("System.out", "java.util", "java.awt", "import java")),
        ("java", has("ArrayList<", "HashMap<", "LinkedList<")),
        ("java", has("public boolean", "public int", "public void") & (~has("System.") | has("System.out"))),
        ("java", has("public static", "public class") & ~has("Console.")),
    ]
    return reduce(lambda when, r: when.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))


#: Operators that a tokenizer has split.
SPLIT_OPERATORS = ("+ +", "- -", "+ =", "- =", "* =", "/ =", "% =", "& =", "| =", "^ =", "& &", "| |", "! =", "= =", "< =", "> =", "< <", "> >", "- >", ": :")
WORD = r"[\p{L}\p{N}_]"


def cleanup_rules(python: bool = False) -> list[tuple[str, str]]:
    """(pattern, replacement) in order, without lookaround, for rejoining tokenized code."""
    rules = [(r" ([)\];,])", "$1"), (r"([(\[]) ", "$1"), (rf"({WORD}) \(", "$1("), (r"(\)) \(", "$1("), (rf"({WORD}) \[", "$1["), (r"(\]) \[", "$1[")]
    rules += [(rf"({WORD}) \. ({WORD})", "$1.$2"), (rf"({WORD}) \. \*", "$1.*"), (rf"({WORD}) \+\+", "$1++"), (rf"({WORD}) --", "$1--")]
    escaped = lambda s: "".join(f"\\{x}" if x in "+*|^" else x for x in s)
    rules += [(escaped(op), op.replace(" ", "")) for op in SPLIT_OPERATORS]
    rules += [(r"\{ \}", "{}"), (r"\[ \]", "[]")]
    return rules + ([(" :", ":")] if python else [])


def cleanup(code: Column, python: bool = False) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, *r), cleanup_rules(python), code)


def truncate_lines(text: Column, most: int = 74, marker: str = "// ... <truncated>") -> Column:
    """At most so many lines; the last is a marker where some were cut."""
    parts = lines(text)
    return F.array_join(F.when(F.size(parts) > most, F.concat(F.slice(parts, 1, most - 1), F.array(F.lit(marker)))).otherwise(parts), "\n")


def ascii_only(text: Column) -> Column:
    """Each code point beyond ASCII becomes a blank."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


#: Font sizes by line count, and by step.
FONT_TIERS = ((15, 26), (30, 20), (45, 16))
SMALLEST_FONT, FONT_WIDTH = 13, 100
FONT_STEPS = (24, 22, 20, 18, 16, 14, 12, 11, 10, 9)


def pick_font(n_lines: Column, max_chars: Column, limit: int = FONT_WIDTH) -> Column:
    """The font size of a tier of line counts, a tier smaller for wide code."""
    sizes = [size for _, size in FONT_TIERS] + [SMALLEST_FONT]
    choose = lambda shift: reduce(lambda c, t: c.when(n_lines <= FONT_TIERS[t][0], sizes[t + shift]), range(1, len(FONT_TIERS)), F.when(n_lines <= FONT_TIERS[0][0], sizes[shift])).otherwise(SMALLEST_FONT)
    return F.when(max_chars > limit, choose(1)).otherwise(choose(0))


def pick_font_size(n_lines: Column, max_chars: Column, canvas: float = 1220.0, factor: float = 0.8, most: int = 45) -> Column:
    """struct(size, truncated): the smaller of the sizes by lines and by width, within 10 and 24."""
    by_lines = F.when(n_lines <= 15, 24).when(n_lines <= 30, 18).when(n_lines <= 45, 14).otherwise(12)
    by_width = F.least(F.floor(canvas / (F.greatest(max_chars, F.lit(1)) * factor)).cast("int"), F.lit(24))
    size = F.greatest(F.least(by_lines, by_width), F.lit(10))
    return F.struct(size.alias("size"), ((n_lines > most) & (size <= 12)).alias("truncated"))


def fit_font(n_lines: Column, max_chars: Column, pad: int = 48, wide: float = 0.8, high: float = 1.6) -> Column:
    """The first step that fits the landscape canvas, else the portrait one, else the smallest."""
    fits = lambda w, h: [F.when((n_lines * high * s + pad <= h) & (max_chars * wide * s + pad <= w), s) for s in FONT_STEPS]
    return F.coalesce(*fits(1120, 896), *fits(896, 1120), F.lit(FONT_STEPS[-1]))


def slug(l1: Column, l2: Column) -> Column:
    """The name of a language pair on disk: only the first has its plus signs turned."""
    return F.concat_ws("_", F.replace(F.lower(l1), F.lit("+"), F.lit("p")), F.lower(l2))


def extension(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def file_numbers(path: Column) -> Column:
    """The runs of digits in a file's name."""
    return F.regexp_extract_all(F.substring_index(path, "/", -1), F.lit("[0-9]+"), F.lit(0))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_numbering(line: Column) -> Column:
    """A line without a leading list number from 1 to 10 and without its first code fence."""
    return F.regexp_replace(F.regexp_replace(line, r"^(?:10|[1-9])[.):]", ""), r"^([^`]*(?:`(?!``)[^`]*)*)```(?:cpp|c\+\+|c\b)?", "$1")


def split_fragments(text: Column, python: bool = False) -> Column:
    """struct(first, second): two functions of a file, cut at the second def or at the first empty line."""
    parts = lines(text)
    marks = F.transform(parts, (lambda x: x.startswith("def ")) if python else (lambda x: F.trim(x) == ""))
    if python:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1))), lambda i: F.coalesce(F.get(marks, i - 1), F.lit(False)))
        at = F.coalesce(F.get(places, F.lit(1)), F.size(parts) + 1)
        skip = 0
    else:
        found = F.array_position(marks, F.lit(True)).cast("int")
        at, skip = F.when(found == 0, F.size(parts) + 1).otherwise(found), 1
    tail = F.slice(parts, F.least(at + skip, F.size(parts) + 1), F.greatest(F.size(parts) - at - skip + 1, F.lit(0)))
    return F.struct(F.array_join(F.slice(parts, 1, at - 1), "\n").alias("first"), F.array_join(tail, "\n").alias("second"))


def insertion_point(text: Column) -> Column:
    """struct(line, indent): after the first line that opens a class body, else line 0; the indent of what follows."""
    parts = lines(text)
    opens = F.transform(parts, lambda x: x.rlike(r"\bclass\b") & x.rlike(r"[{:]\s*$"))
    line = F.array_position(opens, F.lit(True)).cast("int")
    return F.struct(line.alias("line"), F.length(F.regexp_extract(F.coalesce(F.get(parts, line), F.lit("")), r"^([ \t]*)", 1)).alias("indent"))


def insert_at(text: Column, line: Column, value: Column) -> Column:
    """A text with a value put in after so many lines."""
    parts = lines(text)
    return F.array_join(F.concat(F.slice(parts, 1, line), F.array(value), F.slice(parts, line + 1, F.size(parts))), "\n")


def literal_to_json(text: Column) -> Column:
    """A printed dict as JSON: quotes turned, True, False and None rewritten."""
    out = F.replace(text, F.lit("'"), F.lit('"'))
    for a, b in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null")):
        out = F.regexp_replace(out, a, b)
    return out
