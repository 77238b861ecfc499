"""Chat records from pairs: a message builder for each mode, and their fan-out.

A message's content is text or parts; content_text and content_parts are two columns, one of them null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text

# fixed values: the instruction, the modes with their images, and the image sentinel
INSTRUCTION = 'Determine whether the following two code snippets implement the same functionality, regardless of the programming language used. Answer with only "Yes" or "No".'
SYSTEM = "You are a code analysis assistant. Determine functional equivalence of code snippets across programming languages."
MODES = {"b1": "none", "b1ctrl": "black", "b2": "paths", "b3": "paths"}
BLACK = "__black__"

MESSAGE = "struct<role:string,content_text:string,content_parts:array<struct<type:string,text:string>>>"


def answer(label: Column) -> Column:
    return F.when(label == 1, "Yes").otherwise("No")


def fenced(lang: Column, code: Column) -> Column:
    return F.concat(F.lit("```"), F.lower(lang), F.lit("\n"), code, F.lit("\n```"))


def header(n: int, lang: Column) -> Column:
    return F.concat(F.lit(f"Code {n} (language: "), lang, F.lit("):"))


def user_text(l1: Column, c1: Column, l2: Column, c2: Column, lead: str = INSTRUCTION) -> Column:
    """One text with both snippets."""
    return F.concat(F.lit(lead + "\n\n"), header(1, l1), F.lit("\n"), fenced(l1, c1), F.lit("\n\n"), header(2, l2), F.lit("\n"), fenced(l2, c2), F.lit("\n\nAnswer:"))


def user_parts(l1: Column, c1: Column | None, l2: Column, c2: Column | None, lead: str = INSTRUCTION) -> Column:
    """Text and image parts; without code the images stand alone."""
    said = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    between = F.concat(F.lit("\n\n") if c1 is None else F.concat(fenced(l1, c1), F.lit("\n\n")), header(2, l2))
    last = F.lit("\n\nAnswer:") if c2 is None else F.concat(fenced(l2, c2), F.lit("\n\nAnswer:"))
    return F.array(said(F.concat(F.lit(lead + "\n\n"), header(1, l1))), image, said(between), image, said(last))


def message(role: str, said: Column | None = None, parts: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(role).alias("role"), (said if said is not None else none.cast("string")).alias("content_text"), (parts if parts is not None else none.cast("array<struct<type:string,text:string>>")).alias("content_parts"))


def messages(mode: str, l1: Column, c1: Column, l2: Column, c2: Column, label: Column) -> Column:
    user = message("user", user_text(l1, c1, l2, c2)) if mode == "b1" else message("user", parts=user_parts(l1, None if mode == "b3" else c1, l2, None if mode == "b3" else c2))
    return F.array(message("system", F.lit(SYSTEM)), user, message("assistant", answer(label)))


def chat_records(pairs: DataFrame) -> DataFrame:
    """A record for each mode of (pair_id, label, neg_type, lang1, code1, lang2, code2, image1, image2)."""
    c = F.col
    built = F.array(*[F.struct(F.lit(m).alias("mode"), messages(m, c("lang1"), c("code1"), c("lang2"), c("code2"), c("label")).alias("messages")) for m in MODES])
    images = F.when(c("m.mode") == "b1", F.lit(None)).when(c("m.mode") == "b1ctrl", F.array(F.lit(BLACK), F.lit(BLACK))).otherwise(F.array("image1", "image2"))
    return pairs.withColumn("m", F.explode(built)).select(c("m.mode").alias("mode"), "pair_id", "label", "neg_type", answer(c("label")).alias("answer"), F.concat_ws("_", F.lower("lang1"), F.lower("lang2")).alias("lang_pair"), c("m.messages").alias("messages"), images.alias("image_paths"))


def plain(content_text: Column, content_parts: Column) -> Column:
    """The text of a message, image parts left out."""
    return F.coalesce(content_text, F.array_join(F.transform(F.filter(content_parts, lambda p: p["type"] == "text"), lambda p: p["text"]), ""))


def without_answer(said: Column) -> Column:
    """Messages before the assistant speaks."""
    return F.filter(said, lambda m: m["role"] != "assistant")


def rebuilt(said: Column, lead: str) -> Column:
    """A user text with another lead; texts without two snippets stay as they are."""
    langs, codes = text.language_headers(said), text.code_blocks(said)
    one = lambda n: F.concat(header(n, F.get(langs, F.lit(n - 1))), F.lit("\n```"), text.markdown_tag(F.get(langs, F.lit(n - 1))), F.lit("\n"), F.get(codes, F.lit(n - 1)), F.lit("\n```"))
    return F.when((F.size(langs) >= 2) & (F.size(codes) >= 2), F.concat(F.lit(lead + "\n\n"), one(1), F.lit("\n\n"), one(2), F.lit("\n\nAnswer:"))).otherwise(said)
