"""Text functions as columns. Patterns are Java's; ``(?U)`` makes \\s, \\d and \\b Unicode."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Patterns, word lists and formats that results depend on.
LETTERS = ("A", "B", "C", "D", "E")
ANSWER = r"(?iU)(?:reference answer|参考答案)\s*[:：]?\s*([A-Ga-g]+)"
ANSWER_ZH = r"(?U)参考答案\s*[:：]\s*([A-Ga-g]+)"
OPTION_SPLIT = r"(?U)(?:^|\s)([A-G])[\.．、]\s*"
OPTION_AUDIT = r"(?U)(?:^|\s)([A-G])[\.．、]\s"
OPTION_LOOSE = r"(?U)(?:^|[\s　])([A-G])\s*[\.．、:：\)）]"
OPTION_PAREN = r"(?U)[\(（]\s*([A-G])\s*[\)）]"
OPTION_STRICT_ZH = r"(?U)(?:^|\s)([A-E])[\.．、]\s*"
OPTION_LENIENT_ZH = r"(?<![A-Za-z0-9])([A-E])[\.．、]"
OPTION_LINE = r"(?U)^\s*([A-H])(?:\s+|\s*[\.．、:：]\s*)(.*)$"
SHARED = r"(?iu)(?U)[\[【]\s*(?:shared\s+(?:questions?(?:\s+stem)?|stem|topic|title)|共享题干|共用题干)\s*[\]】]|共用题干"
QUESTION_TYPE = r"(?iU)\[\s*(?:single|multiple|multi)[\s-]*choices?(?:\s+questions?)?\s*\]"
CJK = r"[一-鿿]"
NUMBER = r"(?U)\d+(?:\.\d+)?"
WORD = r"[a-z0-9]+"
FEATURES = {
    "catch_all": r"(?iU)all of the above|none of the above|both .+ and |以上",
    "absolute": r"(?iU)\b(always|never|all|only|must|no|entirely|completely)\b",
    "hedge": r"(?iU)\b(may|can|usually|often|generally|sometimes|possible|likely)\b",
    "numeric": r"(?U)\d",
}
NEGATION = r"(?iU)\b(not|without|cannot|none|except)\b"
FLAGS = {**FEATURES, "negation": NEGATION}
LEAKS = (
    ("watermark_edu", r"(?i)浩翔教育|Haoxiang"),
    ("watermark_qq", r"(?iU)qq\s*[:：]?\s*\d{6,}"),
    ("exam_paper_hdr", r"真题试卷|真题及精解|模拟试卷"),
    ("unit_header", r"(?U)^Unit\s+\d|第[一二三四五六七八九十]+单元"),
    ("page_marker", r"(?U)##########|页码\s*\d+"),
    ("platform_ad", r"一体化职业考试学习平台|网校课程"),
)


def trim_ws(s: Column) -> Column:
    """Strip all Unicode white space, not only spaces."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def norm(s: Column) -> Column:
    """Collapse white space and strip."""
    return trim_ws(F.regexp_replace(s, r"(?U)\s+", " "))


def norm_lower(s: Column) -> Column:
    return F.lower(norm(s))


def matches(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def found(s: Column, pattern: str, group: int = 0) -> Column:
    """All matches, as an array."""
    return F.regexp_extract_all(s, F.lit(pattern), group)


def first(s: Column, pattern: str, group: int = 1) -> Column:
    """The first match, null where there is none."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def normalize_answer(s: Column) -> Column:
    return F.regexp_replace(F.upper(s), "[^A-Z]", "")


def extract_letter(reply: Column) -> Column:
    """The letter that a reply gives: the first word-bounded A-E, else null."""
    return first(F.upper(trim_ws(reply)), r"(?U)\b([A-E])\b")


def yes_no(reply: Column) -> Column:
    return F.when(F.startswith(F.upper(trim_ws(reply)), F.lit("YES")), "YES").otherwise("NO")


def first_named(s: Column, table: tuple[tuple[str, str], ...] = LEAKS) -> Column:
    """Name of the first pattern that matches, in the table's order."""
    out = F
    for name, pattern in table:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise(None)


def tokens(s: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(found(F.lower(s), WORD))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def hash_id(s: Column, chars: int = 16) -> Column:
    return F.substring(F.sha2(s, 256), 1, chars)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def numbers(s: Column, n: int = 8) -> Column:
    return F.slice(found(s, NUMBER), 1, n)


def letter_at(i: Column) -> Column:
    """Letter of a zero-based index."""
    return F.element_at(F.array(*map(F.lit, LETTERS)), (i + 1).cast("int"))
