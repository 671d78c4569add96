"""What is left of an answer without sentences that only say what the evidence lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vergence.operators.routing import DISCLAIMER, SENTENCE

# Marks of citations, what has substance, and words that alone, or at the start, say that the evidence doesn't cover it.
CITATION, SUBSTANCE = "\\[[0-9]+\\]", "[0-9A-Za-z一-鿿]"
BARE = (
    "未覆盖|未涉及|未提供|未收录|尚未收录|未说明|未提及|未给出|未列明|未包含|不包含|无法(?:回答|提供|确认|给出)|没有(?:提及|提供|说明|相关)|暂无(?:相关信息|相关答案|信息|答案)?|无(?:相关|答案|记录)"
)
#: What a sentence loses before its words are compared: all but letters, digits and underscores.
NO_WORD = "[^\\p{L}\\p{N}_]+"


def _sentences(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(SENTENCE), F.lit(0))


def _words(sentence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sentence, CITATION, ""), NO_WORD, "")


def without_disclaimers(answer: Column) -> Column:
    """The answer without disclaimers and without sentences of nothing but such words; '' where only marks are left.

    An answer of which '' is left is a refusal.  Null stays null."""
    kept = F.filter(_sentences(answer), lambda s: ~s.rlike(DISCLAIMER) & ~_words(s).rlike(f"^(?:{BARE})$"))
    left = F.regexp_replace(F.array_join(kept, ""), "^\\s+|\\s+$", "")
    return F.when(F.regexp_replace(left, CITATION, "").rlike(SUBSTANCE), left).when(answer.isNotNull(), "")


def closes_gap(answer: Column) -> Column:
    """Some sentence has substance and is no disclaimer, not even one that begins with the missing coverage."""
    says = lambda s: ~s.rlike(DISCLAIMER) & ~_words(s).rlike(f"^(?:{BARE})") & F.regexp_replace(s, CITATION, "").rlike(SUBSTANCE)
    return F.exists(_sentences(answer), says)
