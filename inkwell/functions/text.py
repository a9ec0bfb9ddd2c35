"""Text features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(t: Column) -> Column:
    """Lower case; letters, digits, underscores and white space stay (Devanagari whole); one space between words."""
    kept = F.regexp_replace(F.lower(t), r"(?U)[^\w\sऀ-ॿ]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def script_of(t: Column) -> Column:
    """devanagari if it has more Devanagari letters than ASCII ones, else latin."""
    count = lambda cls: F.char_length(F.regexp_replace(t, f"[^{cls}]", ""))
    return F.when(count(r"ऀ-ॿ") > count("A-Za-z"), "devanagari").otherwise("latin")


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def cer(text: Column, prompt: Column) -> Column:
    """Character edit distance over the prompt's length."""
    return F.levenshtein(text, prompt) / F.greatest(F.char_length(prompt), F.lit(1))


def mid_word_capitals(t: Column) -> Column:
    """Words with a capital after their first letter."""
    return F.size(F.filter(words(t), lambda w: F.regexp_replace(w, "[^A-Za-z]", "").rlike("^.+[A-Z]")))


def inner_periods(t: Column) -> Column:
    """Words with a period before their last character."""
    return F.size(F.filter(words(t), lambda w: w.rlike(r"\..")))


def adjacent_duplicates(t: Column) -> Column:
    """Words equal to the next, case folded."""
    w = words(F.lower(t))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.size(F.filter(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: a == b), lambda x: x))


def task_group(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("copy"), "copy").when(n.contains("dictat"), "dictated").when(n.contains("own") | n.contains("custom") | n.contains("free"), "own").otherwise("other")


def first_object(t: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(t, r"(?s)\{.*\}", 0)


#: White space by name, which engines agree on.
SPACE = r"[ \t\n\r\f\x0B]"


def cleaned(t: Column, lower: bool = True) -> Column:
    """Letters, marks, digits, underscores and white space stay, one space between words."""
    kept = F.regexp_replace(F.lower(t) if lower else t, r"[^\p{L}\p{M}\p{N}_ \t\n\r\f\x0B]", "")
    return F.trim(F.regexp_replace(kept, f"{SPACE}+", " "))


def plain_words(t: Column) -> Column:
    return F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")


def sentence_marks(t: Column) -> tuple[Column, Column]:
    """Whether the first letter is not a capital, and whether the last character is no full stop."""
    s = F.trim(t)
    return (~F.substring(s, 1, 1).rlike("^[A-Z]")).cast("int"), (~F.coalesce(s.endswith("."), F.lit(False))).cast("int")


def merged_words(t: Column, prompt: Column) -> Column:
    """Neighbouring words of the prompt that some word of t holds written as one."""
    w, p = plain_words(F.lower(t)), plain_words(F.lower(prompt))
    n = F.greatest(F.size(p) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda q: F.exists(w, lambda x: x.contains(q))))


def split_words(t: Column, prompt: Column) -> Column:
    """Words of t of at most two characters that stand within a word of the prompt."""
    w, p = plain_words(F.lower(t)), plain_words(F.lower(prompt))
    return F.size(F.filter(w, lambda x: (F.char_length(x) <= 2) & F.exists(p, lambda q: q.contains(x))))


def reading_or_blank(t: Column, measures: dict[str, Column], blank: dict[str, float | None]) -> list[Column]:
    """The measures of a transcript, and where it has no word or is null those of a blank one."""
    none = F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), SPACE, " ")) == ""
    return [F.when(none, F.lit(blank[k]).cast("double")).otherwise(v.cast("double")).alias(k) for k, v in measures.items()]


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def sigmoid(x: Column, limit: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))


def x_height(heights: Column, box: Column, lines: Column) -> Column:
    """Median of the heights above 5, else 0.45 of a line's share of the box, at least 15."""
    tall = F.array_sort(F.filter(heights, lambda h: h > 5))
    n = F.size(tall)
    middle = (F.get(tall, F.floor((n - 1) / 2).cast("int")) + F.get(tall, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle).otherwise(F.greatest(F.lit(15.0), box / F.greatest(lines, F.lit(1)) * 0.45))


def guarded(value: Column, scale: Column, least: float) -> Column:
    """value over scale where scale is above `least`, else 0."""
    return F.when(scale > least, value / scale).otherwise(0.0)
