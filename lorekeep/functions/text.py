"""Column functions on ids, names, titles and texts; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default tokens: runs of ASCII letters and digits, case kept.
TOKEN = r"[A-Za-z0-9]+"
#: Tokens of any script: runs of letters, marks and digits, and every Chinese or Japanese character by itself.
TOKEN_ANY = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[\p{L}\p{M}\p{Nd}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"
UNKNOWN_YEAR = "未知"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# Patterns of ids, file names and labels below are fixed values: their results must match ids and files that exist.


def normalize_paper_id(raw: Column) -> Column:
    """Drops a leading "arXiv:", a version at the end, all slashes, then white space at the ends, in this order."""
    c = F.regexp_replace(raw, r"(?i)^arXiv:", "")
    c = F.regexp_replace(c, r"v\d+$", "")
    return stripped(F.replace(c, F.lit("/"), F.lit("")))


def is_modern_id(paper_id: Column) -> Column:
    """YYMM.NNNN or YYMM.NNNNN."""
    return paper_id.rlike(r"^\d{4}\.\d{4,5}$")


def safe_filename(title: Column, paper_id: Column) -> Column:
    """{id}_{title without characters that file systems refuse, 80 at most}_{6 hex digits of the title's MD5}.pdf"""
    safe = F.regexp_replace(title, r'[<>:"/\\|?*]', "")
    safe = F.substring(F.regexp_replace(safe, r"^[. ]+|[. ]+$", ""), 1, 80)
    return F.concat(paper_id, F.lit("_"), F.when(safe == "", paper_id).otherwise(safe), F.lit("_"), F.substring(F.md5(title.cast("binary")), 1, 6), F.lit(".pdf"))


def authors_display(authors: Column) -> Column:
    """The first three, then "et al." if there are more."""
    return F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))


def published(year: Column) -> Column:
    return F.when(year.isNotNull() & (year != 0), year.cast("string")).otherwise(UNKNOWN_YEAR)


def paper_label(title: Column, year_text: Column) -> Column:
    return F.concat(F.substring(title, 1, 60), F.lit("... ("), year_text, F.lit(")"))


def short_title(title: Column) -> Column:
    """Titles of more than 80 characters end in an ellipsis after 77."""
    return F.when(F.length(title) > 80, F.concat(F.substring(title, 1, 77), F.lit("..."))).otherwise(title)


def citation(number: Column, source: Column, title: Column) -> Column:
    return F.format_string("%d. [%s] %s", number, source, short_title(title))


def without_txt(c: Column) -> Column:
    return F.replace(c, F.lit(".txt"), F.lit(""))


def tokens(text: Column, pattern: str | Callable[[Column], Column] = TOKEN) -> Column:
    """array<string>: what a pattern finds, or what a tokenizer (functions/segment.py) makes of a text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if isinstance(pattern, str) else pattern(text)


def similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def retry_delay(attempt: Column, limited: Column) -> Column:
    """Seconds before the next attempt (attempts count from 0): 5 (n + 1) when the server says 429, else 2^n."""
    return F.when(limited, 5 * (attempt + 1)).otherwise(F.pow(F.lit(2), attempt)).cast("int")


def statements(sql: Column) -> Column:
    """Parts between semicolons, stripped, blank ones left out. Semicolons within literals cut too."""
    return F.filter(F.transform(F.split(sql, ";"), stripped), lambda s: s != "")


def or_default(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def pair_structs(history: Column) -> Column:
    """array<struct<u, a>> of a history given as lists of two; missing parts are null."""
    return F.transform(history, lambda h: F.struct(F.get(h, 0).alias("u"), F.get(h, 1).alias("a")))


def suffix(path: Column) -> Column:
    """The extension with its dot, or an empty string."""
    return F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1)


def default_of(values: Column, key: str, default: str) -> Column:
    """The value of a key in a map, or the default."""
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(default))
