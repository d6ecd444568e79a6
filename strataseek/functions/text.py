"""Text functions as Column expressions, and the query tokenizer of the driver."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a keyword query doesn't look for.
STOPWORDS = (
    "a an and are as at be been being but by can class const could did do does else export for function had has "
    "have how i if import in interface is it its let no not of on or return should that the then these this those "
    "to us var was we were what when where which who why will with would you your"
).split()
WORD = "[A-Za-z0-9_]+"
MIN_WORD = 2
LONG_NAME = 12

# Languages by extension; of the text kinds the extension is the name.
CODE_LANGUAGES = {
    "typescript": "ts", "tsx": "tsx", "javascript": "js jsx mjs cjs", "rust": "rs", "python": "py", "go": "go", "java": "java",
    "ruby": "rb", "c": "c h", "cpp": "cpp cc cxx hpp hh", "php": "php",
}
TEXT_LANGUAGES = "json md html css scss sh bash zsh yml yaml toml sql txt env conf".split()
LANGUAGE_OF = {ext: lang for lang, exts in CODE_LANGUAGES.items() for ext in exts.split()} | {x: x for x in TEXT_LANGUAGES}


class Query(NamedTuple):
    tokens: list[str]
    literals: list[str]


def is_literal(word: str) -> bool:
    """A word that looks like an identifier: an underscore, capital or digit, or long."""
    return bool(re.search("[A-Z0-9_]", word)) or len(word) > LONG_NAME


def tokenize(text: str | None) -> Query:
    """Tokens and literals of a search text, each once, in order. Literals are picked
    before stop words are dropped, so a capitalised stop word is one."""
    words = [w for w in re.findall(WORD, text or "", re.ASCII) if len(w) >= MIN_WORD]
    literals = [w.lower() for w in words if is_literal(w)]
    tokens = [w.lower() for w in words if w.lower() not in STOPWORDS]
    return Query(list(dict.fromkeys(tokens)), list(dict.fromkeys(literals)))


def words(col: Column) -> Column:
    """All words of a text in lower case, short ones and stop words too."""
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9_]+"), F.lit(0))


def tokens(col: Column) -> Column:
    """The tokens of a text, as ``tokenize`` gives them."""
    kept = F.filter(F.regexp_extract_all(col, F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= MIN_WORD)
    low = F.transform(kept, F.lower)
    return F.array_distinct(F.filter(low, lambda w: ~w.isin(STOPWORDS)))


def literals(col: Column) -> Column:
    kept = F.filter(
        F.regexp_extract_all(col, F.lit(WORD), F.lit(0)),
        lambda w: (F.length(w) >= MIN_WORD) & (w.rlike("[A-Z0-9_]") | (F.length(w) > LONG_NAME)),
    )
    return F.array_distinct(F.transform(kept, F.lower))


def language(path: Column) -> Column:
    """Language of a path by the part behind its last dot, case-sensitive; null if unknown
    or without a dot."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(known, F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1)))


def js_trim(col: Column) -> Column:
    """Without white space at both ends: all separators, line ends and the byte-order mark."""
    space = r"[\t\n\x0B\f\r\p{Z}﻿]+"
    return F.regexp_replace(F.regexp_replace(col, "^" + space, ""), space + "$", "")


def holds(col: Column, text: str, match: str = "contains") -> Column:
    """Whether a text holds another, in any case. ``like``: % and _ in it are wildcards."""
    if match == "like":
        pattern = "%" + text.lower().replace("\\", "\\\\") + "%"
        return F.lower(col).like(pattern)
    return F.contains(F.lower(col), F.lit(text.lower()))


def occurrences(col: Column, text: str) -> Column:
    """Places of a text that don't overlap, in any case."""
    low = F.lower(col)
    return ((F.length(low) - F.length(F.replace(low, F.lit(text.lower()), F.lit("")))) / len(text)).cast("int") if text else F.lit(0)


def glob_to_like(glob: str) -> str:
    return glob.replace("*", "%")


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def preview(col: Column, most: int = 800) -> Column:
    cut = F.substring(col, 1, most)
    return F.when(F.length(col) > most, F.concat(cut, F.lit("\n... (truncated)"))).otherwise(cut)


def one_line(col: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(col, r"\s+", " "), 1, most)
