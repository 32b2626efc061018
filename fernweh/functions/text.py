"""Text as column expressions: folding, words, identifiers, stems, white space."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def _latin() -> tuple[str, str]:
    """Letters of the Latin blocks with a canonical decomposition, and their base letters."""
    src, dst = "", ""
    for o in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(o)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0].isascii() and d[0].isalpha():
            src, dst = src + c, dst + d[0]
    return src, dst


ACCENTED, BASE = _latin()
_WORD = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without the accents of Latin letters; composed or followed by combining marks."""
    bare = F.regexp_replace(text, r"(?<=[A-Za-z])[\x{300}-\x{36F}]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.lower(F.translate(bare, ACCENTED, BASE))).otherwise(F.lower(text))  # most texts have nothing to fold but case


def fold_py(text: str) -> str:
    text = re.sub(r"(?<=[A-Za-z])[̀-ͯ]+", "", unicodedata.normalize("NFC", text))
    return text.translate(str.maketrans(ACCENTED, BASE)).lower()


def terms(text: Column, most: int = 1024) -> Column:
    """Distinct folded words."""
    return F.filter(F.array_distinct(F.regexp_extract_all(fold(text), F.lit(_WORD), 0)), lambda w: F.length(w) <= most)


def terms_among(text: Column, words: list[str], prefixes: list[str] = (), most: int = 1024) -> Column:
    """The distinct folded words of a text that are among these, or begin so; words are folded ones."""
    each = [re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))] + [re.escape(p) + r"[\p{L}\p{N}]*" for p in prefixes]
    if not each:
        return F.array().cast("array<string>")
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(each)})(?![\p{{L}}\p{{N}}])"
    return F.filter(F.array_distinct(F.regexp_extract_all(fold(text), F.lit(pattern), 0)), lambda w: F.length(w) <= most)


def is_long_word(term: Column) -> Column:
    return term.rlike("^[a-z0-9]{32,64}$")


def split_identifier(s: Column) -> Column:
    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        s = F.regexp_replace(s, pattern, "$1 $2")
    return F.filter(F.split(s, r"[^\p{L}\p{N}]+"), lambda p: p != "")


def name_tokens(name: Column) -> Column:
    """Words of a file name and the parts of its compound words, once each, in order."""
    words = F.filter(F.split(name, r"[^\p{L}\p{N}]+"), lambda p: p != "")
    each = F.transform(words, lambda p: F.concat(F.array(p), F.when(F.size(split_identifier(p)) > 1, split_identifier(p)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.flatten(each))


def stem(w: Column) -> Column:
    """Cuts English endings of words without digits that leave enough of a word."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(w.rlike(r"\d"), w).when(w.endswith("ies") & (n >= 6), cut(3)).when(w.endswith("ing") & (n >= 7), cut(3)).when(w.endswith("ed") & (n >= 6), cut(2))
        .when(w.endswith("es") & (n >= 6), cut(2)).when(w.endswith("s") & ~w.endswith("ss") & (n >= 5), cut(1)).otherwise(w)
    )


def smart_case(pattern: str) -> bool:
    """Case counts only if the pattern has an upper-case letter."""
    return any(c.isupper() for c in pattern)


def tidy(text: Column) -> Column:
    """Unix line ends, no blanks at line ends, at most one empty line in a row."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"^[\s&&[^\f]]+", ""), r"[\s&&[^\f]]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, r"[\n\f]", -1)


def title_of(name: Column) -> Column:
    """A file's title: its name without the last extension and marks of copies."""
    stem_ = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")
    return F.trim(F.regexp_replace(stem_, r"(?i)(?:\s*\(\d+\)|[\s_-]+copy(?:\s*\d+)?)$", ""))


def has_words(text: Column) -> Column:
    """Whether letters make up a fifth of the characters that aren't blank."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    others = F.length(F.regexp_replace(text, r"[\p{L}\s]", ""))
    return (letters > 0) & (letters * 4 >= others)


def redact_keys(text: Column) -> Column:
    """Private keys in armour are replaced by a mark."""
    return F.regexp_replace(text, r"(?s)-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----.*?(?:-----END \1PRIVATE KEY-----|$)", "[private key removed]")


def osa(a: str, b: str, most: int) -> int:
    """Edits that turn a into b, a swap of neighbours being one and no part edited twice; most + 1 when there are more than most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


@F.pandas_udf(IntegerType())
def osa_udf(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y, int(m)) for x, y, m in zip(a, b, most)], dtype="Int32")


def within_edits(a: Column, b: Column, most: Column) -> Column:
    """osa(a, b) <= most: a plain distance in the JVM, which no swap can more than double, spares most pairs the exact test."""
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= 2 * most) & (osa_udf(a, b, most) <= most)


def allowed_edits(term: Column) -> Column:
    n = F.length(term)
    return F.when(n >= 8, 2).when(n >= 4, 1).otherwise(0)
