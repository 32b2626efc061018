"""Query data to Spark conditions: filters, patterns of the query language in the JVM's dialect, required literals."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fernweh.functions import paths, text
from fernweh.plans.query import Filters, Query

_SPACE = r"[ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_LN = r"[\p{L}\p{N}]"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of the query language as the JVM reads it: word boundaries are ASCII, white space is Unicode's, [^] is anything."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two == "\\u" and (m := re.match(r"\\u\{([0-9a-fA-F]+)\}", pattern[i:])):
            out.append(rf"\x{{{m[1]}}}")
            i += m.end()
            continue
        if c == "\\":
            swap = {"\\s": _SPACE if not in_class else _SPACE[1:-1], "\\S": f"[^{_SPACE[1:-1]}]" if not in_class else "\\S", "\\b": _BOUNDARY if not in_class else "\\x08", "\\B": f"(?!{_BOUNDARY})", "\\/": "/"}
            out.append(swap.get(two, two))
            i += 2
            continue
        if not in_class and pattern.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 3
            continue
        if not in_class and two == "[]":
            out.append("(?!)")
            i += 2
            continue
        in_class = (c == "[" or in_class) and c != "]"
        out.append(r"\[" if c == "[" and out and in_class and pattern[:i].count("[") and _open_class(pattern, i) else c)
        i += 1
    return ("(?miu)" if ignore_case else "(?m)") + "".join(out)


def _open_class(pattern: str, at: int) -> bool:
    """Whether a class is open at this position."""
    inside, i = False, 0
    while i < at:
        if pattern[i] == "\\":
            i += 2
            continue
        inside = (pattern[i] == "[" or inside) and pattern[i] != "]"
        i += 1
    return inside


def literals(pattern: str, least: int = 2) -> list[str]:
    """Strings every match of the pattern holds: runs of plain characters outside groups, alternatives and repetition that may be zero."""
    if "|" in pattern or re.search(r"\(\?[!<]", pattern):
        pattern = "" if "|" in re.sub(r"\((?:[^()\\]|\\.)*\)", "", pattern) else re.sub(r"\((?:[^()\\]|\\.)*\)[*+?]?(?:\{[^}]*\})?", "\0", pattern)
    out, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        unit, end = None, i + 1
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            unit, end = (nxt if nxt and not nxt.isalnum() else None), i + 2
        elif c == "[":
            m = re.match(r"\[(?:[^\]\\]|\\.)*\]", pattern[i:])
            end = i + (m.end() if m else 1)
        elif c == "(":
            depth = 0
            for j in range(i, len(pattern)):
                depth += {"(": 1, ")": -1}.get(pattern[j], 0)
                if not depth:
                    break
            end = j + 1
        elif c not in ".^$*+?{}|)\0":
            unit = c
        more = re.match(r"[*?]|\{0?,|\{0\}|\+|\{\d+(?:,\d*)?\}", pattern[end:])
        if unit is None or more and more[0][0] in "*?" or more and more[0].startswith("{0"):
            out, run = [*out, run], ""
        else:
            run += unit
            if more:
                out, run = [*out, run], ""
        i = end + (more.end() if more else 0)
        if more and re.match(r"\{", more[0]) and "}" not in more[0]:
            i = pattern.find("}", i) + 1 or len(pattern)
    return [x for x in [*out, run] if len(x) >= least]


def passes(f: Filters, home: str = "/home/u") -> Column:
    """The filters as one condition over the catalog."""
    conds: list[Column] = []
    col = F.col
    if f.exts is not None:
        conds.append(col("ext").isin(sorted(f.exts)))
    if f.kinds is not None:
        conds.append(col("kind").isin(sorted(f.kinds)))
    if f.not_kinds is not None:
        conds.append(~col("kind").isin(sorted(f.not_kinds)))
    if f.within:
        conds.append(reduce(Column.__or__, [paths.under(col("path"), p) for p in f.within]))
    low = F.lower(paths.display(col("path"), home))
    conds += [low.contains(p) for p in f.path_has]
    for name, lo, hi in (("size", f.size_min, f.size_max), ("mtime", f.mtime_min, f.mtime_max), ("created", f.created_min, f.created_max)):
        if lo is not None:
            conds.append(col(name) >= F.lit(int(-(-lo // 1))))
        if hi is not None:
            conds.append(col(name) <= hi if name == "size" else col(name) < F.lit(int(-(-hi // 1))))
    tags = F.transform(F.split(F.coalesce(F.get_json_object("metadata", "$.tags"), F.lit("")), "\n"), lambda t: F.lower(t))
    conds += [F.array_contains(tags, t.lower()) for t in f.tags]
    conds += [paths.base(col("path")).rlike(java_regex(p, "i" in flags)) for p, flags in f.names]
    conds += [~passes(n, home) for n in f.nots]
    return reduce(Column.__and__, conds) if conds else F.lit(True)


def case_matters(q: Query) -> bool:
    shown = q.text if q.regex else q.text.replace('"', "")
    return "i" not in q.flags and q.case is not False and (q.case is True or text.smart_case(shown))


def pattern_of(q: Query) -> str:
    """The query's text as one pattern: literal, regex, any of its words, or its words near each other."""
    quote = lambda s: re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", s)
    if q.near is not None and len(q.words) > 1:
        source = rf"(?:[^\p{{L}}\p{{N}}]+{_LN}+){{0,{q.near}}}[^\p{{L}}\p{{N}}]+".join(quote(w) for w in q.words)
    elif q.regex:
        source = q.text
    elif q.all:
        source = "|".join(quote(w) for w in (*q.words, *q.phrases))
    else:
        source = quote(q.text.replace('"', ""))
    if q.word:
        source = rf"(?<!{_LN})(?:{source})(?!{_LN})"
    return java_regex(source, not case_matters(q))


class Matcher:
    """Conditions and counts of a query's text over any string column."""

    def __init__(self, q: Query):
        self.q = q
        self.sensitive = case_matters(q)
        self.folded = q.diacritics is False and not q.regex
        self.plain = not (q.regex or q.near is not None or q.word or q.all)
        self.pattern = pattern_of(q)
        if self.folded:
            self.pattern = java_regex(text.fold_py(re.sub(r"^\(\?miu?\)|^\(\?m\)", "", self.pattern)), False) if self.plain else text.fold_py(self.pattern)

    def view(self, column: Column) -> Column:
        return text.fold(column) if self.folded else column

    def literal(self) -> str:
        lit = self.q.text.replace('"', "")
        return text.fold_py(lit) if self.folded else lit

    def matches(self, column: Column) -> Column:
        """Cheap tests that Parquet or the JVM can do on bytes come before the pattern."""
        v = self.view(column)
        if self.plain:
            return v.contains(self.literal()) if self.sensitive or self.folded else F.lower(v).contains(self.literal().lower())
        if self.q.all and self.q.near is None:
            need = [w for w in (*self.q.words, *self.q.phrases)]
            low = v if self.sensitive else F.lower(v)
            conds = [low.contains(w if self.sensitive else w.lower()) for w in need]
            if self.q.word:
                conds += [v.rlike(pattern_of(Query(w, text=w, word=True, case=self.sensitive))) for w in need]
            return reduce(Column.__and__, conds) if conds else F.lit(True)
        must = literals(self.q.text) if self.q.regex else list(self.q.words) if self.q.near is not None else [self.q.text.replace('"', "")]
        low = v if self.sensitive else F.lower(v)
        conds = [low.contains(m if self.sensitive else m.lower()) for m in must]
        return reduce(Column.__and__, [*conds, v.rlike(self.pattern)])

    def count(self, column: Column, most: int = 10_000) -> Column:
        return F.least(F.lit(most), F.regexp_count(self.view(column), F.lit(self.pattern)))
