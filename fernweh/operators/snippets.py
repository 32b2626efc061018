"""Lines, pages and what surrounds matches; all functions of one text and a pattern, so nothing shuffles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from fernweh.functions import formats
from fernweh.functions import text as T

WIDTH = 240
RANGES = ArrayType(StructType([StructField("line", IntegerType()), StructField("start_pos", IntegerType()), StructField("end_pos", IntegerType())]))


def lines(texts: DataFrame, data: str = "data") -> DataFrame:
    """One row per line: line and page count from 1, a form feed ends a line and a page. Pages are split first and number their lines, so that the cost is that of the text's length."""
    page = lambda p, k: F.transform(F.split(p, "\n", -1), lambda x: F.struct((k + 1).cast("int").alias("page"), x.alias("text")))
    rows = F.flatten(F.transform(F.split(F.col(data), "\f", -1), page))
    return texts.select("*", F.posexplode(rows).alias("line", "row")).select(*[c for c in texts.columns if c != data], (F.col("line") + 1).cast("int").alias("line"), "row.page", "row.text")


def matching_lines(texts: DataFrame, condition, most: int = 20, data: str = "data", keys=("id",)) -> DataFrame:
    """The first lines of each text that meet the condition. A text's lines never leave its task before they are filtered; the few that match are numbered inside an array."""
    rows = F.filter(F.transform(T.lines(F.col(data)), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text"))), lambda r: condition(r["text"]))
    return texts.select(*keys, F.inline(F.slice(rows, 1, most)))


def highlights(data: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Ranges of matches within lines; a match that runs over a line's end belongs to the line it begins in."""
    rx = re.compile(pattern, re.I * ignore_case | re.M)

    @F.pandas_udf(RANGES)
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out, line, start = [], 1, 0
            for m in rx.finditer(t):
                if m.end() == m.start():
                    continue
                for b in re.finditer("[\n\f]", t[start : m.start()]):
                    line += 1
                breaks = max(t.rfind("\n", 0, m.start()), t.rfind("\f", 0, m.start())) + 1
                stop = min([x for x in (t.find("\n", m.start()), t.find("\f", m.start())) if x >= 0], default=len(t))
                out.append({"line": line, "start_pos": m.start() - breaks, "end_pos": min(m.end(), stop) - breaks})
                start = m.start()
            return out

        return texts.map(one)

    return run(data)


def clip(line: Column, first: Column, width: int = WIDTH) -> Column:
    """A window of a long line that begins a third before the first match, at a blank where one is near; first counts from 0."""
    flat = F.translate(line, "\t", " ")
    n = F.length(flat)
    raw = F.greatest(F.lit(0), first - width // 3)
    near = raw + 10 - F.instr(F.reverse(F.substring(flat, F.lit(1), raw + 11)), " ") + 1
    blank = F.when(F.instr(F.substring(flat, F.lit(1), raw + 11), " ") > 0, near).otherwise(-1)
    start = F.when((raw > 0) & (blank > raw - 20) & (blank >= 0), blank + 1).otherwise(raw)
    end = F.least(n, start + width)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    return F.when(n <= width, flat).otherwise(cut)


def around(matches: DataFrame, all_lines: DataFrame, context: int, keys=("id",)) -> DataFrame:
    """Matching lines and their neighbours, once each."""
    near = matches.select(*keys, F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line")).filter("line > 0").distinct()
    return all_lines.join(near, [*keys, "line"])


def line_range(texts: DataFrame, first: int, count: int, budget: int = 20_000) -> DataFrame:
    """Lines from `first` on, as many as the count and the budget of characters allow."""
    rows = F.slice(F.transform(T.lines(F.col("data")), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text"))), first, count)
    sized = F.aggregate(rows, F.array().cast("array<struct<line:int,text:string,total:int>>"), lambda acc, r: F.concat(acc, F.array(F.struct(r["line"].alias("line"), r["text"].alias("text"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["total"], F.lit(0)) + F.length(r["text"]) + 1).cast("int").alias("total")))))
    return texts.select("id", F.inline(F.filter(sized, lambda r: (r["total"] <= budget) | (r["line"] == first)))).select("id", "line", "text")


def read_on(texts: DataFrame, line: int = 1, column: int = 0, budget: int = 20_000) -> DataFrame:
    """(id, text, next_line, next_column) from a place on, as many characters as the budget allows; the place after them is where reading goes on, null at the end. Lines end with a line or form feed; a place beyond a line's end is that end, one beyond the text gives no row."""
    lines_ = T.lines(F.col("data"))
    before = F.aggregate(F.slice(lines_, 1, line - 1), F.lit(0), lambda a, x: a + F.length(x) + 1) if line > 1 else F.lit(0)
    at = before + F.least(F.lit(column), F.length(F.element_at(lines_, line)))
    part = F.substring("data", F.col("at") + 1, budget)
    end = F.col("at") + F.length("text")
    rows = texts.filter(F.size(lines_) >= line).select("id", "data", at.alias("at")).select("id", "data", "at", part.alias("text"))
    said = F.split("text", r"[\n\f]", -1)
    more = end < F.length("data")
    next_line = F.when(more, F.lit(line) + F.size(said) - 1)
    own = F.length(F.element_at(said, -1))
    next_column = F.when(more, F.when(F.size(said) > 1, own).otherwise(F.least(F.lit(column), F.length(F.element_at(T.lines(F.col("data")), line))) + own))
    return rows.select("id", "text", next_line.cast("int").alias("next_line"), next_column.cast("int").alias("next_column"))


def page_starts(texts: DataFrame) -> DataFrame:
    """(id, page, line): where each page begins."""
    parts = F.split(F.col("data"), "\f", -1)
    before = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, 1).otherwise(1 + k + F.aggregate(F.slice(parts, 1, k), F.lit(0), lambda a, p: a + F.size(F.split(p, "\n", -1)) - 1)))
    return texts.select("id", F.posexplode(before).alias("page", "line")).select("id", (F.col("page") + 1).cast("int").alias("page"), F.col("line").cast("int").alias("line"))


def segment_seconds(texts: DataFrame) -> DataFrame:
    """Where transcript lines begin, in seconds."""
    return texts.select("id", F.posexplode(T.lines(F.col("data"))).alias("pos", "text")).select("id", (F.col("pos") + 1).alias("line"), formats.stamp_seconds(F.col("text")).alias("seconds")).filter("seconds IS NOT NULL")
