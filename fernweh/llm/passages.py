"""Cutting oversized passages at natural boundaries.

Each text becomes an array of token end offsets (prefix sums of token lengths) and, per kind of boundary, a sorted
array of offsets at which a piece may end. For each piece the last boundary under the limit is found by binary
search, strongest kind first; the next piece starts at the first token start within the overlap before it. A text
without boundaries is cut hard, never inside a character with its combining marks.

Defined cases: null prompts and texts within the limit are no case; without an empty line the whole prompt is the
text and the title is empty; repeated rows count once, and of rows of one (file, n) that differ the least (hash,
start_pos, end_pos, prompt) counts. Offsets map through squeezed blanks by counting the other characters
(`exact`), after moving to where the passage stands now (`moved`), by plain addition when the lengths agree and no
text is at hand (`assumed`). When the text no longer holds the passage (`stale`) they are those of the text it was
cut from, by the piece's share of the passage, and without a place of the passage (`relative`) they count from the
passage's beginning. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from unicodedata import combining

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweh.runtime import keep_keys, materialize

MAX_CHARS = 1800
OVERLAP = 200

_TOKENS = re.compile(r"[^\W_]+|_+|\s+|[^\w\s]")
_KINDS = [
    re.compile(r"\n[ \t]*(?=\n)|(?=\f)"),  # paragraphs and pages
    re.compile(r"[.!?…][\"'»”’)\]]*(?=\s)|[。！？][」』）]*"),  # sentences
    re.compile(r"(?=\n)"),  # lines
    re.compile(r"[;:,](?=\s)|[、，；：]"),  # clauses
    re.compile(r"(?=\s)"),  # words
]


def boundaries(text: str) -> list[list[int]]:
    """Sorted offsets at which a piece may end, per kind, strongest first."""
    return [sorted({len(text[: m.end()].rstrip()) if k == 0 else m.end() for m in rx.finditer(text)}) for k, rx in enumerate(_KINDS)]


def cut(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of text, in order; every piece but the first repeats the end of the one before."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends = list(accumulate(len(t) for t in _TOKENS.findall(text)))  # the tokens cover the text
    starts = [0, *ends[:-1]]
    kinds = boundaries(text)
    pieces, s = [], 0
    while n - s > limit:
        least, most = s + max(overlap + 1, limit // 2), s + limit
        e = 0
        for k, offsets in enumerate(kinds):
            i = bisect_right(offsets, most) - 1
            if i >= 0 and offsets[i] >= (least if k < 4 else s + overlap + 1):
                e = offsets[i]
                break
        if not e:  # no boundary at all: the last token end, or a hard cut
            i = bisect_right(ends, most) - 1
            e = ends[i] if i >= 0 and ends[i] > s + overlap else most
            hard, least = e, max(s + overlap + 1, e - 32)
            while e > least and e < n and (combining(text[e]) or text[e] in "‍️" or text[e - 1] == "‍"):
                e -= 1
            e = hard if e == least else e  # marks without end are cut like anything else
        pieces.append((s, e))
        i = bisect_left(starts, e - overlap)
        while i < len(starts) and starts[i] < e and text[starts[i]].isspace():
            i += 1
        s = starts[i] if i < len(starts) and starts[i] < e else e - overlap
    pieces.append((s, n))
    return pieces


def _solid(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if not c.isspace()]


def place(body: str, start: int | None, end: int | None, raw: str | None) -> tuple[str, list[int] | None, int]:
    """How offsets in the squeezed body map to the file's text: (state, offsets of its non-blank characters, first offset)."""
    if raw is not None and start is not None and end is not None:
        want = "".join(body.split())
        for state, lo, hi in (("exact", start, end), ("moved", 0, len(raw))):
            solid = _solid(raw[lo:hi]) if 0 <= lo <= hi else []
            have = "".join(raw[lo:hi][i] for i in solid)
            at = 0 if have == want else have.find(want) if state == "moved" and want else -1
            if at >= 0:
                return state, [lo + i for i in solid[at : at + len(want)]], 0
        return "stale", None, 0
    if start is not None and end is not None and end - start == len(body):
        return "assumed", None, start
    return "stale", None, 0


def _split(frames, limit: int, overlap: int):
    for pdf in frames:
        out = []
        raws = pdf["raw"] if "raw" in pdf else [None] * len(pdf)
        for file, n, start, end, prompt, raw in zip(pdf["file"], pdf["n"], pdf["start_pos"], pdf["end_pos"], pdf["prompt"], raws):
            head, gap, body = prompt.partition("\n\n")
            if not gap:
                head, body = "", prompt
            start, end = (None if pd.isna(x) else int(x) for x in (start, end))
            state, solid, base = place(body, start, end, raw if isinstance(raw, str) else None)
            before = list(accumulate((0 if c.isspace() else 1 for c in body), initial=0)) if solid else None
            for k, (a, b) in enumerate(cut(body, limit, overlap)):
                if solid:
                    i, j = before[a], before[b] - 1
                    s, e = (solid[i], solid[j] + 1) if j >= i else (None, None)
                elif state == "assumed":
                    s, e = base + a, base + b
                elif start is not None and end is not None and 0 <= start <= end:  # in the text as it was, by the share of the passage
                    s, e = start + a * (end - start) // len(body), start + b * (end - start) // len(body)
                else:
                    s, e, state = a, b, "relative"
                out.append((file, n, k, s, e, head + gap + body[a:b], state))
        yield pd.DataFrame(out, columns=["file", "n", "piece", "start_pos", "end_pos", "prompt", "offsets"]).astype(
            {"file": "Int64", "n": "Int64", "piece": "int32", "start_pos": "Int64", "end_pos": "Int64"}
        )


def body_of(prompt):
    """The text of a prompt: what follows its first empty line."""
    at = F.instr(prompt, "\n\n")
    return F.when(at > 0, F.substring(prompt, at + 2, F.length(prompt))).otherwise(prompt)


def split_oversized(passages: DataFrame, texts: DataFrame | None = None, content_map: DataFrame | None = None, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the passages whose text is over the limit; texts and content_map give the pieces' exact offsets. Only oversized rows are shuffled or reach Python."""
    big = (
        passages.filter(F.length(body_of(F.col("prompt"))) > limit)
        .groupBy("file", "n")
        .agg(F.min(F.struct("hash", "start_pos", "end_pos", "prompt")).alias("p"))
        .select("file", "n", "p.start_pos", "p.end_pos", "p.prompt")
    )
    if texts is not None and content_map is not None:
        big = materialize(big, "oversized")
        owners = materialize(keep_keys(content_map.select(F.col("id").alias("file"), "text"), big.select("file").distinct(), "file"), "oversized-texts")
        raw = keep_keys(texts.select(F.col("id").alias("text"), F.col("data").alias("raw")), owners.select("text").filter("text IS NOT NULL").distinct(), "text")
        big = big.join(owners.join(raw, "text").select("file", "raw"), "file", "left")
    return big.mapInPandas(
        lambda frames: _split(frames, limit, overlap),
        "file bigint, n bigint, piece int, start_pos bigint, end_pos bigint, prompt string, offsets string",
    )
