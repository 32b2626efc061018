"""Repairing text read from scanned pages.

Layout first: running headers, footers, stamps and page numbers are told from text by where they stand on a page, by
their form, and by coming again on other pages of the scan, compared under a fold that makes misread variants equal.
Then words: a noisy channel of character confusions proposes what a word may have been, counts over the whole
collection say how likely each proposal is, and a Viterbi search over the candidate words of a line, with word pair
counts for context, decides. Halves of words divided at line ends are read as one word, unless the collection knows
the word with its hyphen.

Candidates: every confusion keeps a word's strokes, so that a word and all its misread forms share one stroke key
(`stroke_key`), however many of its letters are misread. Rare words meet frequent ones by a join on that key; whether
one can be the other's misread form, and how likely, is told by a lattice over both words without a limit on length or
on the number of confusions. A word with a sign that no word has takes candidates without such signs only.

Scale: counts are kept per distinct word and pair and meet candidates by joins. What texts are asked for is told by a
bit map of fixed size, the one thing that is broadcast; of each text only the numbers of its furniture, its divided
words and its lines with a doubtful word go on, so that no text is shuffled to be judged. A word whose bit another one
set is sorted out by the join that follows.

Defined cases: null and empty texts have no lines; a text without form feeds is one page; repeated rows are judged
alike; a line cut off at a hyphen at the very end of a scan is no case of division, since its other half is nowhere;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernweh.runtime import materialize, spread

# What a scan shows, and what was printed there, with the share of the printed characters that are misread so.
CONFUSIONS = [
    ("c", "e", 0.008), ("@", "a", 0.005), ("f", "t", 0.005), ("0", "o", 0.005), ("1", "l", 0.005), ("!", "i", 0.005), ("5", "s", 0.005), ("cl", "d", 0.005), ("ii", "u", 0.005), ("rn", "m", 0.005),
    ("b", "h", 0.004), ("9", "g", 0.004), ("vv", "w", 0.004), ("n", "ri", 0.003), ("h", "li", 0.003), ("l", "i", 0.002), ("m", "rn", 0.002), ("6", "b", 0.002), ("8", "b", 0.001), ("1", "i", 0.001),
]
RATIO = 0.03  # a misread form is at most this often in the collection as its word
EDGE = 3  # lines at each end of a page among which what recurs is counted; furniture goes on from there as far as it stands
MARKS = 1 << 20  # bits that tell words which may be misread; more words than that cost time, not results

HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­¬]\s*$")
_WORD = re.compile(r"[^\W_][^\s.,;:?()\[\]\"“”«»/|]*(?:-[^\s.,;:?()\[\]\"“”«»/|]+)*|[@!][^\s.,;:?()\[\]\"“”«»/|]+")
_FOLD = str.maketrans({"0": "o", "5": "s", "9": "g", "@": "a", "f": "t"})


@lru_cache(maxsize=100_000)
def fold(s: str) -> str:
    """Equal for a line and its misread forms: strokes that scans confuse are left out, words still count."""
    s = s.casefold()
    return re.sub(r"[rnmilhbuvwdce1!|68]", "", s.translate(_FOLD)) + f"#{len(s.split())}"


_D = r"[\dlIOoSsgBi!]{1,4}"
_NUMBER = rf"(?:\d{{1,4}}|(?=\S*\d){_D}|[lI][lIO]{{0,3}}|[ivxlc]{{1,6}})"
_LABEL = r"(?:[PpF][a@][g9][ec]|[Ss5][ceh][b]?[ei!1l]*[eich]*t[ec]?|[Ss5]h[ec]{2}[tf]|[Ss5]b[ec]{2}[tf]|p|S|Bl[a@]tt|[Ff]olio)"
_PAGE_NO = re.compile(rf"^(?:{_LABEL}\.?\s+{_NUMBER}(?:\s*(?:[o0][ft]|v[o0]n|[s5]ur|[s5](?:u|ii)r|d[ec]|/)\s*{_NUMBER})?|[-–—\[(]\s*{_NUMBER}\s*[-–—\])]|{_NUMBER}\s*/\s*{_NUMBER})$")
_BARE = re.compile(rf"^{_NUMBER}$")
_NUMBERED = re.compile(rf"^{_NUMBER}\s*\|\s*(.+)$|^(.+?)\s{{2,}}(?:{_NUMBER}\s*\|\s*(.+)|({_LABEL}\.?\s+{_NUMBER}(?:\s*\S{{1,3}}\s*{_NUMBER})?|[-–—\[(]?\s*{_NUMBER}\s*[-–—\])]?|{_NUMBER}\s*/\s*{_NUMBER}))$")
_DATE = r"[\dlIOo!]{1,2}\.[\dlIOo!]{1,2}\.[\dlIOoSsg!]{2,4}"
_STAMP = re.compile(rf"^(?:\S{{3,12}}\s*/?\s*{_DATE}(?:\s+\S+){{0,2}}|[FP][i!1l]l[ec]\s+n\S\.?\s*\S+/\S+|F\S{{2,4}}\s+[A-Z0-9]-\S+\s+r\S{{1,2}}\.\s*\S+|©\s.{{2,40}}|.{{3,40}}\s[-–]\s(?:internal|confidential|intern|interne|interno))$")
_ROW = re.compile(r"^(?:[Tt]otal|\S+:|\S+ (?:totals|counts|readings):|\S+ \d+(?: x [\d.]+)?|\d+|[A-Z]\d+[A-Z]\d+)$")


def _number(s: str) -> int | None:
    s = re.sub(r"[^\w]", "", s).lower()
    if re.fullmatch(r"[ivx]+", s):
        total, prev = 0, 0
        for c in reversed(s):
            v = {"i": 1, "v": 5, "x": 10}[c]
            total += -v if v < prev else v
            prev = max(prev, v)
        return total
    s = s.translate(str.maketrans({"l": "1", "i": "1", "o": "0", "s": "5", "g": "9", "b": "8"}))
    return int(s) if s.isdigit() else None


def pages(text: str) -> list[list[tuple[int, str]]]:
    """Lines with their numbers, by page."""
    out, no = [], 0
    for page in text.split("\f"):
        lines = []
        for line in page.split("\n"):
            no += 1
            lines.append((no, line.rstrip("\r")))
        out.append(lines)
    return out


def _split_numbered(line: str) -> str | None:
    """The rest of a line that holds a page number beside a title."""
    m = _NUMBERED.match(line.strip())
    return (m[1] or m[2] or m[3] or "").strip() if m else None


def furniture(text: str) -> set[int]:
    """Numbers of the lines that are only running header, footer, stamp or page number."""
    whole = pages(text)
    book = [[(no, x) for no, x in page if x.strip()] for page in whole]
    keys: Counter = Counter()
    for page in book:
        edge = {x[0]: x for x in [*page[:EDGE], *page[-EDGE:]]}.values()
        keys.update({fold(_split_numbered(x) or x.strip()) for _, x in edge if not _PAGE_NO.match(x.strip()) and not HYPHEN.search(x)})
    numbers: Counter = Counter()
    for k, page in enumerate(book):
        for _, x in {*page[:EDGE], *page[-EDGE:]}:
            if _BARE.match(x.strip()) and (v := _number(x)) is not None:
                numbers[v - k] += 1
    many = len([p for p in book if p]) > 1
    width = max((len(x) for page in book for _, x in page), default=0)
    bare_pages = sum(1 for page in book if page and _BARE.match(page[-1][1].strip()))
    out: set[int] = set()
    for k, page in enumerate(book):
        raw = dict(whole[k])

        def is_it(i: int, top: bool, page=page, raw=raw, k=k) -> bool:
            no, line = page[i]
            x = line.strip()
            if _PAGE_NO.match(x):
                return True
            if _BARE.match(x):
                v = _number(x)
                sequence = many and v is not None and numbers[v - k] >= 2
                if sequence or top and i == 0 and many:
                    return sequence or not page[1:2] or not _ROW.match(page[1][1].strip())
                alone = line[:1].isspace() or not raw.get(no - 1, "x").strip() or i > 0 and page[i - 1][0] in out
                before = page[i - 1][1].strip() if i else ""
                if re.fullmatch(r"[Tt][o0][tf][a@][l1]", before):
                    return False
                return alone or i > 0 and not _ROW.match(before) and not re.match(r"^\S+ \d+$", before) and (x.isdigit() or not many or bare_pages > 1 or len(x) < 4)
            rest = _split_numbered(line)
            if rest is not None and (keys[fold(rest)] >= 2 or re.match(rf"^{_NUMBER}\s*\|", x) or top and k > 0 or len(rest) < width and not re.search(r"[.,;]$", rest) and _PAGE_NO.match(x[len(rest):].strip() or "-")):
                return True
            if not top and _STAMP.match(x):
                return True
            if _ROW.match(x) or HYPHEN.search(line):
                return False
            if many and keys[fold(x)] >= 2:
                return True
            if top and many and i == 0 and k > 0 and len(x) < 0.55 * width and not re.search(r"[.:!?,;]$", x):
                return True  # running text fills its lines
            letters = re.sub(r"[\W\d_]", "", x)
            return top and many and i == 0 and len(x) < width and len(letters) > 5 and (letters.isupper() or sum(c.isupper() for c in letters) > 0.8 * len(letters))

        hi = len(page)
        for i in range(len(page) - 1, -1, -1):
            if not is_it(i, False):
                break
            hi = i
            out.add(page[i][0])
        for i in range(hi):
            if not is_it(i, True):
                break
            out.add(page[i][0])
        # a stamp above a page number was reached above; a page number may also stand above a stamp
    return out


def words_of(line: str) -> list[tuple[int, str]]:
    """(offset, word) of a line; a mark that ends a sentence isn't part of a word."""
    out = []
    for m in _WORD.finditer(line):
        w = m[0].rstrip("!'’")
        if w:
            out.append((m.start(), w))
    return out


def plain_words(line: str) -> list[str]:
    """The words alone."""
    words = _WORD.findall(line)
    if "!" in line or "'" in line or "’" in line:
        words = [x for w in words if (x := w.rstrip("!'’"))]
    return words


class Page:
    """A text's lines that aren't furniture, with words divided at line ends read as one."""

    def __init__(self, text: str):
        self.lines = [(no, x) for page in pages(text) for no, x in page]
        self.furniture = furniture(text)
        self.flow = [(no, x) for no, x in self.lines if no not in self.furniture and x.strip()]
        self.rows: list[tuple[int, int, int, list[str]]] = []  # per line of the flow: (line, line of the last word's end, length of its first half if it is divided, words)
        self.divided: list[tuple[int, str, str]] = []  # (line, first half, other half)
        carry = False
        for k, (no, x) in enumerate(self.flow):
            m = HYPHEN.search(x) if k + 1 < len(self.flow) else None
            if m and (joined := self._divide(k, x, x[: m.start()], carry)):
                self.rows.append((no, self.flow[k + 1][0], *joined))
                carry = True
                continue
            words = plain_words(x)
            self.rows.append((no, no, 0, words[1:] if carry else words))
            carry = False

    def _divide(self, k: int, x: str, body: str, carry: bool) -> tuple[int, list[str]] | None:
        """(length of the first half, words) of a line that ends in one."""
        words = words_of(x)
        own, follows = words[1:] if carry else words, self.flow[k + 1][1]
        nxt = plain_words(follows)
        last = re.search(r"\S+$", body)
        half = re.sub(r"^[(\[\"“«]+", "", last[0]) if last else ""
        start = follows.lstrip()[:1]
        if not (own and nxt and half and (start.isalnum() or start in "@!")) or carry and not own[1:] and len(words) == 1:
            return None
        self.divided.append((self.flow[k][0], half, nxt[0]))
        return len(half), [w for p, w in own if p < last.start()] + [half + nxt[0]]


# A word's strokes: what a scan confuses has the same ones. One letter each first, then those of several strokes.
_ONE_STROKE = ("l1!ef05@9hb68", "iiictosaguuuu")
_STROKES = [("u", "ii"), ("n", "ri"), ("m", "rri"), ("d", "ci"), ("w", "vv")]
ODD = "[0-9@!]"  # signs that no word has
_LOGS = [(seen, meant, math.log(share)) for seen, meant, share in CONFUSIONS]


def stroke_key(word: Column) -> Column:
    """The same for a lower-case word and all its misread forms."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _STROKES, F.translate(word, *_ONE_STROKE))


def channel(shown: str, meant: str) -> float | None:
    """Log probability of the likeliest way to misread one word as the other, by a lattice over both; None if there is none."""
    front: dict[int, dict[int, float]] = {0: {0: 0.0}}  # place in shown -> place in meant -> best
    for i in range(len(shown)):
        for j, p in front.pop(i, {}).items():
            steps = [(seen, said, logp) for seen, said, logp in _LOGS if shown.startswith(seen, i) and meant.startswith(said, j)]
            if meant[j : j + 1] == shown[i]:
                steps.append((shown[i], shown[i], 0.0))
            for seen, said, logp in steps:
                at = front.setdefault(i + len(seen), {})
                at[j + len(said)] = max(at.get(j + len(said), -1e9), p + logp)
    return front.get(len(shown), {}).get(len(meant))


def _count(frames, column: str):
    words: Counter = Counter()
    for pdf in frames:
        for text in pdf[column]:
            for line in re.split("[\n\f]", text.lower() if text else ""):
                ws = plain_words(line)
                if ws and HYPHEN.search(line):
                    ws.pop()
                words.update(ws)
        if len(words) > 300_000:
            yield pd.DataFrame(list(words.items()), columns=["word", "n"])
            words.clear()
    yield pd.DataFrame(list(words.items()), columns=["word", "n"])


def counts(scans: DataFrame, column: str = "data") -> DataFrame:
    """(word, n) over all texts; halves at line ends don't count."""
    return spread(scans.select(column)).mapInPandas(lambda f: _count(f, column), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


RECORD = "furniture array<int>, divided array<struct<line: int, a: string, b: string>>, rows array<struct<line: int, end: int, half: int, words: array<string>>>"


def bit_map(words: DataFrame) -> bytes:
    """MARKS bits of which those of the words (one column, word) are set."""
    bits = bytearray(MARKS // 8)
    for (h,) in words.select(F.col("word").cast("binary").alias("w")).select(F.crc32("w").bitwiseAND(MARKS - 1)).distinct().collect():  # at most MARKS numbers
        bits[h >> 3] |= 1 << (h & 7)
    return bytes(bits)


def _records(frames, doubtful: bytes, meant: bytes):
    """Of each text what can be noise: numbers of its furniture, divided words, lines with words that may need a decision; and, over many texts, counts of pairs of which the second word may be meant by one."""
    known: dict[str, int] = {}
    pairs: Counter = Counter()

    def flags(w: str) -> int:
        h = crc32(w.encode("utf-8", "replace")) & MARKS - 1
        if len(known) > 500_000:
            known.clear()
        known[w] = got = (doubtful[h >> 3] >> (h & 7) & 1) | (meant[h >> 3] >> (h & 7) & 1) << 1
        return got

    def counted():
        frame = pd.DataFrame([(None, None, None, None, a, b, n) for (a, b), n in pairs.items()], columns=COLUMNS)
        pairs.clear()
        return frame

    for pdf in frames:
        out = []
        for i, text in zip(pdf["id"], pdf["text"]):
            if not text:
                continue
            page = Page(text)
            rows = []
            for no, end, half, words in page.rows:
                low = [w.lower() for w in words]
                said = [known[w] if w in known else flags(w) for w in low]
                if half or any([f & 1 for f in said]):
                    rows.append({"line": no, "end": end, "half": half, "words": words})
                pairs.update([(x, y) for x, y, f in zip(low, low[1:], said[1:]) if f & 2])
            shown = [no for no, x in page.lines if no in page.furniture and x.strip()]
            if shown or rows:
                out.append((i, shown, [{"line": no, "a": a, "b": b} for no, a, b in page.divided], rows, None, None, None))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"id": object})
        if len(pairs) > 300_000:
            yield counted()
    yield counted()


COLUMNS = ["id", "furniture", "divided", "rows", "a", "b", "n"]


def _channels(frames):
    for pdf in frames:
        yield pdf.assign(channel=[channel(w, c) for w, c in zip(pdf["word"], pdf["candidate"])]).dropna(subset=["channel"])[["word", "candidate", "channel", "n"]]


def _choices(known) -> dict[str, dict[str, tuple[float, int]]]:
    """word -> candidate -> (channel, n), only where a candidate is so much more frequent that the word may be its misread form."""
    n = {x["word"]: x["n"] for x in known if x["candidate"] == x["word"]}
    out: dict = {}
    for x in known:
        w, c = x["word"], x["candidate"]
        if c != w and n.get(w, 0) <= max(RATIO * x["n"], 1 if x["n"] > 2 else 0):
            out.setdefault(w, {})[c] = (x["channel"], x["n"])
    return out


def read_line(row: list[str], choices: dict, n: dict[str, int], pair: dict, total: float) -> list[str]:
    """Viterbi over the candidate words of a line."""
    def prior(a: str | None, b: str, nb: float) -> float:
        p = (nb + 0.001) / total
        if a is not None and nb and (a, b) in pair:
            both, na = pair[(a, b)]
            p = 0.7 * p + 0.3 * both / max(na, both)
        return math.log(p)

    if not any(w in choices for w in row):
        return row
    states = {None: (0.0, [])}
    for w in row:
        options = {w: (0.0, 0 if w in choices else n.get(w, 0))} | choices.get(w, {})  # misreading explains all occurrences of such a word
        step = {}
        for c, (channel, nc) in options.items():
            single = len(options) == 1
            step[c] = max(((score + (0.0 if single else prior(a, c, nc) + channel), [*said, c]) for a, (score, said) in states.items()), key=lambda x: x[0])
        states = step
    return max(states.values(), key=lambda x: x[0])[1]


def _case(shown: str, meant: str) -> str:
    letters = [c for c in shown if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) > 0.6 * len(letters):
        return meant.upper()
    return meant[:1].upper() + meant[1:] if shown[:1].isupper() else meant


def decide(rows, divided, known, grams, total: float) -> tuple[set[tuple[int, str]], list[list[str]]]:
    """(noise, words as they should read) of lines: rows (line, end, half, words) and divided words (line, first half, other half)."""
    choices = _choices(known)
    n = {x["word"]: x["n"] for x in known if x["candidate"] == x["word"]}
    pair = {(x["a"], x["b"]): (x["n"], x["na"]) for x in (grams if grams is not None else ())}
    noise: set[tuple[int, str]] = set()
    compounds = {}
    for no, a, b in divided:
        whole, compound = n.get(f"{a}{b}".lower(), 0), n.get(f"{a}-{b}".lower(), 0)
        fixed = max((v[1] for v in choices.get(f"{a}{b}".lower(), {}).values()), default=0)
        kept = max((v[1] for v in choices.get(f"{a}-{b}".lower(), {}).values()), default=0)
        compounds[no] = max(compound, kept) > max(whole, fixed)
        if not compounds[no]:
            noise.add((no, "hyphen"))
    out = []
    for no, end, half, words in rows:
        shown = list(words)
        if half and compounds.get(no):
            shown[-1] = f"{shown[-1][:half]}-{shown[-1][half:]}"
        low = [w.lower() for w in shown]
        if choices.keys().isdisjoint(low):
            out.append(shown)
            continue
        fixed = []
        for k, (sh, w, c) in enumerate(zip(shown, low, read_line(low, choices, n, pair, total))):
            if c != w:
                at = next((k for k, (x, y) in enumerate(zip(w, c)) if x != y), min(len(c), len(w)))
                other = half and k == len(shown) - 1 and at >= half + bool(compounds.get(no))
                noise.add((end if other else no, "misread"))
                fixed.append(_case(sh, c))
            else:
                fixed.append(sh)
        out.append(fixed)
    return noise, out


class Reading:
    """What a scan's text says once it is repaired."""

    def __init__(self, text: str, known, grams, total: float):
        self.page = page = Page(text)
        self.noise, self.words = decide(page.rows, page.divided, known, grams, total)
        self.noise |= {(no, "furniture") for no, x in page.lines if no in page.furniture and x.strip()}

    def text(self) -> str:
        """Continuous paragraphs: blank lines and lines that end short separate them."""
        page, out, gap_before = self.page, [], {}
        no_text = set(page.furniture)
        blank = False
        for no, x in page.lines:
            if no in no_text:
                continue
            if not x.strip():
                blank = True
            else:
                gap_before[no] = blank
                blank = False
        width = max((len(x) for _, x in page.flow), default=0)
        carry = None
        prev = ""
        for (no, x), (_, _, half, words), fixed in zip(page.flow, page.rows, self.words):
            line, at = "", 0
            spots = words_of(x)
            if carry is not None and spots:
                at = spots[0][0] + len(spots[0][1])
                spots = spots[1:]
                line = carry
            carry = None
            for k, f in enumerate(fixed):
                if half and k == len(fixed) - 1:
                    k = x.rstrip().rfind(words[-1][:half])
                    line += x[at:k]
                    carry, at = f, len(x)
                elif spots:
                    p, shown = spots.pop(0)
                    line += x[at:p] + f
                    at = p + len(shown)
            if carry is None:
                line += x[at:]
            line = re.sub(r"\s+", " ", line).strip() if not carry else re.sub(r"\s+", " ", line).lstrip()
            if out and (gap_before.get(no) and re.search(r"[.!?:]$", prev) or _ROW.match(x.strip()) or _ROW.match(prev) or len(prev) < 0.5 * width and re.search(r"[.!?]$", prev)):
                out.append(line)
            elif out and out[-1]:
                out[-1] = (out[-1] + ("" if out[-1].endswith(" ") or not line else " ") + line) if line else out[-1]
            else:
                out.append(line)
            prev = x.strip()
        return "\n\n".join(p.strip() for p in out if p.strip())


def evidence(scans: DataFrame, id_col: str, column: str):
    """(texts, records, known, grams, total): what is asked of each text, the candidates and the counts it needs."""
    words = materialize(counts(scans, column), "scan-counts")
    most, total = words.agg(F.max("n"), F.sum("n")).first()
    most, total = most or 0, float(total or 1)
    spark, kind = scans.sparkSession, scans.schema[id_col].dataType.simpleString()
    src = spread(scans.select(F.col(id_col).alias("id"), F.col(column).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull()))
    meant = words.filter(~F.col("word").rlike(ODD)).select(F.col("word").alias("candidate"), "n", stroke_key(F.col("word")).alias("key"))

    def useful_of(types: DataFrame) -> DataFrame:
        """(word, candidate, channel, n) of words (word, own) that may be misread forms: so much rarer than a word of the same strokes that a lattice can read them as."""
        rare = F.col("own") <= F.greatest(RATIO * F.col("n"), F.when(F.col("n") > 2, 1).otherwise(0))
        pairs = types.withColumn("key", stroke_key(F.col("word"))).join(meant, "key").filter((F.col("word") != F.col("candidate")) & rare)
        return pairs.select("word", "candidate", "n").mapInPandas(_channels, "word string, candidate string, channel double, n bigint")

    first = materialize(useful_of(words.filter((F.col("n") <= max(RATIO * most, 1)) & ~F.col("word").rlike("^[0-9]+$")).select("word", F.col("n").alias("own"))), "scan-candidates")
    bits = spark.sparkContext.broadcast((bit_map(first), bit_map(first.select(F.col("candidate").alias("word")))))
    read = materialize(src.mapInPandas(lambda f: _records(f, *bits.value), f"id {kind}, {RECORD}, a string, b string, n bigint"), "scan-lines")
    records = read.filter("a IS NULL").select("id", "furniture", "divided", "rows")
    pairs = read.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    row = records.select("id", F.explode("rows").alias("r")).select("id", F.transform("r.words", F.lower).alias("ws"), F.col("r.half").alias("half"))
    spots = row.select("id", "half", "ws", F.posexplode("ws").alias("k", "word")).select(
        "id", "word", F.try_element_at("ws", F.when(F.col("k") > 0, F.col("k"))).alias("before"), ((F.col("half") > 0) & (F.col("k") == F.size("ws") - 1)).alias("divided")
    )
    both = records.select("id", F.explode("divided").alias("d")).select("id", F.explode(F.array(F.lower(F.concat("d.a", F.lit("-"), "d.b")), F.lower(F.concat("d.a", "d.b")))).alias("word"))  # both readings need their counts
    whole = spots.filter("divided").select("word").unionByName(both.select("word")).distinct()
    unseen = whole.join(words, "word", "left_anti").withColumn("own", F.lit(0).cast("bigint"))
    useful = materialize(first.unionByName(useful_of(unseen)), "scan-readings")
    itself = words.select("word", F.col("word").alias("candidate"), F.lit(0.0).alias("channel"), "n")
    kept = useful.unionByName(itself.join(useful.select("word").unionByName(whole).distinct(), "word", "left_semi"))  # words whose own counts matter
    own = spots.select("id", "word").unionByName(both).distinct()
    known = own.join(kept, "word").groupBy("id").agg(F.collect_set(F.struct("word", "candidate", "channel", "n")).alias("known"))
    # what stands before a doubtful word may be doubtful itself, and then each of its candidates may stand there
    beside = spots.filter("before IS NOT NULL").select("id", "before", "word").join(useful.select("word", "candidate"), "word").select("id", "before", F.col("candidate").alias("b")).distinct()
    other = beside.join(useful.select(F.col("word").alias("before"), F.col("candidate").alias("a")), "before").select("id", "a", "b")
    asked = beside.select("id", F.col("before").alias("a"), "b").unionByName(other).distinct()
    grams = asked.join(pairs, ["a", "b"]).join(words.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").groupBy("id").agg(F.collect_list(F.struct("a", "b", "n", "na")).alias("grams"))
    return src, records, known.join(grams, "id", "left"), total


def _noise(frames, total: float):
    for pdf in frames:
        out = []
        for i, shown, divided, rows, known, grams in zip(pdf["id"], pdf["furniture"], pdf["divided"], pdf["rows"], pdf["known"], pdf["grams"]):
            out.extend((i, no, "furniture") for no in shown)
            rows = [(r["line"], r["end"], r["half"], r["words"]) for r in rows]
            out.extend((i, no, what) for no, what in decide(rows, [(d["line"], d["a"], d["b"]) for d in divided], () if known is None else known, grams, total)[0])
        frame = pd.DataFrame(out, columns=["id", "line_no", "noise"])
        frame["id"] = frame["id"].astype(pdf["id"].dtype)
        yield frame


def noise(scans: DataFrame, id_col: str = "id", column: str = "data") -> DataFrame:
    """(id, line_no, noise): furniture, hyphen and misread lines."""
    _, records, known, total = evidence(scans, id_col, column)
    kind = scans.schema[id_col].dataType.simpleString()
    return records.join(known, "id", "left").mapInPandas(lambda f: _noise(f, total), f"id {kind}, line_no bigint, noise string").distinct()


def repaired(scans: DataFrame, id_col: str = "id", column: str = "data") -> DataFrame:
    """(id, text): the repaired paragraphs."""
    src, _, known, total = evidence(scans, id_col, column)
    kind = scans.schema[id_col].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = [(i, Reading(text, () if k is None else k, g, total).text()) for i, text, k, g in zip(pdf["id"], pdf["text"], pdf["known"], pdf["grams"])]
            frame = pd.DataFrame(out, columns=["id", "text"])
            frame["id"] = frame["id"].astype(pdf["id"].dtype)
            yield frame

    return src.join(known, "id", "left").mapInPandas(run, f"id {kind}, text string")
