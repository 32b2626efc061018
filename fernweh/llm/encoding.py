"""Finding and repairing text that was decoded with the wrong character encoding.

A noisy-channel decoder. Each chunk of a text (a run without blanks and without East Asian characters) that isn't
plain ASCII is turned back into a lattice of bytes under every channel (the encoding it was read with, the one it
was written in). Edges of the lattice are the characters that the bytes make up; a byte that was lost (U+FFFD) is a
wildcard, a character made up with one is any character that fits, and a sign that was never damaged may stay as it
is. The lattice's best path is the channel's reading. Readings are scored by word frequencies counted over the whole
collection, words with lost letters by those of all words that fit; a Viterbi search over the text's chunks then
picks clean text or a channel for each, a change of channel costing more than a chance match brings.

Lost letters, whether a whole letter or some bytes of it were lost: every word of the collection that fits what is
left is a state of a second Viterbi search over the text's lost words. It weighs how often the word occurs and which
words stand near it elsewhere, so that the language of the text decides between words of several; neighbours that
are lost themselves take part with all theirs. That U+FFFD at a letter is damage is a definition, so no frequency can
outweigh it; words are only what it is filled by.

Scale: frequencies and readings are kept per distinct word and distinct chunk and meet by joins on them; nothing
that grows with the vocabulary is broadcast. Only texts with a chunk that some channel reads better reach the search;
their ids are broadcast up to a bound, beyond it they meet the texts by a shuffle. Neighbours are counted for words
that fit a pattern with several words; a bit map of fixed size tells these.

Defined cases: null and empty texts are clean; U+FFFD inside or beside a word is damage even where no word fits and
then stays as it is; a lone U+FFFD is not; texts of one id that is repeated are each judged by the chunks of all;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from codecs import charmap_encode
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweh.runtime import keep_keys, materialize, scatter, spread

LOST = "�"
# Fixed values: (name, encoding it was read with, encoding it was written in, times).
CHANNELS = [
    ("utf-8 as cp1252", "cp1252", "utf-8", 1), ("utf-8 twice as cp1252", "cp1252", "utf-8", 2), ("utf-8 as mac-roman", "mac_roman", "utf-8", 1),
    ("utf-8 as cp1251", "cp1251", "utf-8", 1), ("utf-8 as cp1250", "cp1250", "utf-8", 1), ("utf-8 as cp850", "cp850", "utf-8", 1), ("utf-8 as cp437", "cp437", "utf-8", 1),
    ("cp1251 as cp1252", "cp1252", "cp1251", 1), ("cp866 as cp1251", "cp1251", "cp866", 1), ("koi8-r as cp1251", "cp1251", "koi8_r", 1), ("cp1251 as koi8-r", "koi8_r", "cp1251", 1),
    ("koi8-r as cp1252", "cp1252", "koi8_r", 1), ("cp866 as cp1252", "cp1252", "cp866", 1), ("cp1250 as cp1252", "cp1252", "cp1250", 1), ("latin-2 as cp1252", "cp1252", "iso8859_2", 1),
    ("cp852 as cp1252", "cp1252", "cp852", 1), ("cp852 as cp1250", "cp1250", "cp852", 1), ("cp1252 as cp850", "cp850", "cp1252", 1), ("cp1252 as cp437", "cp437", "cp1252", 1),
    ("cp850 as cp1252", "cp1252", "cp850", 1), ("cp437 as cp1252", "cp1252", "cp437", 1), ("mac-roman as cp1252", "cp1252", "mac_roman", 1), ("cp1252 as mac-roman", "mac_roman", "cp1252", 1), ("cp1252 as cp1250", "cp1250", "cp1252", 1),
    ("cp1252 as cp1251", "cp1251", "cp1252", 1), ("cp1252 as latin-1", "cp1252", "cp1252", 1), ("shift-jis as cp1252", "cp1252", "cp932", 1), ("euc-jp as cp1252", "cp1252", "euc_jp", 1), ("utf-8 as gbk", "gbk", "utf-8", 1),
]

_FAR = r"\u3000-\u30ff\u3400-\u9fff\uac00-\ud7a3\uff00-\uffef"
_BLANK = r" \t\n\r\f\v"
# Each run is looked at from its beginning only, so that long runs of ASCII cost no more than their length.
CHUNK = re.compile(
    rf"(?:(?<![A-Za-z])[A-Za-z]*+)?[\u4e00-\u9fff][A-Za-z\u4e00-\u9fff]*+"
    rf"|(?<![^{_BLANK}{_FAR}])[^{_BLANK}{_FAR}\x80-\U0010ffff]*+[^\x00-\x7f{_FAR}][^{_BLANK}{_FAR}]*+"
)
_TOKEN = re.compile(r"[぀-ゟ]+|[゠-ヿ]+|[㐀-鿿々]+|[^\W\d_぀-ヿ㐀-鿿]+|[^\w\x00-\x7f]")
ENTER, CHANGE, LEAVE, AGAIN = 1.5, 4.0, 0.3, 0.2
_RUN = re.compile(rf"(?:[^\W\d_²³¹¼-¾{_FAR}]|{LOST})+|[^\W\d_]+|[^\w\x00-\x7f]")
NEAR = 8  # words on each side that tell which word was lost
DOUBT, SHARE = 1.0, 0.5  # pairs added to those counted; share of the neighbours' evidence, as they tell much the same
MARKS = 1 << 20  # bits that tell words whose neighbours are counted; more words than that cost time, not results


def tokens(text: str) -> list[str]:
    """Words in lower case and symbols outside ASCII."""
    return _TOKEN.findall(text.lower())


def _bytes_of(codec: str) -> dict[str, int]:
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        table[c] = b
    if codec == "cp1252":
        table.update({chr(b): b for b in range(128, 160)})  # decoders that follow the web standard, or latin-1, leave these
    return table


_SINGLE = sorted({c[2] for c in CHANNELS} - {"utf-8", "cp932", "euc_jp"})
_TABLES = {codec: _bytes_of(codec) for codec in {c[1] for c in CHANNELS} - {"gbk"}}


_ENCODE = {codec: {i: i for i in range(128)} | {ord(c): b for c, b in table.items() if len(c) == 1} for codec, table in _TABLES.items()}
# Bytes that an encoding has no character for: what is lost when it is read with.
_LOSES = {codec: [b for b in range(128, 256) if bytes([b]).decode(codec, "replace") == LOST] for codec in _TABLES}
DAMAGED = 20.0  # nats by which a chunk with lost letters is damaged rather than clean
KEEP = 2.0  # nats that a sign costs that a reading leaves as it is


def _raw(text: str, wrong: str) -> bytes | None:
    try:
        return charmap_encode(text, "strict", _ENCODE[wrong])[0]
    except UnicodeEncodeError:
        return None


def read_as(text: str, channel: int, raw: dict | None = None) -> str | None:
    """The chunk as the channel's right encoding reads all of it; None if it can't have come that way. raw keeps the bytes by wrong encoding."""
    _, wrong, right, times = CHANNELS[channel]
    if wrong == "gbk":
        try:
            said = text.encode(wrong).decode(right)
        except UnicodeError:
            return None
        return None if said == text or said.isascii() else said
    if "\u4e00" <= max(text) <= "\u9fff":
        return None
    raw = {} if raw is None else raw
    if wrong not in raw:
        raw[wrong] = _raw(text, wrong)
    data = raw[wrong]
    for k in range(times):
        if data is None:
            return None
        try:
            said = data.decode(right)
        except UnicodeDecodeError:
            return None
        if said == text:
            return None
        text = said
        data = _raw(text, wrong) if k + 1 < times else None
    return None if any("\x80" <= c < "\xa0" or c == LOST for c in text) else text


def _character(bytes_: list[int | None], wrong: str) -> str | None:
    """The character that UTF-8 bytes make up, lost ones being None: U+FFFD if several fit, None if none does."""
    n = len(bytes_)
    lead, rest = bytes_[0], bytes_[1:]
    low, high = {2: (0xC2, 0xDF), 3: (0xE0, 0xEF), 4: (0xF0, 0xF4)}[n]
    if lead is not None and not low <= lead <= high or any(b is not None and not 0x80 <= b <= 0xBF for b in rest):
        return None
    lost = [k for k, b in enumerate(bytes_) if b is None]
    if len(lost) == n:
        return None
    if not lost or len(lost) == 1 and lead is not None:
        fits = []
        for b in _LOSES[wrong] if lost else (0,):
            full = [b if x is None else x for x in bytes_]
            try:
                c = bytes(full).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if unicodedata.category(c)[0] not in "CZ":
                fits.append(c)
        if not lost:
            return fits[0] if fits else None
        signs = [c for c in fits if not c.isalpha() and c not in "\u2010"]
        if len(signs) == 1 and not any(c.isalpha() for c in fits):
            return signs[0]
    return LOST


def lattice(text: str, channel: int) -> tuple[str, int] | None:
    """(reading, signs kept) of the best path through the chunk's byte lattice, where bytes may be lost and signs undamaged; None if there is none or it changes nothing."""
    _, wrong, right, times = CHANNELS[channel]
    if wrong == "gbk" or times > 1 or right not in ("utf-8", *_SINGLE) or "\u4e00" <= max(text) <= "\u9fff":
        return None
    table = _ENCODE[wrong]
    units = [None if c == LOST else table.get(ord(c), -1) for c in text]
    best: list = [(0.0, 0, "")] + [None] * len(text)  # (cost, kept, reading) up to each place
    for i, c in enumerate(text):
        if best[i] is None:
            continue
        cost, kept, said = best[i]
        steps = []
        u = units[i]
        if u is not None and 0 <= u < 128:
            steps.append((1, 0.0, 0, c))
        else:
            if u != -1 and right == "utf-8":
                for n in (2, 3, 4):
                    part = units[i : i + n]
                    if len(part) == n and -1 not in part and (x := _character(part, wrong)) is not None:
                        steps.append((n, 0.2 if x == LOST else 0.0, 0, x))
            elif u is not None and u >= 128:
                x = bytes([u]).decode(right, "replace")
                if x != LOST and not "\x80" <= x < "\xa0":
                    steps.append((1, 0.0, 0, x))
            if u is None:
                steps.append((1, 0.5, 0, LOST))
            elif unicodedata.category(c)[0] in "PSZ":
                steps.append((1, 1.0, 1, c))
        for n, more, keep, x in steps:
            if best[i + n] is None or best[i + n][0] > cost + more:
                best[i + n] = (cost + more, kept + keep, said + x)
    end = best[len(text)]
    return None if end is None or end[2] == text else (end[2], end[1])


def lost_pattern(word: str) -> str:
    """What is left of a word whose letters outside ASCII were all lost."""
    return "".join(c if c < "\x80" else LOST for c in word)


def seen_tokens(text: str) -> list[str]:
    """Words and symbols as they are scored: a word with lost letters is the pattern of those that may fit."""
    if LOST not in text:
        return tokens(text)
    return [t for w, _, _ in _sequence(text) for t in ([lost_pattern(w)] if LOST in w else [w])]


def _count(frames, column: str):
    words: Counter = Counter()
    for pdf in frames:
        for text in pdf[column]:
            if text:
                words.update(tokens(text))
        if len(words) > 400_000:
            yield pd.DataFrame(list(words.items()), columns=["token", "n"])
            words.clear()
    yield pd.DataFrame(list(words.items()), columns=["token", "n"])


def frequencies(texts: DataFrame, column: str = "data") -> DataFrame:
    """(token, n) over all texts."""
    return spread(texts.select(column)).mapInPandas(lambda f: _count(f, column), "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _chunks(frames, id_col: str, column: str):
    for pdf in frames:
        out = [(i, c) for i, text in zip(pdf[id_col], pdf[column]) if text and not text.isascii() for c in set(CHUNK.findall(text))]
        yield pd.DataFrame(out, columns=["id", "chunk"])


def _readings(frames):
    for pdf in frames:
        out = []
        for c in pdf["chunk"]:
            raw: dict = {}
            said = []
            for k in range(len(CHANNELS)):
                if (r := read_as(c, k, raw)) is not None:
                    said.append((k, r, 0))
                elif (p := lattice(c, k)) is not None:
                    said.append((k, *p))
            if said or LOST in c:
                out.append((c, -1, c, 0, seen_tokens(c)))
                out.extend((c, k, r, kept, seen_tokens(r)) for k, r, kept in said)
        yield pd.DataFrame(out, columns=["chunk", "channel", "reading", "kept", "tokens"])


_LETTERS = "[^\\x00-\\x7f]"  # of a word, those outside ASCII


def scored_readings(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, channel, reading, gain): readings that fit the collection's words better than the chunk as it stands does; gain in nats."""
    distinct = scatter(chunks.select("chunk"), "chunk").distinct()
    readings = distinct.mapInPandas(_readings, "chunk string, channel int, reading string, kept int, tokens array<string>")
    each = readings.select("chunk", "channel", "reading", "kept", F.explode_outer("tokens").alias("token"))
    patterns = counts.filter(F.col("token").rlike(_LETTERS) & F.col("token").rlike("^\\p{L}+$")).groupBy(F.regexp_replace("token", _LETTERS, LOST).alias("token")).agg(F.sum("n").alias("n"))
    counts = counts.unionByName(patterns)  # tokens have no U+FFFD beside a letter, so that words and patterns are apart
    total = counts.filter(~F.col("token").contains(LOST)).agg(F.sum("n").cast("double").alias("total"))
    unknown = F.lit(0.02)
    seen = F.coalesce(F.col("n").cast("double"), F.lit(0.0))
    odd = F.col("token").rlike("[\\x{80}-\\x{9f}]")
    mixed = F.col("token").rlike("(?=.*[A-Za-z])(?=.*[\\x{370}-\\x{52f}])")
    logp = F.when(F.col("token").isNull(), 0.0).otherwise(
        F.log((seen + unknown) / F.greatest("total", F.lit(1.0))) - F.when(seen < 1, 1.5 * F.least(F.length("token"), F.lit(12))).otherwise(0.0) - F.when(odd, 6.0).when(mixed, 8.0).otherwise(0.0)
    )
    score = each.join(counts, "token", "left").crossJoin(F.broadcast(total)).groupBy("chunk", "channel", "reading").agg((F.sum(logp) - KEEP * F.first("kept")).alias("score"))  # total is one row
    worded = F.when(F.col("reading").rlike("(?=\\p{L}{3})\\p{L}*[\\p{L}&&[^\\x00-\\x7f]]|[\\x{2E80}-\\x{9FFF}]"), 0.0).when(F.col("chunk").rlike("[\\x{80}-\\x{9f}]"), 0.0).otherwise(4.0)  # symbols alone prove little, control characters much
    sure = F.when(F.col("chunk").rlike(f"[\\p{{L}}{LOST}]{LOST}|{LOST}\\p{{L}}"), DAMAGED).otherwise(0.0)  # lost letters are damage by definition, whichever channel reads the rest
    by_chunk = score.groupBy("chunk").agg(F.max(F.when(F.col("channel") == -1, F.col("score"))).alias("as_is"), F.collect_list(F.when(F.col("channel") >= 0, F.struct("channel", "reading", "score"))).alias("said"))  # a row per channel at most
    better = by_chunk.select("chunk", "as_is", F.explode("said").alias("s")).select("chunk", "s.channel", "s.reading", (F.col("s.score") - F.col("as_is")).alias("more"))
    better = better.withColumn("more", F.col("more") - worded).filter("more > 0.5").select("chunk", "channel", "reading", (F.col("more") + sure).alias("gain"))
    lost = chunks.select("chunk").filter(sure > 0).distinct()
    return better.unionByName(lost.select("chunk", F.lit(len(CHANNELS)).alias("channel"), F.lit("").alias("reading"), F.lit(DAMAGED).alias("gain")))


def _sequence(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) in order, in lower case; words with lost letters are one each and keep U+FFFD."""
    out = []
    for m in _RUN.finditer(text):
        if LOST in m[0]:
            if len(m[0]) > 1:
                out.append((m[0].lower(), m.start(), m.end()))
        else:
            out.extend((t, m.start(), m.end()) for t in tokens(m[0]))
    return out


def _around(words: list, j: int) -> list:
    return words[max(0, j - NEAR) : j] + words[j + 1 : j + 1 + NEAR]


def _places(frames):
    """(id, pattern, near) of the words with lost letters; near is empty once, so that places without neighbours count."""
    for pdf in frames:
        out = set()
        for i, text in zip(pdf["id"], pdf["text"]):
            words = [w for w, _, _ in _sequence(text)]
            for j, w in enumerate(words):
                if LOST in w:
                    out.add((i, w, ""))
                    out.update((i, w, v) for v in _around(words, j))
        yield pd.DataFrame(list(out), columns=["id", "pattern", "near"])


def _mark(pattern: str) -> int:
    return zlib.crc32(pattern.encode("utf-8", "surrogatepass")) & (MARKS - 1)


def _marks(frames):
    for pdf in frames:
        yield pd.DataFrame({"mark": [_mark(p) for p in pdf["pattern"]]})


def _pairs(frames, marks: bytes):
    """(token, near, n): words near the marked ones; near is empty for all of a word's."""
    known: dict[str, bool] = {}

    def marked(w: str) -> bool:
        if len(known) > 400_000:
            known.clear()
        m = _mark(lost_pattern(w))
        known[w] = yes = bool(marks[m >> 3] >> (m & 7) & 1)
        return yes

    pairs: Counter = Counter()
    for pdf in frames:
        for text in pdf["text"]:
            if text.isascii():
                continue
            words = [w for w, _, _ in _sequence(text)]
            for j, w in enumerate(words):
                if w.isascii() or LOST in w or not (known[w] if w in known else marked(w)):
                    continue
                near = _around(words, j)
                pairs[w, ""] += len(near)
                pairs.update((w, v) for v in near if LOST not in v)
        if len(pairs) > 400_000:
            yield pd.DataFrame([(w, v, n) for (w, v), n in pairs.items()], columns=["token", "near", "n"])
            pairs.clear()
    yield pd.DataFrame([(w, v, n) for (w, v), n in pairs.items()], columns=["token", "near", "n"])


def lost_words(damaged: DataFrame, docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, words, near) per damaged text (id, text): all words that fit its patterns, with the collection's counts, and how much likelier than by chance they stand near the text's other words."""
    kind = docs.schema["id"].dataType.simpleString()
    places = materialize(damaged.mapInPandas(_places, f"id {kind}, pattern string, near string").distinct(), "lost-places")
    patterns = places.select("pattern").distinct().withColumn("key", F.regexp_replace("pattern", _LETTERS, LOST))
    fits = counts.filter(F.col("token").rlike(_LETTERS) & F.col("token").rlike("^\\p{L}+$")).withColumn("key", F.regexp_replace("token", _LETTERS, LOST))
    left = F.expr(f"token LIKE replace(pattern, '{LOST}', '_')")  # letters that weren't lost are those of the word
    fits = materialize(fits.join(patterns, "key").filter(left).select("pattern", "token", F.col("n").cast("double").alias("n")), "lost-words")
    doubtful = fits.groupBy("pattern").count().filter("count > 1").select(F.regexp_replace("pattern", _LETTERS, LOST).alias("pattern")).distinct()
    bits = bytearray(MARKS // 8)
    for (m,) in doubtful.mapInPandas(_marks, "mark int").distinct().collect():  # at most MARKS numbers
        bits[m >> 3] |= 1 << (m & 7)
    marks = docs.sparkSession.sparkContext.broadcast(bytes(bits))
    pairs = docs.select("text").mapInPandas(lambda f: _pairs(f, marks.value), "token string, near string, n bigint").groupBy("token", "near").agg(F.sum("n").cast("double").alias("n"))
    pairs = materialize(pairs.join(fits.select("pattern", "token"), "token"), "lost-pairs")  # without words whose bit another one set
    total = counts.agg(F.sum("n")).first()[0] or 1
    p = F.col("c") / F.lit(float(total))
    whole = pairs.filter("near = ''").select("token", F.col("n").alias("all"))
    lifts = (
        pairs.filter("near <> ''").join(counts.select(F.col("token").alias("near"), F.col("n").alias("c")), "near").join(whole, "token")
        .select("pattern", "token", "near", F.log((F.col("n") + DOUBT * p) / ((F.col("all") + DOUBT) * p)).alias("lift"))
    )
    lost = F.col("near").contains(LOST)
    told = places.filter(~lost & (F.col("near") != "")).join(lifts, ["pattern", "near"]).select("id", "token", "near", "lift")
    other = places.filter(lost).withColumnRenamed("near", "other").join(lifts.join(fits.select(F.col("pattern").alias("other"), F.col("token").alias("near")), "near"), ["pattern", "other"]).select("id", "token", "near", "lift")
    near = told.unionByName(other).distinct().groupBy("id").agg(F.collect_list(F.struct("token", "near", "lift")).alias("near"))
    words = places.filter("near = ''").select("id", "pattern").join(fits.join(whole, "token", "left"), "pattern")
    words = words.groupBy("id").agg(F.collect_list(F.struct("pattern", "token", "n", F.coalesce("all", F.lit(0.0)).alias("all"))).alias("words"))
    return words.join(near, "id", "left")


def choose(text: str, words: list[dict], near: list[dict]) -> dict[int, tuple[int, str]]:
    """start -> (end, word) for words with lost letters: Viterbi over all words that fit."""
    fits, score, unseen = defaultdict(list), {}, {}
    for x in sorted(words, key=lambda x: x["token"]):
        fits[x["pattern"]].append(x["token"])
        score[x["token"]] = math.log(x["n"])
        unseen[x["token"]] = SHARE * math.log(DOUBT / (x["all"] + DOUBT))
    extra = defaultdict(list)  # near word -> what it brings more than a word never seen there
    links = defaultdict(list)
    for x in near:
        gain = SHARE * x["lift"] - unseen[x["token"]]
        extra[x["near"]].append((x["token"], gain))
        if x["near"] in score:
            links[x["token"]].append((x["near"], gain))
    sequence = _sequence(text)
    only = [w for w, _, _ in sequence]
    places = [j for j, w in enumerate(only) if w in fits]
    before: dict[str, float] = {}
    last, back = None, []
    for j in places:
        around = [v for v in _around(only, j) if LOST not in v]
        now = {c: score[c] + len(around) * unseen[c] for c in fits[only[j]]}
        for v in around:
            for c, gain in extra.get(v, ()):
                if c in now:
                    now[c] += gain
        came = dict.fromkeys(now)
        if before:
            top = max(before, key=before.get)
            close = j - last <= NEAR
            for c in now:
                best, came[c] = before[top], top
                for v, gain in links.get(c, ()) if close else ():
                    if v in before and before[v] + gain > best:
                        best, came[c] = before[v] + gain, v
                now[c] += best + (unseen[c] if close else 0.0)
        back.append(came)
        before, last = now, j
    out = {}
    c = max(before, key=before.get) if before else None
    for j, came in zip(reversed(places), reversed(back)):
        out[sequence[j][1]] = (sequence[j][2], c)
        c = came[c]
    return out


def fill(text: str, chosen: dict[int, tuple[int, str]]) -> str:
    """The text with the words chosen, in the case of what is left of them."""
    out, at = [], 0
    for m in _RUN.finditer(text):
        to, new = chosen.get(m.start(), (0, ""))
        old = m[0]
        if to != m.end() or len(new) != len(old):
            continue
        if old[:1].isupper() or old[:1] == LOST and old[1:].isupper():
            new = new.upper() if old.replace(LOST, "").isupper() and len(old.replace(LOST, "")) > 1 else new.capitalize()
        if len(new) == len(old):
            out += [text[at : m.start()], new]
            at = m.end()
    return "".join(out) + text[at:]


def decode(text: str, readings: dict[str, dict[int, tuple[float, str]]]) -> tuple[str, list[int]]:
    """(text with the chunks as their channels read them, channels used). readings: chunk -> channel -> (gain, reading). A second search knows the channels that damaged the text elsewhere."""
    _, used = _search(text, readings, {})
    return _search(text, readings, dict.fromkeys(used, AGAIN)) if used else (text, [])


def _search(text: str, readings: dict, enter: dict[int, float]) -> tuple[str, list[int]]:
    """Viterbi over the text's chunks."""
    spans = [m for m in CHUNK.finditer(text)]
    states = sorted({k for m in spans for k in readings.get(m[0], ())})
    if not states:
        return text, []
    best = {-1: 0.0, **{k: -enter.get(k, ENTER) for k in states}}
    back = []
    for m in spans:
        own = readings.get(m[0], {})
        step, came = {}, {}
        out_best = max(best, key=best.get)
        for k in best:
            stay = best[k]
            other = best[out_best] - (LEAVE if k == -1 else enter.get(k, ENTER if out_best == -1 else CHANGE))
            came[k] = k if stay >= other else out_best
            gain = 0.0 if k == -1 else own[k][0] if k in own else -12.0
            step[k] = max(stay, other) + gain
        back.append(came)
        best = step
    k = max(best, key=best.get)
    path = []
    for came in reversed(back):
        path.append(k)
        k = came[k]
    path.reverse()
    out, at, used = [], 0, set()
    for m, k in zip(spans, path):
        out.append(text[at : m.start()])
        if k >= 0 and k in readings.get(m[0], {}):
            used.add(k)
            out.append(m[0] if k == len(CHANNELS) else readings[m[0]][k][1])
        else:
            out.append(m[0])
        at = m.end()
    out.append(text[at:])
    return "".join(out), sorted(used)


def _decode(frames):
    names = [c[0] for c in CHANNELS] + ["bytes lost"]
    for pdf in frames:
        out = []
        for i, text, found in zip(pdf["id"], pdf["text"], pdf["found"]):
            readings: dict = {}
            for x in found:
                readings.setdefault(x["chunk"], {})[x["channel"]] = (x["gain"], x["reading"])
            read, used = decode(text, readings)
            if used:
                out.append((i, read, [names[k] for k in used]))
        yield pd.DataFrame(out, columns=["id", "text", "channels"])


def _wording(frames):
    for pdf in frames:
        out = []
        for i, text, channels, words, near in zip(pdf["id"], pdf["text"], pdf["channels"], pdf["words"], pdf["near"]):
            if words is not None:
                text = fill(text, choose(text, list(words), [] if near is None else list(near)))
            out.append((i, text, channels, LOST not in text))
        yield pd.DataFrame(out, columns=["id", "restored", "channels", "whole"])


def damaged(texts: DataFrame, counts: DataFrame, id_col: str = "id", column: str = "data") -> DataFrame:
    """(id, text, channels) of the damaged texts, read through their channels; lost letters are still lost."""
    kind = texts.schema[id_col].dataType.simpleString()
    src = spread(texts.select(id_col, column).filter(F.col(column).isNotNull() & F.col(id_col).isNotNull()))
    chunks = materialize(src.mapInPandas(lambda f: _chunks(f, id_col, column), f"id {kind}, chunk string"), "chunks")
    found = chunks.join(scored_readings(chunks, counts), "chunk").groupBy("id").agg(F.collect_list(F.struct("chunk", "channel", "reading", "gain")).alias("found"))
    found = materialize(found, "chunk-readings")
    docs = keep_keys(texts.select(F.col(id_col).alias("id"), F.col(column).alias("text")).filter("text IS NOT NULL"), found.select("id"), "id")
    return docs.join(found, "id").mapInPandas(_decode, f"id {kind}, text string, channels array<string>")


def restore(texts: DataFrame, id_col: str = "id", column: str = "data", counts: DataFrame | None = None, wording: bool = True) -> DataFrame:
    """(id, restored, channels, whole) of the damaged texts; whole is false where lost bytes remain. Without wording the same texts are found, and lost letters stay lost."""
    counts = materialize(frequencies(texts, column) if counts is None else counts, "word-counts")
    kind = texts.schema[id_col].dataType.simpleString()
    docs = damaged(texts, counts, id_col, column)
    if not wording:
        return docs.select("id", F.col("text").alias("restored"), "channels", (~F.col("text").contains(LOST)).alias("whole"))
    docs = materialize(docs, "decoded")
    src = spread(texts.select(F.col(id_col).alias("id"), F.col(column).alias("text")).filter(F.col(column).isNotNull() & F.col(id_col).isNotNull()))
    words = lost_words(docs.filter(F.col("text").contains(LOST)).select("id", "text"), src, counts)
    return docs.join(words, "id", "left").mapInPandas(_wording, f"id {kind}, restored string, channels array<string>, whole boolean")
