"""Bringing text that looks the same to one form.

Compatibility normalization (width forms, ligatures, kinds of space and hyphen) and deletion of ignorable
characters come first. Then every word is read as a lattice: each letter may be any letter of its look-alike class.
A Viterbi search picks the path with the best character bigram score, the bigrams being counted over the whole
collection, where a change of script inside a word costs more than any bigram can give. The lattice depends only on
what the word looks like, so words that look alike always get the same reading.

Words with a letter that only Latin has, and otherwise letters that Latin has, have one path within one script;
they are decided without the search. Zero-width joiners between pictographs stay, since they change the look.

Defined cases: null texts have no form and no pair; empty texts, and texts of ignorable characters only, share the
empty form; exact copies are no pair among themselves; a null id is kept as a row but is in no pair; extra columns
are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweh.runtime import materialize, spread

# Letters of Cyrillic and Greek that look like the Latin letter they stand behind.
LOOKALIKES = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іⅰ", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
# Letters of Cherokee that look like the Latin letter they stand behind.
CHEROKEE = {"A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Y": "Ꭹ", "Z": "Ꮓ"}
LOOKALIKES = {base: LOOKALIKES.get(base, "") + CHEROKEE.get(base, "") for base in [*LOOKALIKES, *(x for x in CHEROKEE if x not in LOOKALIKES)]}
# Kinds of hyphen; format characters that have a look; characters that have none though their category doesn't say so.
HYPHENS = "\u2010\u2011\u2012\u2043\ufe63\uff0d"
SEEN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\ufff9\ufffa\ufffb\U000110bd\U000110cd"
BLANK = "\u00ad\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"


def _table() -> dict[int, str | None]:
    """What each character is read as, from the properties of all characters: characters without a look are dropped, kinds of space and hyphen are one, and characters that are another one in another width, font or place, or several in one, are those. Raised, lowered and encircled ones stay, since they look different."""
    one: dict[int, str | None] = {}
    for o in (*range(0x80, 0x20000), *range(0xE0000, 0xE1000)):
        c = chr(o)
        kind = unicodedata.category(c)
        variant = 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or o >= 0xE0000
        if c in BLANK or variant or kind == "Cf" and c not in SEEN:
            one[o] = None
        elif kind == "Zs":
            one[o] = " "
        elif c in HYPHENS:
            one[o] = "-"
    plain: dict[int, str | None] = dict(one)
    for o in (*range(0x80, 0xAC00), *range(0xF900, 0x20000)):
        form, c = unicodedata.decomposition(chr(o)), chr(o)
        if o in one or not form.startswith("<"):
            continue
        tag = form[1 : form.index(">")]
        whole = unicodedata.normalize("NFKC", c)
        several = tag == "compat" and (unicodedata.category(c)[0] == "L" and len(whole) > 1 and whole.isalpha() or set(whole) == {"."} or 0x2160 <= o < 0x2180)
        if tag in ("wide", "narrow", "small", "font", "square", "isolated", "initial", "medial", "final") or several:
            if 0xFFA1 <= o <= 0xFFDC:  # jamo stay apart
                whole = chr(int(form.split()[1], 16))
            plain[o] = "".join(one.get(ord(x), x) or "" for x in whole)
    plain[0xB5] = "\u03bc"
    del plain[0x200D]  # joins pictographs; elsewhere it is dropped before
    return plain


_PLAIN = _table()
IGNORABLE = "".join(chr(o) for o, said in _PLAIN.items() if said is None)
CLASS = {x: base for base, others in LOOKALIKES.items() for x in base + others}
_SKELETON = str.maketrans({x: base for x, base in CLASS.items() if x != base})
_PICTURE = "\U0001f000-\U0001faff\u2600-\u27bf"
_JOINER = re.compile(f"(?<![{_PICTURE}\ufe0f])\u200d|\u200d(?![{_PICTURE}])")
_FLAG = re.compile("\U0001f3f4[\U000e0020-\U000e007f]+")  # tags spell the flags of regions


def _ranges(codes) -> str:
    """A character class of the codes."""
    out, codes = [], sorted(codes)
    for o in codes:
        if out and o == out[-1][1] + 1:
            out[-1][1] = o
        else:
            out.append([o, o])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in out)


_SPECIAL = re.compile(f"[{_ranges([*_PLAIN, 0x200D])}]")
_WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
_OPEN_ASCII = re.compile(rf"(?<![A-Za-z])[{''.join(sorted(LOOKALIKES))}]+(?![A-Za-z])")
_ONLY_LATIN = re.compile("[A-Za-zÀ-ɏ̀-ͯ]+")
_LATIN_ANCHOR = re.compile("[bfkmnrtuzFNUÀ-ɏ]")  # letters that no other script has

SWITCH = 1e4  # no word of under 500 letters gains as much by its bigrams


def plain(text: str) -> str:
    """Compatibility normalization and deletion of ignorable characters; composed accents."""
    if text.isascii():
        return text
    if _SPECIAL.search(text):
        if "\u200d" in text:
            text = _JOINER.sub("", text)
        if "\U0001f3f4" in text and (flags := _FLAG.findall(text)):
            parts = _FLAG.split(text)
            text = "".join(x for part, flag in zip(parts, [*flags, ""]) for x in (part.translate(_PLAIN), flag))
        else:
            text = text.translate(_PLAIN)
    return unicodedata.normalize("NFC", text)


def skeleton(text: str) -> str:
    """What the text looks like, in Latin letters where there are any."""
    text = plain(text)
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SKELETON))


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or c == "ɡ" or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    return "C" if 0x400 <= o < 0x530 else "K" if 0x13A0 <= o < 0x1400 else "-"


class Reader:
    """Reads words under character bigram counts {pair: n}; ^ and $ stand for a word's ends."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.first: Counter = Counter()
        for pair, n in counts.items():
            self.first[pair[0]] += n
        self.cache: dict[str, str] = {}
        self.clean: set[str] = set()

    def _score(self, a: str, b: str) -> float:
        return math.log((self.counts.get(a + b, 0) + 0.01) / (self.first[a] + 10.0))

    def word(self, word: str) -> str:
        looks = unicodedata.normalize("NFD", word).translate(_SKELETON)
        got = self.cache.get(looks)
        if got is None:
            got = self.cache[looks] = self._decode(looks)
        return got

    def _decode(self, looks: str) -> str:
        if not any(c in LOOKALIKES for c in looks) or _ONLY_LATIN.fullmatch(looks) and _LATIN_ANCHOR.search(looks):
            return unicodedata.normalize("NFC", looks)
        paths = {("^", ""): (0.0, "")}  # (letter, script) -> (score, reading)
        for c in looks:
            step: dict = {}
            mark = unicodedata.combining(c)
            for x in c + LOOKALIKES.get(c, ""):
                own = "" if mark else script(x)
                best = None
                for (a, s), (score, said) in paths.items():
                    if mark:
                        key, now = (a, s), score
                    else:
                        key = (x, own)
                        now = score + self._score(a, x) - (SWITCH if s and own != s else 0)
                    if best is None or now > best[1]:
                        best = (key, now, said + x)
                    if mark:
                        step[key] = (now, said + x)
                if not mark:
                    step[best[0]] = best[1:]
            paths = step
        ends = [(score + self._score(a, "$"), said) for (a, _), (score, said) in paths.items()]
        return unicodedata.normalize("NFC", max(ends, key=lambda e: e[0])[1])

    def text(self, text: str) -> str:
        text = plain(text)
        if text.isascii():
            words = set(_OPEN_ASCII.findall(text)) - self.clean
            for w in words:
                if self.word(w) == w:
                    self.clean.add(w)
            if words <= self.clean:
                return text
        return _WORD.sub(lambda m: self.word(m[0]), text)


def _count(frames, column: str):
    words: Counter = Counter()
    pairs: Counter = Counter()

    def fold():
        for w, n in words.items():
            w = f"^{w}$"
            for i in range(len(w) - 1):
                if (w[i] in "^" or script(w[i]) != "-") and (w[i + 1] in "$" or script(w[i + 1]) != "-"):
                    pairs[w[i : i + 2]] += n
        words.clear()

    for pdf in frames:
        for text in pdf[column]:
            if text:
                words.update(re.findall(r"[^\W\d_]+", text))
        if len(words) > 500_000:  # bounds memory; what is counted stays the same
            fold()
    fold()
    yield pd.DataFrame(list(pairs.items()), columns=["pair", "n"])


def bigrams(docs: DataFrame, column: str = "text") -> DataFrame:
    """(pair, n): counts of letter pairs over all texts. Letters are those of four scripts, so the table has a bound that no collection exceeds."""
    return spread(docs.select(column)).mapInPandas(lambda frames: _count(frames, column), "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def model(docs: DataFrame, column: str = "text") -> dict[str, int]:
    return {r["pair"]: r["n"] for r in bigrams(docs, column).collect()}


def forms(docs: DataFrame, id_col: str = "doc_id", column: str = "text", counts: dict[str, int] | None = None, hashed: bool = False) -> DataFrame:
    """(id, form): the one form of each text; hashed gives (id, form_hash, text_hash) of 128 bits each instead."""
    counts = model(docs, column) if counts is None else counts

    def read(frames):
        reader = Reader(counts)
        digest = lambda s: blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for pdf in frames:
            out = []
            for i, text in zip(pdf[id_col], pdf[column]):
                form = reader.text(text)
                out.append((i, digest(form), digest(text)) if hashed else (i, form))
            frame = pd.DataFrame(out, columns=[id_col, "form_hash", "text_hash"] if hashed else [id_col, "form"])
            frame[id_col] = frame[id_col].astype(pdf[id_col].dtype)
            yield frame

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, column).filter(F.col(column).isNotNull())).mapInPandas(read, f"{id_col} {kind}, " + ("form_hash binary, text_hash binary" if hashed else "form string"))


def same_look(docs: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: pairs of different texts of one form.

    Distinct texts are paired, not documents: copies, however many, are one row until the pairs of texts are known, and a form with one text is dropped before any join."""
    f = materialize(forms(docs, id_col, column, hashed=True).filter(F.col(id_col).isNotNull()), "forms")
    texts = f.groupBy("form_hash", "text_hash").agg(F.lit(1).alias("one")).drop("one")
    mixed = texts.groupBy("form_hash").agg(F.count("*").alias("n")).filter("n > 1").select("form_hash")
    texts = texts.join(mixed, "form_hash", "left_semi")
    a, b = texts.withColumnRenamed("text_hash", "ta"), texts.withColumnRenamed("text_hash", "tb")
    pairs = a.join(b, "form_hash").filter("ta < tb").select("ta", "tb")
    first = f.select(F.col("text_hash").alias("ta"), F.col(id_col).alias("x"))
    second = f.select(F.col("text_hash").alias("tb"), F.col(id_col).alias("y"))
    both = pairs.join(first, "ta").join(second, "tb")
    return both.filter("x != y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def look_classes(docs: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, look, texts): the class of each document of which others look the same though they are different strings, and how many strings the class has. A row per document, however many copies there are."""
    f = materialize(forms(docs, id_col, column, hashed=True).filter(F.col(id_col).isNotNull()), "forms")
    texts = f.groupBy("form_hash", "text_hash").agg(F.lit(1).alias("one")).groupBy("form_hash").agg(F.count("*").alias("texts")).filter("texts > 1")
    return f.join(texts, "form_hash").select(F.col(id_col).alias("doc_id"), F.lower(F.hex("form_hash")).alias("look"), "texts").distinct()
