"""Bytes of files to text: plain text, markup, office formats, mail, notebooks, calendars, books.

Files come as rows of Spark's binaryFile source and are read in Arrow batches; a file that can't be read becomes a row
with a status, never a failed task. Pages are joined by form feeds. Formats that need a library which isn't at hand
(PDF, pictures, sound) have a plug-in point: register(ext, function).

Defined cases: null or empty bytes are `skipped` with note `empty`; binary bytes `skipped`, `binary`; a reader's error
is `error` with its message; texts are cut at MOST_CHARS with note `truncated`; private keys are removed.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from email import message_from_bytes, policy
from html import unescape
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweh.functions import paths
from fernweh.sources import legacy as compound

MOST_CHARS = 2_000_000
MOST_TEXT, MOST_DOCUMENT = 8 << 20, 64 << 20
PART_BYTES, ALL_BYTES, PARTS = 16 << 20, 32 << 20, 2048
SCHEMA = "path string, status string, note string, text string, chars bigint"
_plugins: dict = {}


def register(ext: str, reader) -> None:
    """reader(bytes) -> text for an extension; `extracted` takes those known when it is called along to the executors."""
    _plugins[ext] = reader


# --- plain text ---


def is_binary(data: bytes) -> bool:
    """By the first bytes: a NUL, unless a mark says UTF-16, or more than a tenth of control characters."""
    head = data[:8192]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return False
    if b"\0" in head:
        return True
    control = sum(b < 32 and b not in (7, 8, 9, 10, 12, 13, 27) for b in head)
    return control * 10 > len(head)


def decode(data: bytes) -> str:
    """By its mark, as UTF-8 if nearly all of it is, else as windows-1252."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(codec, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        loose = data.decode("utf-8", "replace")
        if loose.count("�") < 0.01 * len(loose):
            return loose
        return data.decode("cp1252", "replace")


def tidy(text: str) -> str:
    text = re.sub(r"\r\n?", "\n", text)
    text = re.sub(r"[ \t]+(?=\n|\f|$)", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip(" \t\n")


# --- markup ---


class _Html(HTMLParser):
    SKIP = {"script", "style", "noscript", "template", "svg"}
    BLOCK = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "blockquote", "pre", "table", "ul", "ol", "dl", "dt", "dd", "hr", "title", "figure", "form", "main", "nav", "aside", "option"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.head, self.title = [], 0, 0, 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.head += tag == "head"
        self.title += tag == "title"
        self.out.append("\n" if tag in self.BLOCK else "\t" if tag in ("td", "th") else "")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        self.head = max(0, self.head - (tag == "head"))
        self.title = max(0, self.title - (tag == "title"))
        self.out.append("\n" if tag in self.BLOCK else "")

    def handle_data(self, data):
        if not self.skip and (not self.head or self.title):
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    p = _Html()
    p.feed(html)
    p.close()
    return tidy(re.sub(r"(?m)^[ \t]+|[ \t]+$", "", "".join(p.out)))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xml_text(data: bytes, text: set[str] | None, line: set[str], tab: set[str] = frozenset(), skip: set[str] = frozenset(), page: set[str] = frozenset()) -> str:
    """Text of an XML part: what text elements hold (all if None), with line, tab and page ends."""
    out: list[str] = []

    def walk(e, inside: bool):
        name = _local(e.tag) if isinstance(e.tag, str) else ""
        if name in skip:
            return
        inside = inside or text is None or name in text
        if name in page:
            out.append("\f")
        if name in tab:
            out.append("\t")
        if inside and e.text:
            out.append(e.text)
        for c in e:
            walk(c, inside)
            if inside and c.tail and (text is None or name in text):
                out.append(c.tail)
        if name in line:
            out.append("\n")

    walk(ElementTree.fromstring(data), text is None)
    return "".join(out)


# --- packages ---


class Package:
    """A zip file read within budgets."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if len(self.zip.infolist()) > PARTS:
            raise ValueError("too many parts")
        self.left = ALL_BYTES

    def names(self, pattern: str) -> list[str]:
        number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        return sorted((n for n in self.zip.namelist() if re.fullmatch(pattern, n)), key=number)

    def read(self, name: str) -> bytes:
        info = self.zip.getinfo(name)
        if info.file_size > min(PART_BYTES, self.left):
            raise ValueError("over the budget for its contents")
        with self.zip.open(name) as f:
            data = f.read(min(PART_BYTES, self.left) + 1)
        self.left -= len(data)
        return data

    def rels(self, name: str) -> dict[str, str]:
        folder, _, base = name.rpartition("/")
        rel = f"{folder}/_rels/{base}.rels" if folder else f"_rels/{base}.rels"
        if rel not in self.zip.namelist():
            return {}
        out = {}
        for e in ElementTree.fromstring(self.read(rel)):
            target = e.get("Target", "")
            parts: list[str] = [] if target.startswith("/") else folder.split("/")
            for step in target.lstrip("/").split("/"):
                parts = parts[:-1] if step == ".." else [*parts, step] if step != "." else parts
            out[e.get("Id", "")] = "/".join(p for p in parts if p)
        return out


def docx(data: bytes) -> str:
    p = Package(data)
    parts = [*p.names(r"word/document\d*\.xml"), *p.names(r"word/(?:header|footer|footnotes|endnotes|comments)\d*\.xml")]
    return "\n\n".join(t for n in parts if (t := tidy(xml_text(p.read(n), {"t"}, {"p", "br", "tr"}, {"tab", "tc"}, {"instrText", "delText"}))))


def pptx(data: bytes) -> str:
    p = Package(data)
    order = []
    if "ppt/presentation.xml" in p.zip.namelist():
        rels = p.rels("ppt/presentation.xml")
        for e in ElementTree.fromstring(p.read("ppt/presentation.xml")).iter():
            if _local(e.tag) == "sldId":
                order.append(rels.get(next((v for k, v in e.attrib.items() if _local(k) == "id" and "}" in k), ""), ""))
    order = [n for n in order if n in p.zip.namelist()] or p.names(r"ppt/slides/slide\d+\.xml")
    pages = []
    for n in order:
        text = tidy(xml_text(p.read(n), {"t"}, {"p", "br"}))
        notes = [tidy(xml_text(p.read(x), {"t"}, {"p"})) for x in p.rels(n).values() if "notesSlide" in x and x in p.zip.namelist()]
        pages.append("\n".join([text, *notes]).strip())
    return "\f".join(pages)


def xlsx(data: bytes) -> str:
    p = Package(data)
    shared = []
    if "xl/sharedStrings.xml" in p.zip.namelist():
        for si in ElementTree.fromstring(p.read("xl/sharedStrings.xml")):
            shared.append("".join(e.text or "" for e in si.iter() if _local(e.tag) == "t"))
    rels = p.rels("xl/workbook.xml")
    pages = []
    for s in (e for e in ElementTree.fromstring(p.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"):
        target = rels.get(next((v for k, v in s.attrib.items() if _local(k) == "id" and "}" in k), ""), "")
        if target not in p.zip.namelist():
            continue
        rows = [s.get("name", "")]
        for row in (e for e in ElementTree.fromstring(p.read(target)).iter() if _local(e.tag) == "row"):
            cells = []
            for c in row:
                kind = c.get("t", "n")
                raw = "".join(e.text or "" for e in c.iter() if _local(e.tag) in ("v", "t"))
                if kind == "s" and raw.isdigit() and int(raw) < len(shared):
                    raw = shared[int(raw)]
                elif kind == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                cells.append(raw)
            rows.append("\t".join(cells).rstrip("\t"))
        pages.append("\n".join(rows).strip())
    return "\f".join(pages)


_ODF = dict(text=None, line={"p", "h", "line-break", "table-row"}, tab={"tab", "table-cell"}, skip={"annotation", "tracked-changes", "styles", "automatic-styles", "font-face-decls", "meta", "settings", "scripts"})


def odf(data: bytes) -> str:
    return tidy(xml_text(Package(data).read("content.xml"), **_ODF))


def flat_odf(data: bytes) -> str:
    return tidy(xml_text(data, **_ODF))


def epub(data: bytes) -> str:
    p = Package(data)
    root = next(e.get("full-path") for e in ElementTree.fromstring(p.read("META-INF/container.xml")).iter() if _local(e.tag) == "rootfile")
    tree = ElementTree.fromstring(p.read(root))
    items = {e.get("id"): e.get("href") for e in tree.iter() if _local(e.tag) == "item"}
    folder = root.rpartition("/")[0]
    names = [(f"{folder}/" if folder else "") + items[e.get("idref")] for e in tree.iter() if _local(e.tag) == "itemref" and e.get("idref") in items]
    return "\f".join(t for n in names if n in p.zip.namelist() and (t := html_text(decode(p.read(n)))))


# --- others ---


def rtf(data: bytes) -> str:
    """Text of an RTF file: destinations that hold no text are left out."""
    src = data.decode("latin-1")
    out, stack, skip, uc, drop = [], [], False, 1, 0
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)", src, re.S):
        word, arg, hexa, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append((skip, uc))
        elif brace == "}":
            skip, uc = stack.pop() if stack else (False, 1)
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "themedata", "listtable", "generator"):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif word == "page":
            out.append("\f")
        elif word == "uc":
            uc = int(arg or 1)
        elif word == "u":
            out.append(chr(int(arg or 63) & 0xFFFF))
            drop = uc
        elif hexa:
            if drop:
                drop -= 1
            else:
                out.append(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
        elif sign and sign in "\\{}":
            out.append(sign)
        elif sign == "~":
            out.append(" ")
        elif plain:
            out.append(plain[drop:])
            drop = max(0, drop - len(plain))
    return tidy("".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def mail(data: bytes) -> str:
    """Head lines, then the body: plain text before HTML, attachments left out."""
    m = message_from_bytes(data, policy=policy.default)
    head = [f"{k.title()}: {m[k]}" for k in ("subject", "from", "to", "cc", "date") if m[k]]

    def body(part) -> list[str]:
        if part.get_content_disposition() == "attachment":
            return []
        if part.is_multipart():
            parts = list(part.iter_parts()) if hasattr(part, "iter_parts") else part.get_payload()
            if part.get_content_subtype() == "alternative":
                plain = [x for x in parts if x.get_content_type() == "text/plain"]
                parts = plain[:1] or parts[-1:]
            return [t for x in parts for t in body(x)]
        if part.get_content_maintype() != "text":
            return []
        raw = part.get_payload(decode=True) or b""
        try:
            text = raw.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            text = raw.decode("latin-1")
        return [html_text(text) if part.get_content_subtype() == "html" else text]

    return tidy("\n".join(head) + "\n\n" + "\n\n".join(body(m)))


def notebook(data: bytes) -> str:
    cells = json.loads(data).get("cells") or []
    return tidy("\n\n".join("".join(c.get("source") or "") for c in cells))


_PIM = re.compile(r"^(SUMMARY|DESCRIPTION|LOCATION|DTSTART|DTEND|ORGANIZER|ATTENDEE|COMMENT|FN|N|ORG|TITLE|EMAIL|TEL|ADR|NOTE|URL|BDAY|NICKNAME)(?:;[^:]*)?:(.*)$", re.I)


def calendar(data: bytes) -> str:
    """Fields of calendars and cards, unfolded and unescaped."""
    src = re.sub(r"\r?\n[ \t]", "", decode(data))
    out = []
    for line in src.splitlines():
        if m := _PIM.match(line.partition(".")[2] if re.match(r"item\d+\.", line) else line):
            value = re.sub(r"\\([nN,;\\])", lambda x: "\n" if x[1] in "nN" else x[1], m[2]).strip(";").replace(";", " ")
            out.append(f"{m[1].lower()}: {value}")
    return tidy("\n".join(out))


def palmdoc(record: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(record):
        b = record[i]
        i += 1
        if 1 <= b <= 8:
            out += record[i : i + b]
            i += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((32, b ^ 0x80))
        elif i < len(record):
            pair = (b << 8 | record[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("corrupt book")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def mobi(data: bytes) -> str:
    n = struct.unpack(">H", data[76:78])[0]
    at = [struct.unpack(">I", data[78 + 8 * k : 82 + 8 * k])[0] for k in range(n)] + [len(data)]
    head = data[at[0] : at[1]]
    kind, _, _, count = struct.unpack(">HHIH", head[:10])
    if kind not in (1, 2) or len(head) > 14 and struct.unpack(">H", head[12:14])[0]:
        raise ValueError("unsupported or encrypted book")
    raw = b"".join(palmdoc(data[at[k] : at[k + 1]]) if kind == 2 else data[at[k] : at[k + 1]] for k in range(1, min(count, n - 1) + 1))
    utf8 = len(head) > 32 and struct.unpack(">I", head[28:32])[0] == 65001
    return html_text(raw.decode("utf-8" if utf8 else "cp1252", "replace"))


def strings(data: bytes, least: int = 5) -> str:
    """Runs of printable characters, of one or two bytes each: what can be had of legacy formats."""
    narrow = [m[0].decode("cp1252", "replace") for m in re.finditer(rb"[\x20-\x7e\xa0-\xff\t]{%d,}" % least, data)]
    wide = [m[0].decode("utf-16-le", "replace") for m in re.finditer(rb"(?:[\x20-\x7e\xa0-\xff]\0){%d,}" % least, data)]
    return tidy("\n".join(x for x in (wide if sum(map(len, wide)) > sum(map(len, narrow)) else narrow) if re.search(r"\w{3}", x)))


def legacy(data: bytes) -> str:
    """Old office files, which often are something else under that name."""
    if data[:4] == b"PK\3\4":
        names = zipfile.ZipFile(io.BytesIO(data)).namelist()
        for start, reader in (("word/", docx), ("ppt/", pptx), ("xl/", xlsx), ("content.xml", odf)):
            if any(n.startswith(start) for n in names):
                return reader(data)
    if data[:5] == b"{\\rtf":
        return rtf(data)
    if re.match(rb"\s*(?:<!doctype html|<html|<\?xml|<table)", data[:512], re.I):
        return html_text(decode(data))
    if data[:8] == compound.MAGIC:
        return compound.text(data)
    if is_binary(data):
        raise ValueError("not a valid document")
    return decode(data)


READERS = {
    "html": lambda d: html_text(decode(d)), "docx docm dotx dotm": docx, "pptx pptm ppsx potx potm": pptx, "xlsx xlsm xltx xltm": xlsx, "odt ott ods ots odp otp": odf, "fodt fods fodp": flat_odf, "epub": epub, "rtf": rtf, "eml emlx": mail, "ipynb": notebook, "ics vcf": calendar, "mobi": mobi, "doc xls ppt dot xlt pot pps": legacy,
}
READERS["htm xhtml"] = READERS["html"]
_BY_EXT = {e: r for exts, r in READERS.items() for e in exts.split()}

_KEY = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----.*?(?:-----END \1PRIVATE KEY-----|\Z)", re.S)


def extract(name: str, data: bytes | None, readers: dict | None = None) -> tuple[str, str | None, str | None]:
    """(status, note, text) of one file. readers by extension come before the built-in ones; without them those registered here do."""
    ext = name.rpartition(".")[2].lower() if "." in name[1:] else ""
    reader = (_plugins if readers is None else readers).get(ext) or _BY_EXT.get(ext)
    if not data:
        return "skipped", "empty", None
    if len(data) > (MOST_DOCUMENT if reader else MOST_TEXT):
        return "skipped", "too-large", None
    try:
        if reader:
            text = reader(data)
        elif ext in ("pdf", *paths.OCR_EXTS, *paths.MEDIA_EXTS):
            return "skipped", "unsupported", None
        elif is_binary(data):
            return "skipped", "binary", None
        else:
            text = decode(data)
    except PermissionError:
        return "error", "permission denied", None
    except Exception as e:  # whatever a file makes a reader do, it costs this file only
        return "error", (str(e) or type(e).__name__)[:200], None
    text = re.sub(r"\r\n?", "\n", text.replace("\0", ""))
    if not text.strip():
        return "skipped", "empty", None
    bare = _KEY.sub("[private key removed]", text)
    if not bare.replace("[private key removed]", "").strip():
        return "skipped", "secret", None
    return "indexed", "truncated" if len(bare) > MOST_CHARS else None, bare[:MOST_CHARS]


def extracted(files: DataFrame) -> DataFrame:
    """Rows (path, content) to (path, status, note, text, chars)."""
    readers = dict(_plugins)  # goes along; a worker's own table is empty

    def run(frames):
        for pdf in frames:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                status, note, text = extract(path.rpartition("/")[2], None if data is None else bytes(data), readers)
                rows.append((path, status, note, text, len(text or "")))
            yield pd.DataFrame(rows, columns=["path", "status", "note", "text", "chars"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Texts of all files below a folder; the listing is Spark's, the bytes never pass the driver."""
    src = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return extracted(src.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"))


def merge_pages(own: DataFrame, scanned: DataFrame) -> DataFrame:
    """(id, text): pages with under three letters or digits take the recognised page in their place."""
    blank = lambda p: F.length(F.regexp_replace(p, r"[^\p{L}\p{N}]", "")) < 3
    j = own.select("id", F.split("text", "\f", -1).alias("a")).join(scanned.select("id", F.split("text", "\f", -1).alias("b")), "id", "left")
    pages = F.zip_with("a", F.coalesce("b", F.array().cast("array<string>")), lambda a, b: F.when(a.isNull(), b).when(blank(a) & b.isNotNull(), b).otherwise(a))
    return j.select("id", F.array_join(F.slice(pages, 1, F.size("a")), "\f").alias("text"))


def entities(text: str) -> str:
    return unescape(text)
