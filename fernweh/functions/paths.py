"""Paths, extensions and kinds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind.
EXTENSIONS = {
    "code": "c h cc cpp hpp cs go rs swift py ipynb rb php pl lua r jl hs ml clj scala java kt js mjs jsx ts tsx vue sh bash zsh ps1 bat sql css scss tf cmake",
    "markdown": "md markdown rst adoc org tex bib",
    "text": "txt log srt vtt diff patch",
    "data": "json jsonl ndjson yaml yml toml ini cfg conf xml plist csv tsv",
    "web": "html htm xhtml svg",
    "pdf": "pdf",
    "doc": "doc docx docm odt rtf pages",
    "sheet": "xls xlsx xlsm xlsb ods numbers",
    "slides": "ppt pptx pptm ppsx odp key",
    "ebook": "epub mobi azw3 fb2 djvu",
    "email": "eml emlx msg mbox ics vcf",
    "image": "png jpg jpeg gif bmp tif tiff webp heic heif avif ico icns raw cr2 cr3 nef arw dng orf rw2 psd xcf ai eps sketch fig",
    "audio": "mp3 wav flac aac m4a ogg oga opus wma aiff aif alac mid midi caf",
    "video": "mp4 m4v mov avi mkv webm wmv flv mpg mpeg 3gp ogv",
    "archive": "zip tar gz tgz bz2 xz zst 7z rar dmg iso jar",
    "app": "app exe dll so dylib class pyc wasm bin",
}
# Kinds of names without an extension.
NAMES = {"code": "makefile dockerfile containerfile justfile rakefile gemfile procfile jenkinsfile", "text": "readme license licence copying authors changelog notice todo"}
TEXTUAL = ("code", "text", "markdown", "data", "web")
OCR_EXTS = ("png", "jpg", "jpeg", "heic", "heif", "tif", "tiff", "webp", "bmp", "gif")
MEDIA_EXTS = ("mp3", "wav", "flac", "aac", "m4a", "aiff", "aif", "caf", "mp4", "m4v", "mov")
DOCUMENT_EXTS = tuple("pages numbers key pdf docx docm dotx dotm dot xlsx xlsm xltx xltm xlt pptx pptm ppsx potx potm pot pps odt ott ods ots odp otp fodt fods fodp rtf epub mobi doc xls ppt eml emlx ipynb".split())
# Names by which a filter may call kinds; several names of one line mean the same.
ALIASES = [
    ("dir dirs folder folders directory", "folder"), ("code source src", "code"), ("text", "text markdown"), ("txt", "text"), ("md markdown", "markdown"), ("note notes", "markdown text"), ("data config", "data"), ("web html", "web"), ("pdf", "pdf"), ("doc", "doc pdf"),
    ("docs document documents", "doc pdf markdown text slides sheet ebook"), ("word", "doc"), ("sheet sheets spreadsheet excel xls", "sheet"), ("slides slide presentation powerpoint ppt", "slides"), ("ebook book", "ebook"), ("email mail", "email"),
    ("image images img photo photos picture", "image"), ("audio music sound", "audio"), ("video videos movie", "video"), ("archive zip", "archive"), ("app binary", "app"), ("other", "other"),
]
KIND_ALIASES = {name: kinds.split() for names, kinds in ALIASES for name in names.split()}


KIND_OF_EXT = {e: kind for kind, exts in EXTENSIONS.items() for e in exts.split()}


def ext_of(name: Column) -> Column:
    """Lower-case extension; '' for names that begin with their only dot, end in one or have none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def kind_of(name: Column, is_dir: Column) -> Column:
    ext, lower = ext_of(name), F.lower(name)
    named = _lookup({n: kind for kind, names in NAMES.items() for n in names.split()})
    return (
        F.when(is_dir & name.endswith(".app"), "app").when(is_dir, "folder")
        .otherwise(F.coalesce(
            F.try_element_at(_lookup(KIND_OF_EXT), ext), F.try_element_at(named, lower), F.try_element_at(named, F.regexp_replace(lower, r"\.[^.]*$", "")),
            F.when(lower.rlike(r"^\..*(?:rc|profile|config|ignore|env)$"), "data"), F.lit("other"),
        ))
    )


def under(path: Column, folder: str) -> Column:
    """Strictly below the folder."""
    return F.lit(True) if folder == "/" else path.startswith(folder + "/")


def display(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.substring(path, len(home) + 2, 1 << 20)).otherwise(path)


def tildify(path: Column, home: str) -> Column:
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~/"), F.substring(path, len(home) + 2, 1 << 20))).otherwise(path)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.when(F.length(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)) == 0, "/").otherwise(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)))


def base(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def ancestors(path: Column) -> Column:
    """Folders that hold the path, outermost first, without the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
