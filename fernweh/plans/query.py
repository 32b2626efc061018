"""The query language: text, filters, modes and groups, parsed into plain data. Nothing here touches Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone

from fernweh.functions.paths import KIND_ALIASES, KIND_OF_EXT

DAY = 86_400_000
# Units of sizes (powers of 1024) and of ages (ms), words that choose a mode.
SIZE_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}
AGE_UNITS = {"s": 1000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": DAY, "w": 7 * DAY, "mo": 30 * DAY, "y": 365 * DAY}
MODES = {"re:": ("find", True), "regex:": ("find", True), "find:": ("find", False), "exact:": ("find", False), "grep:": ("find", False), "fuzzy:": ("fuzzy", False), "f:": ("fuzzy", False), "semantic:": ("semantic", False), "meaning:": ("semantic", False), "s:": ("semantic", False)}
KEYS = "created tag name sort case word diacritics near fold ext type kind in dir path size mtime modified changed after before since limit is".split()
SORTS = re.compile(r"-?(?:name|size|date|path)$")
FLAGS = "dgimsuvy"
MOST_RESULTS, MOST_NODES, MOST_DEPTH, MOST_NEAR = 5000, 64, 12, 1000


@dataclass(frozen=True)
class Filters:
    exts: frozenset | None = None
    kinds: frozenset | None = None
    not_kinds: frozenset | None = None
    within: tuple = ()
    path_has: tuple = ()
    size_min: int | None = None
    size_max: int | None = None
    mtime_min: float | None = None
    mtime_max: float | None = None
    created_min: float | None = None
    created_max: float | None = None
    tags: tuple = ()
    names: tuple = ()  # (pattern, flags)
    nots: tuple = ()  # Filters
    sort: str | None = None
    limit: int | None = None

    def any(self) -> bool:
        return replace(self, limit=None) != Filters()


@dataclass(frozen=True)
class Query:
    raw: str
    text: str = ""
    filters: Filters = Filters()
    mode: str | None = None
    regex: bool = False
    flags: str = ""
    all: bool = False
    fold: bool = False
    word: bool = False
    case: bool | None = None
    diacritics: bool | None = None
    near: int | None = None
    words: tuple = ()
    phrases: tuple = ()
    without: tuple = ()
    typing: bool = True
    warnings: tuple = ()
    spans: tuple = ()  # (key, start, end)


@dataclass(frozen=True)
class Group:
    """op is leaf, and, or; a leaf has text, the others parts."""

    op: str
    text: str = ""
    parts: tuple = ()


@dataclass
class _Draft:
    now: int
    home: str
    values: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)

    def add(self, key: str, value) -> None:
        self.values[key] = (*self.values.get(key, ()), value)

    def widen(self, key: str, values) -> None:
        self.values[key] = self.values.get(key, frozenset()) | frozenset(values)

    def built(self) -> Filters:
        return Filters(**self.values)


def size_of(s: str) -> int | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgt]?b?)", s.strip().lower())
    return int(float(m[1]) * SIZE_UNITS[m[2]] + 0.5) if m else None


def age_of(s: str) -> float | None:
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*(s|min|mo|m|h|d|w|y)", s.strip().lower())
    return float(m[1]) * AGE_UNITS[m[2]] if m else None


def _ms(d: datetime) -> int:
    return int(d.timestamp() * 1000)


def when_of(s: str, now: int) -> tuple[int, float] | None:
    """[from, to) of a day, month or year, or of a word for a stretch up to now; UTC."""
    today = _ms(datetime.fromtimestamp(now / 1000, timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0))
    words = {"today": (today, float("inf")), "yesterday": (today - DAY, today), "week": (now - 7 * DAY, float("inf")), "month": (now - 30 * DAY, float("inf")), "year": (now - 365 * DAY, float("inf"))}
    if s.lower() in words:
        return words[s.lower()]
    at = lambda *x: datetime(*x, tzinfo=timezone.utc)
    try:
        if re.fullmatch(r"\d{4}", s):
            return _ms(at(int(s), 1, 1)), _ms(at(int(s) + 1, 1, 1))
        if re.fullmatch(r"\d{4}-\d{2}", s):
            y, m = map(int, s.split("-"))
            return _ms(at(y, m, 1)), _ms(at(y + m // 12, m % 12 + 1, 1))
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
            d = at(*map(int, s.split("-")))
            return _ms(d), _ms(d + timedelta(days=1))
    except ValueError:
        return None
    return None


def glob_pattern(glob: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def tokens(s: str):
    """(text, start, end, quoted): words, "phrases" and filters with a quoted value."""
    for m in re.finditer(rf'(-?(?:{"|".join(KEYS)}):)"([^"]*)"?|"([^"]*)"?|\S+', s, re.I):
        text = m[1] + m[2] if m[1] is not None else m[3] if m[3] is not None else m[0]
        yield text, m.start(), m.end(), m[3] is not None


def _operator(value: str) -> tuple[str, str]:
    m = re.match(r"(>=|<=|>|<|=)?(.+)$", value, re.S)
    return m[1] or "", m[2]


def _time(d: _Draft, key: str, value: str, column: str) -> bool:
    op, v = _operator(value)
    op = {"after": ">", "since": ">", "before": "<"}.get(key, op)
    age = age_of(v)
    if age is not None:  # an age looks back: below it is newer; after: and before: name the moment instead
        older = op in (">", ">=") if key not in ("after", "since", "before") else key == "before"
        d.values[f"{column}_{'max' if older else 'min'}"] = d.now - age
        return True
    span = when_of(v, d.now)
    if span is None:
        return False
    start, end = span
    if op in (">", ">="):
        d.values[f"{column}_min"] = start
    elif op == "<":
        d.values[f"{column}_max"] = start
    else:
        if op != "<=":
            d.values[f"{column}_min"] = start
        if end != float("inf"):
            d.values[f"{column}_max"] = end
    return True


def _size(d: _Draft, value: str) -> bool:
    if m := re.match(r"(.+?)\.\.(.+)$", value):
        lo, hi = size_of(m[1]), size_of(m[2])
        if lo is None or hi is None:
            return False
        d.values.update(size_min=lo, size_max=hi)
        return True
    op, v = _operator(value)
    n = size_of(v)
    if n is None:
        return False
    if op in ("<", "<="):
        d.values["size_max"] = n
    elif op == "=":
        d.values.update(size_min=n * 9 // 10, size_max=-(-n * 11 // 10))
    else:
        d.values["size_min"] = n
    return True


def _apply(d: _Draft, key: str, value: str, negated: bool) -> bool:
    """Takes a filter into the draft; False leaves its token in the text."""
    if negated and key not in ("type", "kind", "is"):
        if key in ("limit", "sort"):
            d.warnings.append(f"{key} cannot be negated")
            return True
        inner = _Draft(d.now, d.home, warnings=d.warnings)
        if not _apply(inner, key, value, False):
            return False
        d.add("nots", inner.built())
        return True
    if key == "ext":
        d.widen("exts", [re.sub(r"^\*?\.", "", e.strip()).lower() for e in value.split(",") if e.strip()])
        return True
    if key in ("type", "kind", "is"):
        kinds = []
        for v in value.lower().split(","):
            if v in KIND_ALIASES:
                kinds += KIND_ALIASES[v]
            elif key != "is":
                ext = re.sub(r"^\*?\.", "", v)
                d.warnings.append(f'unknown type "{v}"' + (f", did you mean {'-' if negated else ''}ext:{ext}?" if ext in KIND_OF_EXT else ""))
        if kinds:
            d.widen("not_kinds" if negated else "kinds", kinds)
        return bool(kinds) or key != "is"
    if key in ("in", "dir"):
        p = value if value.startswith(("/", "~")) else f"~/{value}"
        p = d.home + p[1:] if p.startswith("~") else p
        d.add("within", p.rstrip("/") or "/")
        return True
    if key == "path":
        d.add("path_has", value.lower())
        return True
    if key == "tag":
        d.add("tags", value)
        return True
    if key == "name":
        m = re.fullmatch(rf"/(.*)/([{FLAGS}]*)", value, re.S)
        source, flags = (m[1], m[2]) if m else (glob_pattern(value) if re.search(r"[?*]", value) else re.escape(value), "i")
        try:
            re.compile(source)
            d.add("names", (source, flags))
        except re.error:
            d.warnings.append(f"invalid name regex: {value}")
        return True
    if key == "sort":
        if SORTS.match(value):
            d.values["sort"] = value
        else:
            d.warnings.append("sort expects name, size, date, path, optionally prefixed with -")
        return True
    if key == "limit" and re.fullmatch(r"\d+", value) and int(value) > 0:
        d.values["limit"] = min(int(value), MOST_RESULTS)
        return True
    if key == "size" and _size(d, value):
        return True
    if key in ("mtime", "modified", "changed", "since", "after", "before") and _time(d, key, value, "mtime"):
        return True
    if key == "created" and _time(d, key, value, "created"):
        return True
    d.warnings.append(f"could not understand {key}:{value}")
    return False


def parse(raw: str, now: int, mode: str | None = None, home: str = "/home/u") -> Query:
    """One query of the language; `now` and `home` are given, never looked up."""
    out: dict = {"raw": raw}
    s = raw
    if m := re.match(r"\s*all:", s, re.I):
        out.update(all=True, mode="find")
        s = s[m.end() :]
    lead = s.lstrip()
    for prefix, (forced, regex) in MODES.items():
        if lead.lower().startswith(prefix):
            out.update(mode=forced, regex=regex)
            s = lead[len(prefix) :]
            break
    if re.match(rf"/[\s\S]*/[{FLAGS}]*(?:\s|$)", lead):
        out.update(mode="find", regex=True)
    plain = not out.get("regex") and out.get("mode") != "fuzzy" and (out.get("mode") or mode) != "semantic"
    d = _Draft(now, home)
    offset, kept, pos, spans = len(raw) - len(s), [], 0, []

    def cut(start: int, end: int) -> None:
        nonlocal pos
        kept.append(s[pos:start])
        pos = end

    for text, start, end, quoted in tokens(s):
        if quoted:
            continue
        if plain and (m := re.fullmatch(r"NEAR/(\d+)", text)):
            if int(m[1]) > MOST_NEAR:
                d.warnings.append(f"NEAR expects a word distance from 0 to {MOST_NEAR}")
            else:
                out.update(near=int(m[1]), all=True, mode="find")
            cut(start, end)
            continue
        if plain and re.search(r"[?*]", text) and "/" not in text and ":" not in text:
            d.add("names", (glob_pattern(text), "i"))
            spans.append(("name", offset + start, offset + end))
            cut(start, end)
            continue
        m = re.fullmatch(r"(-?)([a-zA-Z]+):([\s\S]*)", text)
        key = m[2].lower() if m else ""
        if key not in KEYS or not m[3]:
            continue
        negated, value = bool(m[1]), m[3]
        if key in ("case", "word", "diacritics", "fold"):
            if value.lower() in ("on", "true", "off", "false"):
                out[key] = (value.lower() in ("on", "true")) != negated
            else:
                d.warnings.append(f"{key} expects on or off")
        elif key == "near":
            if re.fullmatch(r"\d+", value) and int(value) <= MOST_NEAR:
                out.update(near=int(value), all=True)
            else:
                d.warnings.append(f"near expects a word distance from 0 to {MOST_NEAR}")
        elif _apply(d, key, value, negated):
            spans.append((f"-{key}" if negated else key, offset + start, offset + end))
        else:
            continue
        cut(start, end)
    text = "".join(kept) + s[pos:]
    text = (text if out.get("regex") else re.sub(r"\s{2,}", " ", text)).strip()
    if (m := re.fullmatch(rf"/([\s\S]+)/([{FLAGS}]*)", text)) and (not out.get("mode") or out.get("regex")):
        out.update(mode="find", regex=True, flags=m[2])
        text = m[1]
    words, phrases, without = [], [], []
    if not out.get("regex"):
        for w, _, _, quoted in tokens(text):
            if quoted:
                phrases += [w] if w.strip() else []
            elif len(w) > 1 and (w[0] == "!" or w[0] == "-" and w[1].isalnum()):
                without.append(w[1:])
            else:
                words.append(w)
    return Query(**out, text=text, filters=d.built(), words=tuple(words), phrases=tuple(phrases), without=tuple(without), typing=not re.search(r"\s$", raw), warnings=tuple(d.warnings), spans=tuple(spans))


def without_filters(raw: str, keys, now: int = 0, mode: str | None = None) -> str:
    """The query without its filters of these keys, the rest as written."""
    for key, start, end in reversed(parse(raw, now, mode).spans):
        if key in keys:
            while end < len(raw) and raw[end] == " ":
                end += 1
            while end == len(raw) and start > 0 and raw[start - 1] == " ":
                start -= 1
            raw = raw[:start] + raw[end:]
    return raw


def groups(raw: str) -> Group | None:
    """Groups in parentheses and OR between words; None for a query without any. Groups side by side must all hold."""
    if re.match(r"\s*(?:re:|regex:|/)", raw, re.I) or not re.search(r"\bOR\b|(?:^|\s)\(", raw):
        return None
    count = 0

    def split(text: str):
        """Top-level alternatives, and the spans of top-level groups."""
        ors, spans, level, quoted, begin, opened = [], [], 0, False, 0, 0
        skip = -1
        for i, c in enumerate(text):
            if i <= skip:
                continue
            if c == "\\":
                skip = i + 1
            elif c == '"':
                quoted = not quoted
            elif quoted:
                continue
            elif c == "(":
                opened = i if not level else opened
                level += 1
            elif c == ")":
                level -= 1
                if level < 0:
                    raise ValueError("unmatched query parenthesis")
                if not level:
                    spans.append((opened, i))
            elif not level and text.startswith("OR", i) and (not i or text[i - 1].isspace()) and (i + 2 == len(text) or text[i + 2].isspace()):
                ors.append(text[begin:i])
                begin, skip = i + 2, i + 1
        if level:
            raise ValueError("unmatched query parenthesis")
        return ([*ors, text[begin:]] if ors else []), spans

    def build(text: str, depth: int) -> Group:
        nonlocal count
        count += 1
        if count > MOST_NODES or depth > MOST_DEPTH:
            raise ValueError("query has too many groups")
        text = text.strip()
        ors, spans = split(text)
        if ors:
            if not all(o.strip() for o in ors):
                raise ValueError("OR needs text on both sides")
            return Group("or", parts=tuple(build(o, depth + 1) for o in ors))
        if not spans:
            return Group("leaf", text)
        parts, at = [], 0
        for a, b in spans:
            if text[at:a].strip():
                parts.append(Group("leaf", text[at:a].strip()))
            parts.append(build(text[a + 1 : b], depth + 1))
            at = b + 1
        if text[at:].strip():
            parts.append(Group("leaf", text[at:].strip()))
        return parts[0] if len(parts) == 1 else Group("and", parts=tuple(parts))

    top = build(raw, 0)
    return None if top == Group("leaf", raw) else top


def from_arguments(query: str = "", mode: str | None = None, **filters) -> str:
    """A query string from named arguments; lists are joned by commas, values with blanks quoted."""
    parts = [f"{mode}:" if mode else "", query]
    for key, value in filters.items():
        if value in (None, "", ()):
            continue
        v = ",".join(value) if isinstance(value, (list, tuple)) else str(value)
        parts.append(f'{key.rstrip("_")}:"{v}"' if re.search(r"\s", v) else f"{key.rstrip('_')}:{v}")
    return " ".join(p for p in parts if p)
