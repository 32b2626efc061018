"""Telling markup from text and converting it to clean text.

A text becomes a tree: the document, its blocks (paragraphs, code, fenced code, headings, lists, tables), in them the
constructs that look like markup or like code, and in elements and environments that are closed what these hold.
Every node has a hidden label: plain, code, html, markdown, wiki or latex. Node potentials say how well a construct
fits a label, parent-child potentials how labels follow each other down the tree; both are counted over labelled
pages. Sum-product message passing, upward and then downward, is exact on the tree and gives each node's marginals. A
kind of markup is in a text if a node's marginal for it is over one half, and constructs whose marginals say otherwise
are left as they stand when the text is converted.

The labelled pages are written by a seeded generator from a grammar of the four languages and of things that only
look like them: source code, shell lines, paths, addresses, comparisons, prices, references. Their number is the
documented bound TRAINING_PAGES; nothing is learnt from the texts themselves, so that a text's result doesn't depend
on its neighbours.

Clean text keeps headings on lines of their own, lists as "- item", tables as cells between " | ", code lines and the
TeX source of formulas; texts without markup come out unchanged.

Defined cases: null texts have no kind and stay null, empty ones stay empty; broken tags and unclosed constructs are
treated as far as they can be read; repeated ids are judged row by row; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweh.runtime import spread

LABELS = ("plain", "code", "html", "markdown", "wiki", "latex")
KINDS = LABELS[2:]
TRAINING_PAGES = 4000

# Element names of HTML, commands of LaTeX.
_TAGS = (
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript ol option p param picture pre q s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
_COMMANDS = (
    "documentclass usepackage begin end section subsection subsubsection chapter paragraph part title author date maketitle item textbf textit texttt emph underline cite citep citet ref eqref label footnote caption includegraphics "
    "frac dfrac sqrt sum prod int lim infty alpha beta gamma delta epsilon theta lambda mu pi sigma phi omega leq geq neq approx cdot times partial nabla mathbb mathbf mathrm left right quad text centering hline url href input bibliography tableofcontents newcommand"
).split()
_T, _C = "|".join(_TAGS), "|".join(_COMMANDS)

# Constructs: (feature, pattern). Earlier ones take precedence where they overlap.
_INLINE = [
    ("html.doctype", r"<!DOCTYPE\b[^<>]*>"),
    ("html.comment", r"<!--(?:[^-]|-(?!->))*+(?:-->)?"),
    ("wiki.tag", r"</?(?:ref|nowiki|gallery|noinclude|includeonly|onlyinclude|references|syntaxhighlight|math|poem|timeline|imagemap)\b[^<>\n]*/?>"),
    ("html.tag", rf"<(?:{_T})(?:\s+[a-zA-Z-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>]+))?)*\s*/?>"),
    ("html.end", rf"</(?:{_T})\s*>"),
    ("html.broken", rf"<(?:{_T})\s+[a-zA-Z-]+=\"[^\"<>\n]*(?=\n|$)|</(?:{_T})(?=\s|$)"),
    ("html.escaped", rf"&lt;/?(?:{_T})\b(?:[^&\n]|&(?!gt;|lt;))*+&gt;"),
    ("html.entity", r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"),
    ("other.address", r"<[^\s<>@]+@[^\s<>@]+>|<https?://[^\s<>]+>"),
    ("other.generic", r"\w<\s*\w+(?:\s*,\s*\w+)*\s*>"),
    ("other.tag", r"</?[A-Za-z][\w-]*\s*/?>"),
    ("latex.display", r"\$\$[^$]++\$\$|\\\[(?:[^\\]|\\[^\]\[])++\\\]|\\\((?:[^\\\n]|\\[^()\n])++\\\)"),
    ("latex.env", r"\\(?:begin|end)\{[a-zA-Z]+\*?\}"),
    ("latex.command", rf"\\(?:{_C})(?![A-Za-z])(?:\[[^\]\n]*\])?\{{"),
    ("latex.macro", r"\\[A-Za-z]{3,}\*?(?:\[[^\]\n]*\])?\{(?=[^{}\n]*\})"),
    ("latex.math", r"\$[^$\n]*(?:\\[a-zA-Z]+|[_^]\{)[^$\n]*\$"),
    ("other.path", r"\b[A-Za-z]:\\[^\s]*|\\\\[\w.$-]+\\[\w.$\\-]+"),
    ("latex.symbol", rf"\\(?:{_C})(?![A-Za-z])"),
    ("other.backslash", r"\\[A-Za-z]+"),
    ("wiki.template", r"\{\{[^{}]*\}\}"),
    ("wiki.table", r"(?m)^\{\|.*$|^\|\}\s*$"),
    ("wiki.link", r"\[\[(?!\s|-)[^\[\]\n]+\]\]"),
    ("other.test", r"\[\[\s[^\[\]\n]*\]\]"),
    ("wiki.external", r"\[https?://[^\s\]]+ [^\]\n]+\]"),
    ("wiki.bold", r"'''[^'\n](?:[^\n]*?[^'\n])?'''"),
    ("wiki.italic", r"(?<!')''[^'\n](?:[^'\n]|'(?!'))*''(?!')"),
    ("markdown.image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("markdown.link", r"\[[^\[\]\n]+\]\((?:https?://|/|#|\.|[\w-]+\.)[^)\n]*\)"),
    ("markdown.note", r"(?<!\w)\[\^[\w-]+\]:?|(?<=\w)\[\^[\w-]+\]"),
    ("markdown.bold", r"\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*|__[^\s_](?:[^_\n]*[^\s_])?__(?!\w)"),
    ("markdown.strike", r"~~[^\s~](?:[^~\n]*[^\s~])?~~"),
    ("markdown.code", r"(?<!`)`[^`\n]+`(?!`)"),
    ("markdown.emphasis", r"(?<![\w_/.])_[^\s_](?:[^_\n]*[^\s_])?_(?![\w_])"),
    ("other.star", r"(?<![\w*])\*[^\s*](?:[^*\n]*[^\s*])?\*(?![\w*])"),
]
_LINE = [
    ("markdown.heading", re.compile(r"^#{1,6} +\S")),
    ("markdown.task", re.compile(r"^\s*[-*+] \[[ xX]\] \S")),
    ("markdown.rule", re.compile(r"^\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$")),
    ("markdown.quote", re.compile(r"^> ?\S")),
    ("wiki.heading", re.compile(r"^(={1,6})\s*[^=\s](?:.*[^=\s])?\s*\1\s*$")),
    ("wiki.row", re.compile(r"^\|-|^! .*!!|^\| .*\|\|")),
    ("wiki.bullet", re.compile(r"^[*#:;]+ ?(?:\[\[|''|\{\{)")),
    ("other.dash", re.compile(r"^\s*[-+] \S")),
    ("other.bullet", re.compile(r"^\s*\* \S")),
    ("other.number", re.compile(r"^\s*\d{1,3}[.)] \S")),
]
_SETEXT = re.compile(r"^(=+|-{3,})\s*$")
_CODE = re.compile(
    r"^\s*(?:(?:async )?def \w+\(.*|class \w+.*:|return\b.*|(?:if|elif|while|for|with|switch) .*[:{]|(?:else|try|finally)\s*[:{]|except\b.*:|import \w[\w.]*(?: as \w+)?;?|from [\w.]+ import .*|(?:const|let|var) \w+ ?=.*|(?:public|private|static|export|function|func|fn) .*[({].*|"
    r"#include.*|using \w.*;|SELECT .*|\w[\w.]*(?:\[[^\]]*\])? ?[+*/-]?= ?[^=].*[\w)\]};\"']|\w[\w.]*\([^()]*\);?|\}(?!\}).*|[{}();\]]+(?<!\}\})|//.*|/\*.*|\$ \S.*|>>> .*|#!.*)\s*$"
)
_INLINE_RX = re.compile("|".join(f"(?P<f{k}>{p.replace('(?m)', '')})" for k, (_, p) in enumerate(_INLINE)), re.M | re.S | re.I)
_MAYBE = re.compile(r"[<&\\$`{}~*_\[|]|^[#>=-]|^[ \t]*\d+[.)] |''|^[;:]", re.M)
_FENCE = re.compile(r"^\s*(```+|~~~+)\s*[\w+-]*\s*$")


@dataclass
class Node:
    feature: str
    start: int
    end: int
    children: list["Node"] = field(default_factory=list)
    marginal: dict[str, float] | None = None

    @property
    def label(self) -> str:
        """The label whose marginal is over one half, plain if there is none."""
        best = max(self.marginal, key=self.marginal.get)
        return best if self.marginal[best] > 0.5 else "plain"


_VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "wbr", "param", "source", "p", "li", "td", "tr", "th", "dd", "dt", "option"}
_OPENS = re.compile(r"<([A-Za-z][\w-]*)[^>]*(?<!/)>$|\\begin\{([a-zA-Z]+\*?)\}$")
_CLOSES = re.compile(r"</([A-Za-z][\w-]*)\s*>$|\\end\{([a-zA-Z]+\*?)\}$")


def _inline(text: str, start: int, end: int) -> list[Node]:
    """Constructs of a block in order; what stands between the ends of an element or environment are its children."""
    flat = [Node(_INLINE[int(m.lastgroup[1:])][0], m.start(), m.end()) for m in _INLINE_RX.finditer(text, start, end)]
    closes: dict[int, int] = {}  # place of an opening -> place of its end
    open_: dict[str, list[int]] = {}
    for k, node in enumerate(flat):
        if node.feature not in ("html.tag", "html.end", "latex.env", "wiki.tag", "other.tag"):
            continue
        said = text[node.start : node.end]
        if (m := _CLOSES.search(said)) and open_.get(name := (m[1] or m[2]).lower()):
            closes[open_[name].pop()] = k
        elif (m := _OPENS.search(said)) and (name := (m[1] or m[2]).lower()) not in _VOID:
            open_.setdefault(name, []).append(k)
    out: list[Node] = []
    path: list[tuple[int, list[Node]]] = [(len(flat), out)]  # (place of the end, children)
    for k, node in enumerate(flat):
        while k > path[-1][0]:
            path.pop()
        path[-1][1].append(node)
        if k in closes and closes[k] <= path[-1][0]:  # ends that cross each other nest nothing
            path.append((closes[k], node.children))
    return out


def descendants(node: Node):
    """All nodes below this one, parents first."""
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        yield c
        todo.extend(reversed(c.children))


def parse(text: str) -> Node:
    """The tree of a text; blocks without a construct are left out."""
    root = Node("document", 0, len(text))
    lines = []
    at = 0
    for part in re.split("([\n\f])", text):
        if part not in "\n\f" or not part:
            lines.append((at, at + len(part)))
        at += len(part)
    k = 0
    while k < len(lines):
        s, e = lines[k]
        line = text[s:e]
        if not line.strip():
            k += 1
            continue
        if _FENCE.match(line):
            j = k + 1
            while j < len(lines) and not _FENCE.match(text[lines[j][0] : lines[j][1]]):
                j += 1
            stop = lines[min(j, len(lines) - 1)][1]
            root.children.append(Node("block.fence" if j < len(lines) else "block.paragraph", s, stop, [Node("markdown.fence" if j < len(lines) else "other.fence", s, stop)]))
            k = j + 1 if j < len(lines) else k + 1
            continue
        j = k
        while j < len(lines) and text[lines[j][0] : lines[j][1]].strip() and not (j > k and _FENCE.match(text[lines[j][0] : lines[j][1]])):
            j += 1
        _paragraph(text, lines[k:j], root)
        k = j
    return root


def _paragraph(text: str, lines: list[tuple[int, int]], root: Node) -> None:
    shown = [text[s:e] for s, e in lines]
    code = [bool(_CODE.match(x)) for x in shown]
    hashes = [bool(re.match(r"^\s*#+ ", x)) for x in shown]
    if any(code) or sum(hashes) > 1:
        code = [c or h for c, h in zip(code, hashes)]
    k = 0
    while k < len(lines):
        j = k
        while j < len(lines) and code[j] == code[k]:
            j += 1
        s, e = lines[k][0], lines[j - 1][1]
        block = Node("block.code" if code[k] else "block.paragraph", s, e, _inline(text, s, e))
        for x in range(k, j):
            for f, rx in _LINE:
                if rx.match(shown[x]):
                    block.children.append(Node(f, *lines[x]))
                    break
        if not code[k]:
            for x in range(k + 1, j):
                if (m := _SETEXT.match(shown[x])) and shown[x - 1].strip() and len(shown[x - 1]) < 120 and abs(len(m[1]) - len(shown[x - 1].strip())) <= max(2, len(shown[x - 1]) // 2) and x - 1 == k and "|" not in shown[x - 1]:
                    block.children.append(Node("markdown.setext", lines[x - 1][0], lines[x][1]))
        if block.children:
            root.children.append(block)
        elif code[k]:
            root.children.append(block)
        k = j


# --- the model ---


def _training(pages: int, seed: int = 11):
    """(text, kinds) of labelled pages."""
    rng = random.Random(seed)
    syllables = ["ra", "lo", "ti", "men", "sor", "vel", "ka", "du", "pin", "or", "eth", "bru", "ño", "gé", "wö", "ли", "ка", "про", "то"]
    w = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    said = lambda n=8: " ".join(w() for _ in range(rng.randint(2, n)))
    prose = lambda: " ".join((said(12).capitalize() + rng.choice(".!?.") for _ in range(rng.randint(1, 4))))
    v = lambda: rng.choice(["x", "row", "total_sum", "item_count", "buf", "self.rows", "n"])
    code_line = lambda: rng.choice([f"def {v().replace('.', '_')}({v().replace('.', '_')}, k=3):", f"    return {v()} == {v()}", f"    {v()} = {v()}[2] * 4", f"    if {v()} < 3 and {v()} > 4:", f'    {v()}.append("{w()}")', f"# {said(5)}", f"for (int i = 0; i < {v()}; i++) {{", "}", f"x = a ** b", f"    {v()} = '''{w()}'''", f"const m = new Map<string, {w()}>();", f"print(f\"{{{{{w()}}}}}\")", f"re.match(r'\\d+\\s*', {v()})", f"std::vector<{w()}> v = {{}};", f"    y = `{w()}`;"])
    html = [
        lambda: f"<!DOCTYPE html>\n<html><head><title>{said()}</title></head>\n<body>\n<h1>{said()}</h1>\n<p class=\"a\">{prose()}</p>\n<ul><li>{said()}</li><li>{said()}</li></ul>\n</body></html>",
        lambda: f"{prose()}<br>{prose()} <b>{said()}</b> <a href=\"https://{w()}.example/\">{said()}</a>", lambda: f"<table border=1><tr><td>{said()}</td><td>3</td></tr></table>",
        lambda: f"{w()}&nbsp;{prose()} {said()} &amp; {said()}&#8217;s &copy;", lambda: f"&lt;p&gt;{prose()}&lt;/p&gt;", lambda: f"{prose()}</span> {prose()}", lambda: f"{prose()}<!-- {said()} -->", lambda: f"{prose()} &mdash; {said()} &eacute;",
        lambda: f"<div>{prose()}</div>\n<p>{prose()}", lambda: f"{prose()} <img src=\"{w()}.png\" alt=\"{said()}\"> <i>{said()}</i>", lambda: f"<h2>{said()}</h2>{prose()}<br/>\n{prose()}",
    ]
    markdown = [
        lambda: f"{'#' * rng.randint(1, 4)} {said()}\n\n{prose()}", lambda: f"{(t := said())}\n{'=' * len(t)}\n\n{prose()}", lambda: f"{(t := said())}\n{'-' * max(3, len(t))}\n\n1. {said()}\n2. {said()}\n\n> {prose()}",
        lambda: f"```{rng.choice(['python', 'sh', ''])}\n{code_line()}\n{code_line()}\n```", lambda: f"{prose()} **{said()}** and `{w()}`. See [{said()}](https://{w()}.example/{w()}).", lambda: f"| {w()} | {w()} |\n|---|:---:|\n| {said()} | 3 |\n| {said()} | 4 |",
        lambda: f"~~{said()}~~ and _{w()}_ text[^1]\n\n[^1]: {said()}", lambda: f"* [ ] {said()}\n* [x] {said()}", lambda: f"- **{said()}**\n- **{said()}**", lambda: f"> {prose()}\n> {prose()}", lambda: f"![{said()}](img/{w()}.png)\n\n## {said()}",
    ]
    wiki = [
        lambda: f"{'=' * (n := rng.randint(2, 4))} {said()} {'=' * n}\n'''{said()}''' {prose()}\n* [[{said()}|{w()}]]\n* [[{said()}]]", lambda: f"{{{{Infobox {w()}\n| name = {said()}\n| size = 3\n}}}}\n{prose()}", lambda: f"{prose()} [[{w().capitalize()}]] {said()}. [https://{w()}.example/{w()} {said()}]",
        lambda: f"{{| class=\"wikitable\"\n! {said()} !! {said()}\n|-\n| 1 || 2\n|}}", lambda: f"=={said()}==\n{prose()}<ref>{said()}</ref>\n\n{{{{cite|{w()}}}}}", lambda: f"{prose()} ''{w()}'' {said()}", lambda: f"[[Category:{w()}]]\n# [[{w()}]]\n; {w()} : [[{said()}]]",
        lambda: f"{prose()} <syntaxhighlight lang=\"py\">\n{code_line()}\n</syntaxhighlight>", lambda: f"{prose()} <math>x_2</math> {said()} <nowiki>{w()}</nowiki>", lambda: f"#REDIRECT [[{w().capitalize()}]]",
    ]
    latex = [
        lambda: f"\\documentclass{{article}}\n\\begin{{document}}\n\\section{{{said()}}}\n{prose()}\n\\begin{{itemize}}\n\\item {said()}\n\\end{{itemize}}\n\\end{{document}}", lambda: f"{prose()} \\textbf{{{w()}}} {said()} where $\\alpha_{{2}} \\leq \\frac{{b_8}}{{4}}$.~\\cite{{{w()}}}",
        lambda: f"\\begin{{equation}}\nE_9 = c_4 \\cdot t^{{2}}\n\\end{{equation}}\n{prose()}", lambda: f"{prose()}\n\\[ \\sum_{{i=1}}^{{6}} b_7 = \\sqrt{{39}} \\]", lambda: f"{prose()}\n\n$$\\int_0^{{4}} c_4\\,dx$$", lambda: f"{prose()} \\emph{{{said()}}} (see \\ref{{{w()}}})", lambda: f"{prose()} $x^{{2}}_{{i}}$ {said()}",
        lambda: f"{prose()} \\{rng.choice(['my', 'the', 'new'])}{rng.choice(['vec', 'set', 'term'])}{{{w()}}} {said()}", lambda: f"{said()} \\operatorname{{{w()}}} {prose()}", lambda: f"\\begin{{abstract}}\n{prose()} \\emph{{{w()}}} \\dots\n\\end{{abstract}}",
    ]
    near = [
        lambda: "\n".join(code_line() for _ in range(rng.randint(3, 12))), lambda: f"$ {w()} --{w()} > {w()}.log\n$ cat {w()} | grep -v '{w()}'", lambda: f"Use list<{w()}> in the header, not map<int, {w()}>.", lambda: f"Mail {w()} <{w()}@{w()}.example> or visit https://{w()}.example/a_b_c",
        lambda: f"if [[ -f {w()}.txt ]]; then x == y", lambda: f"{prose()} C:\\{w()}\\{w()}\\old_{w()}.doc to D:\\ {said()}", lambda: f"It costs $ 20 to $ 54 a {w()}, see #144. {prose()}", lambda: f"Refs [3] and [7] (see p. 85); 2^5 rows {{draft}}. {prose()}", lambda: f"Total = 4 * 51 * queue_{w()}_count",
        lambda: f"If the {w()} < 81 and the {w()} > 72, call {w()}. R&D and {w()} & {w()}.", lambda: f"{w().capitalize()} & {w().capitalize()} wrote '{said()}' *\n\n{prose()}", lambda: f"- {said()}\n- {said()}\n\n{prose()}", lambda: f"1. {said()}\n2. {said()}\n\n{prose()}", lambda: f"{w()},{w()},{w()}\n1,2,3\n,{w()},4",
        lambda: f"{w()} | {w()} | {w()}\n{prose()}", lambda: f"• {said()}\n• {w()}\n\n{prose()}", lambda: f"---\n{prose()}", lambda: f"* {said()}\n{prose()}", lambda: f"<{w()}> {prose()} <{w()}>", lambda: f"re.compile(r'\\p{{Lu}}\\x{{41}}')", lambda: f"path = '\\{w()}\\{w()}.txt'",
    ]
    for k in range(pages):
        parts, kinds = [prose()], set()
        r = rng.random()
        if r < 0.55:
            name = rng.choice(KINDS)
            pool = {"html": html, "markdown": markdown, "wiki": wiki, "latex": latex}
            parts += [rng.choice(pool[name])() for _ in range(rng.randint(1, 3))]
            kinds = {name}
            if rng.random() < 0.15:
                other = rng.choice(KINDS)
                parts.append(rng.choice(pool[other])())
                kinds.add(other)
        if r > 0.4:
            parts += [rng.choice(near)() for _ in range(rng.randint(1, 2))]
        if r > 0.9:
            parts = parts[1:]
        rng.shuffle(parts)
        yield "\n\n".join(parts), kinds


class Model:
    """Potentials counted over labelled pages."""

    def __init__(self, pages: int = TRAINING_PAGES):
        n = {f: 1.0 for f in LABELS}
        node: dict[str, dict[str, float]] = {}
        edge = {a: {b: 0.5 for b in LABELS} for a in LABELS}
        for text, kinds in _training(pages):
            tree = parse(text)
            code_only = bool(tree.children) and all(b.feature == "block.code" for b in tree.children)
            top = min(kinds, key=LABELS.index) if kinds else "code" if code_only else "plain"
            self._add(node, n, "document", top)
            for b in tree.children:
                marks = [c.feature.split(".")[0] for c in descendants(b) if c.feature.split(".")[0] in kinds]
                own = "code" if b.feature == "block.code" else max(set(marks), key=marks.count) if marks else "plain"
                self._add(node, n, b.feature, own)
                edge[top][own] += 1
                todo = [(own, c) for c in b.children]
                while todo:
                    above, c = todo.pop()
                    kind = c.feature.split(".")[0]
                    label = kind if kind in kinds and own != "code" else self._other(c.feature, own, kinds)
                    self._add(node, n, c.feature, label)
                    edge[above][label] += 1
                    todo += [(label, x) for x in c.children]
        total = sum(n.values())
        # P(feature | label), up to a factor that is common to all labels
        self.node = {f: [(by.get(x, 0.0) + 0.05) / n[x] * total for x in LABELS] for f, by in node.items()}
        self.edge = [[edge[a][b] / sum(edge[a].values()) for b in LABELS] for a in LABELS]
        self.top = [n[x] / total for x in LABELS]
        self.up = {f: self._message(p) for f, p in self.node.items()}
        self.flat = [1.0] * len(LABELS)

    @staticmethod
    def _other(feature: str, own: str, kinds: set) -> str:
        if own == "code":
            return "code"
        if feature in ("other.dash", "other.bullet", "other.number") and "markdown" in kinds:
            return "markdown"
        return "plain"

    @staticmethod
    def _add(node, n, feature, label):
        by = node.setdefault(feature, {})
        by[label] = by.get(label, 0.0) + 1
        n[label] += 1

    def _message(self, potential: list[float]) -> list[float]:
        return [sum(e * p for e, p in zip(row, potential)) for row in self.edge]

    def run(self, tree: Node) -> Node:
        """Sum-product: sets the marginals of all nodes."""
        def norm(p):
            s = sum(p) or 1.0
            return [x / s for x in p]

        def product(p, q):
            return norm([a * b for a, b in zip(p, q)])

        def less(p, m):
            return norm([a / max(b, 1e-12) for a, b in zip(p, m)])

        def down(p):
            return [sum(p[a] * self.edge[a][b] for a in range(len(LABELS))) for b in range(len(LABELS))]

        nodes = [tree, *descendants(tree)]  # parents stand before their children
        local, up = {}, {}  # what a node has from itself and from below; what it tells its parent
        for c in reversed(nodes):
            own = self.node.get(c.feature, self.flat)
            if c is tree:
                own = [a * b for a, b in zip(self.top, own)]
            if not c.children:
                local[id(c)], up[id(c)] = own, self.up.get(c.feature, self.flat)
                continue
            for x in c.children:
                own = product(own, up[id(x)])
            local[id(c)], up[id(c)] = own, self._message(own)
        full = {id(tree): norm(local[id(tree)])}
        for c in nodes:
            p = full[id(c)]
            c.marginal = dict(zip(LABELS, p))
            for x in c.children:
                full[id(x)] = product(down(less(p, up[id(x)])), local[id(x)])
        return tree


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


_WEAK = {"other.dash", "other.bullet", "other.number"}


def read(text: str, fitted: Model | None = None) -> tuple[Node | None, set[str]]:
    """(tree with marginals, kinds of markup); None where nothing looks like markup."""
    if not text or not _MAYBE.search(text):
        return None, set()
    tree = parse(text)
    if not tree.children:
        return None, set()
    (fitted or model()).run(tree)
    kinds = {c.label for b in tree.children for c in descendants(b) if c.feature not in _WEAK and c.label in KINDS}
    return tree, kinds


# --- conversion ---

_HEAD = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCK = {"p", "div", "section", "article", "table", "ul", "ol", "blockquote", "pre", "header", "footer", "details", "summary", "figure", "form", "body", "html", "dl", "dd", "dt", "hr", "main", "aside", "nav"} | _HEAD


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.cells = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript", "svg"):
            self.skip += 1
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "tr":
            self.out.append("\n")
            self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript", "svg"):
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCK or tag == "title":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def _from_html(text: str) -> str:
    if re.search(r"&lt;/?\w", text):
        text = html_lib.unescape(text)
    keep = []  # what isn't an element of HTML stays as it is
    text = re.sub(rf"<(?!/?(?:{_T})\b|!--|!DOCTYPE)", lambda m: keep.append(m[0]) or "\ue000", text, flags=re.I)
    text = re.sub(r"&(?!#?\w{2,32};)", "\ue001", text)
    p = _Text()
    p.feed(text)
    p.close()
    return "".join(p.out).replace("\ue000", "<").replace("\ue001", "&").replace("\u00a0", " ")


def _from_markdown(text: str) -> str:
    text = re.sub(r"(?m)^[ \t]*(?:```+|~~~+)[^\n`]*\n?", "", text)
    text = re.sub(r"(?m)^#{1,6} +(.*?)[ \t]*#*$", r"\1", text)
    text = re.sub(r"(?m)^(\S.*)\n(?:=+|-{3,})[ \t]*$", r"\1", text)
    text = re.sub(r"(?m)^\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", "", text)
    text = re.sub(r"(?m)^\|(.*)\|[ \t]*$", lambda m: " | ".join(c.strip() for c in m[1].split("|")), text)
    text = re.sub(r"(?m)^([ \t]*)[-*+] (?:\[[ xX]\] )?", r"\1- ", text)
    text = re.sub(r"(?m)^> ?", "", text)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\([^)\n]*\)", r"\1", text)
    text = re.sub(r"\[\^[\w-]+\]:?[ \t]?", "", text)
    text = re.sub(r"(\*\*|__|~~)(?=\S)([^\n]*?\S)\1", r"\2", text)
    text = re.sub(r"(?<![\w_/.])_(?=\S)([^_\n]*\S)_(?!\w)", r"\1", text)
    return re.sub(r"(?<!`)`([^`\n]+)`(?!`)", r"\1", text)


def _template(inner: str) -> str:
    """What a template shows: an infobox its values by name, a citation or a navigation bar nothing, others their last value."""
    name, _, rest = inner.partition("|")
    if re.match(r"\s*(?:cite|navbox|stub|reflist|citation)", name, re.I):
        return ""
    values = [x.strip() for x in rest.split("|")]
    if re.match(r"\s*(?:info)?box", name, re.I):
        return "\n" + "\n".join(re.sub(r"^\s*([^=\n]+?)\s*=\s*", r"\1: ", x) for x in values if x)
    return values[-1] if rest else name.strip()


def _nested(text: str, opening: str, closing: str, close) -> str:
    """Replaces what stands between openings and closings, inner ones first, by close(opening, inner); ends without a partner stay."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    for part in re.split(f"({opening}|{closing})", text):
        if re.fullmatch(opening, part):
            stack.append((part, []))
        elif re.fullmatch(closing, part) and len(stack) > 1:
            said, inner = stack.pop()
            stack[-1][1].append(close(said, "".join(inner)))
        else:
            stack[-1][1].append(part)
    return "".join(said + "".join(parts) for said, parts in stack)


def _from_wiki(text: str) -> str:
    text = re.sub(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", "", text, flags=re.S)
    text = re.sub(r"</?(?:nowiki|noinclude|includeonly|onlyinclude|syntaxhighlight|math|poem|gallery|references|timeline|imagemap)\b[^<>\n]*>\n?", "", text)
    text = _nested(text, r"\{\{", r"\}\}", lambda _, inner: _template(inner))
    text = re.sub(r"(?m)^(={1,6})\s*(.*?)\s*\1\s*$", r"\2", text)
    text = re.sub(r"(?m)^(?:\{\|.*|\|\}|\|-.*)\n?", "", text)
    text = re.sub(r"(?m)^[!|] ?(.*(?:!!|\|\|).*)$", lambda m: " | ".join(c.strip() for c in re.split(r"!!|\|\|", m[1])), text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+ ([^\]\n]+)\]", r"\1", text)
    text = re.sub(r"'{2,5}(?=\S)([^\n]*?\S)'{2,5}", r"\1", text)
    return re.sub(r"(?m)^(?!#REDIRECT\b)[*#]+ ?", "- ", text)


_SHOWN = re.compile(r"\\(?:(?:sub)*section|chapter|paragraph|part|title|author|date|textbf|textit|texttt|emph|underline|footnote|caption|text)\*?\{")


def _from_latex(text: str) -> str:
    text = re.sub(r"\\(?:documentclass|usepackage|bibliography|label|maketitle|tableofcontents|centering|input)\b(?:\[[^\]\n]*\])?(?:\{[^{}]*\})?\n?", "", text)
    text = re.sub(r"[ \t]*\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?\n?", "", text)
    text = re.sub(r"\$\$((?:[^$]|\n)+?)\$\$|\\\[((?:.|\n)+?)\\\]|\\\((.+?)\\\)", lambda m: (m[1] or m[2] or m[3]).strip(), text)
    text = re.sub(r"\$([^$\n]*(?:\\[a-zA-Z]+|[_^]\{)[^$\n]*)\$", r"\1", text)
    text = re.sub(r"~?\\(?:cite[pt]?|ref|eqref)\{[^{}]*\}", "", text)
    text = re.sub(r"(?m)^[ \t]*\\item\s*", "- ", text)
    text = _nested(text, r"\\[A-Za-z]+\*?\{|\{", r"\}", lambda said, inner: inner if _SHOWN.fullmatch(said) else f"{said}{inner}}}")
    return re.sub(r"(?<=[\w.,:;)\]}])~(?=[\w\\({$])", " ", text)  # ties; other tildes are paths and addresses


def clean(text: str, fitted: Model | None = None) -> str:
    """Clean text; the same text where no markup is found."""
    tree, kinds = read(text, fitted)
    if not kinds:
        return text
    held: list[str] = []
    pieces, at = [], 0

    def hold(start: int, end: int, said: str) -> None:
        nonlocal at
        if start < at:
            return
        held.append(said)
        pieces.extend((text[at:start], f"\ue002{len(held) - 1}\ue003"))
        at = end

    for b in tree.children:
        fence = b.feature == "block.fence" and "markdown" in kinds
        own = text[b.start : b.end]
        if fence:  # code keeps its lines
            hold(b.start, b.end, re.sub(r"(?m)^\s*(?:```+|~~~+)[^\n]*\n?", "", own).rstrip("\n"))
        elif b.feature == "block.code" and b.marginal["code"] > 0.5:
            hold(b.start, b.end, own)
        else:  # and so does what looks like markup and isn't
            for c in sorted(descendants(b), key=lambda c: (c.start, -c.end)):
                if c.label not in KINDS and c.feature not in _WEAK and not c.feature.startswith(("markdown.heading", "markdown.quote", "markdown.setext", "other.dash", "other.bullet", "other.number")):
                    hold(c.start, c.end, text[c.start : c.end])
    out = "".join(pieces) + text[at:]
    if "latex" in kinds:
        out = _from_latex(out)
    if "wiki" in kinds:
        out = _from_wiki(out)
    if "markdown" in kinds:
        out = _from_markdown(out)
    if "html" in kinds:
        out = _from_html(out)
    out = re.sub(r"[ \t]+(?=\n)", "", out)
    out = re.sub(r"\n{3,}", "\n\n", out).strip("\n")
    return re.sub("\ue002(\\d+)\ue003", lambda m: held[int(m[1])], out)


def _each(frames, id_col: str, column: str, emit, columns):
    for pdf in frames:
        out = []
        for i, text in zip(pdf[id_col], pdf[column]):
            out.extend(emit(i, text))
        yield pd.DataFrame(out, columns=columns)


def kinds(texts: DataFrame, id_col: str = "id", column: str = "data") -> DataFrame:
    """(text_id, markup): a row for each kind of markup of each text."""
    kind = texts.schema[id_col].dataType.simpleString()
    src = spread(texts.select(id_col, column).filter(F.col(column).isNotNull()))
    fitted = model()  # fitted once, here; workers get its tables
    return src.mapInPandas(lambda f: _each(f, id_col, column, lambda i, t: [(i, k) for k in read(t, fitted)[1]], ["text_id", "markup"]), f"text_id {kind}, markup string").distinct()


def cleaned(texts: DataFrame, id_col: str = "id", column: str = "data") -> DataFrame:
    """(text_id, text, changed)."""
    kind = texts.schema[id_col].dataType.simpleString()

    fitted = model()

    def emit(i, text):
        new = clean(text, fitted) if text else text
        yield i, new, new != text

    return spread(texts.select(id_col, column)).mapInPandas(lambda f: _each(f, id_col, column, emit, ["text_id", "text", "changed"]), f"text_id {kind}, text string, changed boolean")
