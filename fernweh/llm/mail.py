"""Reducing mails to the text their sender newly wrote.

A recursive layout grammar reads the decoded lines of a part:

    mail       := (quote | forward | signature | disclaimer | authored)*
    quote      := intro? marked-line+            marked lines, less one mark each, are a mail again
    forward    := divider? header-line header-line+ mail
    signature  := (closing name? | delimiter) line*  | device-note
    disclaimer := rule? disclaimer-paragraph

and gives a tree of nodes over line numbers; only `authored` nodes are serialised.

Defined cases: a null body or empty body has no lines; a missing or null content type is text/plain, a missing
charset utf-8; undecodable bytes become U+FFFD, an unknown charset is read as latin-1 and an unknown transfer
encoding as none; repeated parts are treated alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import quopri
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweh.runtime import spread

_MARK = re.compile(r"^\s{0,3}(?:[A-Z]{1,3}>|>(?!=)|\|(?!\|))[ ]?")
# How mail programs say that somebody wrote; words and pronouns that stand round it.
_WROTE = r"(?:wrote|writes|schrieb|a écrit|écrit|écrivait|escribió|ha scritto|scrisse|escreveu|schreef|pisze|napisał|napisała|skrev|kirjoitti|написал|написала|пишет|napsal|napsala|yazdı)"
_SELF = re.compile(rf"\b(?:I|[Ww]e|[Ii]ch|[Ww]ir|[Jj]e|j|[Nn]ous|[Yy]o|[Nn]osotros|[Ee]u|[Nn]ós|[Ii]o|[Nn]oi|[Ii]k|[Ww]ij|[Jj]a|[Jj]ag|[Yy]ou|[Ww]ho)['’\s]+(?:[^\W\d_]+\s+)?{_WROTE}\b")
# After the verb only names, dates, times, addresses and the small words between them may stand.
_TAIL = r"(?:\s*(?:[(\[]?\d[\d./:,-]*[)\],.]*|\(?[A-ZÀ-ÞА-Я][\w.'’-]*\)?,?|<[^<>]*>|(?:am|um|on|at|le|à|el|las|il|alle|em|às|op|om|dnia|o|den|kl|de|a|von|van|di|du|da|в)\b\.?,?|[ap]m\b,?|[,–-]))*\s*:$"
_BEGINS = re.compile(r"^(?:On|Am|Le|El|Il|Em|Op|W dniu|Dnia|Den|Dne|Quoting|Zitat von)\s\S")
_INTRO_START = re.compile(rf"{_BEGINS.pattern}|^\*\s.+<[^<>\s]+@|^\S.{{0,80}}\b{_WROTE}\b|^\S.{{0,60}}<[^<>\s]+@[^<>\s]+>")
_INTRO = re.compile(rf"\b{_WROTE}\b{_TAIL}|^(?:Quoting|Zitat von)\s.+:$|^\*\s.+<[^<>\s]+@.+>\s*\[[^\]]*\]\s*:$|^\S.+<[^<>\s]+@[^<>\s]+>\s*:$")
_DATE = r"(?:\d{1,4}[./-]\s?\d{1,2}[./-]\s?\d{2,4}|\b\d{1,2}\.? (?:de )?[^\W\d_]{3,}\.?,? (?:de )?(?:19|20)\d\d|[^\W\d_]{3,}\.? \d{1,2},? (?:19|20)\d\d)"
_DATED = re.compile(_DATE)
_ANY_INTRO = re.compile(rf"^[^.!?]*{_DATE}[^!?]*[^\W\d_].*:$")  # in any language, but only right before marked lines

_DIVIDER = re.compile(r"^(?:-{2,}\s*[^\W\d_][^-]{3,60}-{2,}|Begin forwarded message:|Anfang der weitergeleiteten (?:Nachricht|E-Mail):|Début du message (?:transféré|réexpédié)\s?:|Inicio del mensaje reenviado:|_{20,})\s*$")
_HEADER = re.compile(r"^\s*\*?(From|Von|De|Da|Sent|Gesendet|Envoyé|Enviado|Date|Datum|Fecha|To|An|À|A|Para|Cc|Kopie|Subject|Betreff|Objet|Asunto|Reply-To)\s?:\*?(?:\s|$)")
_SENDERS = {"From", "Von", "De", "Da"}
_DELIMITER = re.compile(r"^(?:-- ?|__|—|–)$")
# Closing formulas.
_CLOSING = re.compile(
    r"^(?:(?:many )?thanks(?: again| in advance| a lot| so much)?|thank you(?: very much| so much)?|all the best|all best|best(?: wishes)?|(?:(?:kind|best|warm|kindest|warmest) )?regards|cheers|take care|warmly|love|yours|(?:yours )?(?:very )?(?:sincerely|faithfully|truly|respectfully|cordially)(?: yours)?|"
    r"(?:mit )?(?:beste[nr]?|viele[nr]?|liebe[nr]?|schöne[nr]?|herzliche[nr]?|freundliche[nr]?|sonnige[nr]?) gr(?:üße[n]?|uß)|gruß|lg|mfg|hochachtungsvoll|"
    r"(?:bien )?cordialement|bien à (?:vous|toi)|amicalement|(?:sincères |meilleures |mes )?salutations(?: distinguées)?|"
    r"(?:un|reciba un) (?:cordial )?saludo|saludos(?: cordiales)?|atentamente|cordialmente|un abrazo|atenciosamente|abraços|cumprimentos|"
    r"cordiali saluti|distinti saluti|saluti|un saluto|a presto|met (?:vriendelijke|hartelijke) groet(?:en)?|(?:vriendelijke |hartelijke )?groet(?:en|jes)?|hoogachtend|"
    r"z poważaniem|pozdrawiam|pozdrowienia|med vänlig(?:a)? hälsning(?:ar)?|vänliga hälsningar|mvh|hälsningar|med venlig hilsen|(?:med )?vennlig hilsen|hilsen|ystävällisin terveisin|terveisin|"
    r"с уважением|с наилучшими пожеланиями|всего доброго|s pozdravem|saygılarımla)\s*[,.!]?$",
    re.I,
)
_NAME = re.compile(r"^(?:[^\W\d_a-zß-ÿ][\w'’.-]*,?\s?){1,5}(?:\([^()]*\))?$")
_CONTACT = re.compile(r"@|https?:|www\.|\+?\d[\d ()/.-]{5,}|\b(?:tel|phone|fax|mobil|mobile|cell|email|e-mail|mail|web)\b\.?:?|^\S+\.\w{2,}$|\|", re.I)
_DEVICE = re.compile(r"^(?:Sent (?:from|via) my\b|Sent from (?:Mail|Outlook|Yahoo)\b|Get Outlook for\b|Envoyé (?:depuis|de) mon\b|Enviado (?:desde mi|do meu)\b|(?:Von meinem|Gesendet von mein\w*)\b.*$|Inviato dal mio\b)", re.I)
_RULE = re.compile(r"^(?:[_=*~#-]{8,}|(?:[-_=*] ){3,}[-_=*]?)\s*$")
_NOTICE = re.compile(r"^(?:\W*)(?:confidentiality (?:notice|note)|disclaimer|legal (?:notice|disclaimer)|haftungsausschluss|vertraulichkeitshinweis|avis de confidentialité|aviso (?:legal|de confidencialidad))\b\s*(?:[:–—-]|$)", re.I)
_LEGALESE = re.compile(
    r"in this transmission belongs to|attachments? (?:are|is) confidential|may be legally privileged|(?:meant|intended) (?:solely|only) for|not the intended recipient|received it in error|liability for viruses|"
    r"destroy all copies|use by others is prohibited|le détruire et de prévenir|piense en el medio|denken sie an die umwelt|rechtlich geschützt|consider the environment before|before printing this e-?mail|is registered in \S+ under number|views expressed here are those of|"
    r"message est confidentiel|contenu de ce courriel|toute diffusion est interdite|avant d.imprimer|siège à .+no \d|(?:message|communication|courriel) .{0,60}(?:appartient|destiné)|cas d.erreur, merci|courriel .{0,60}confidentiel|"
    r"recibido por error|mensaje es confidencial|comunicación pertenece a|contenido de este (?:correo|mensaje)|prohíbe su difusión|antes de imprimir|con sede en .+registro \d|"
    r"ist vertraulich|nur für den empfänger|irrtümlich erhalten|weitergabe ist untersagt|bevor sie .{0,30}drucken|\bHRB \d|inhalt dieser (?:nachricht|e-?mail)|diese (?:nachricht|e-?mail|mitteilung) (?:ist|gehört|enthält|kann|richtet)",
    re.I,
)
# Each of the sentences above holds one of these, which is quicker to see.
_STEMS = (
    "transmission", "confidential", "privileged", "solely for", "only for", "recipient", "in error", "viruses", "destroy all", "by others", "détruire", "medio", "umwelt", "rechtlich", "environment", "printing", "registered in", "views expressed",
    "confidentiel", "courriel", "diffusion", "imprimer", "siège", "message", "communication", "erreur", "por error", "confidencial", "pertenece", "contenido", "difusión", "imprimir", "con sede", "vertraulich", "empfänger", "irrtümlich", "untersagt",
    "bevor sie", "hrb", "inhalt dieser", "diese nachricht", "diese e-mail", "diese email", "diese mitteilung",
)


def legalese(text: str) -> bool:
    low = text.lower()
    for stem in _STEMS:
        if stem in low:
            return bool(_LEGALESE.search(text))
    return False


# What legal notices speak of. Three of these in one paragraph that begins with the message itself are a notice.
_TOPICS = [re.compile(x, re.I) for x in (
    r"\b(?:confidential|privileged|proprietary|vertraulich|geschützt|confidentiel|confidencial|riservat|vertrouwelijk|poufn|konfidentiell|конфиденциальн)",
    r"\b(?:addressee|intended (?:only |solely )?(?:recipient|for)|named (?:above|recipient)|solely for|empfänger|adressat|destinataire|destinatari|geadresseerde|adresat|mottagare|получател)",
    r"\b(?:unauthori[sz]ed|prohibited|forbidden|strictly|may not be|must not|disclos|dissemin|distribut|untersagt|unzulässig|interdit|prohib|proibid|viet|verboden|zabronion|förbjud|запрещ)",
    r"\b(?:in error|by mistake|irrtümlich|versehentlich|par erreur|por error|per errore|por engano|abusievelijk|omyłkowo|ошибочно)",
    r"\b(?:liabilit|responsib|virus|haftung|responsabilité|responsabilidad|responsabilità|aansprakelijk|odpowiedzialno)",
    r"\b(?:delete|destroy|notify|löschen|vernichten|supprimer|détruire|eliminar|borrar|destruir|cancellar|verwijder|usun|удал)",
    r"\b(?:files transmitted|attachments?|anhäng|pièces jointes|adjunt|allegat|bijlage|załącznik|вложени)",
)]
_ITSELF = re.compile(r"^\W*(?:the (?:contents?|information)[^.]{0,40} )?(?:this|diese|dieses|ce|cette|este|esta|questo|questa|dit|deze|ta|niniejsza|detta|данное|это)\b.{0,40}?(?:e-?mail|message|communication|transmission|nachricht|mitteilung|courriel|correo|mensaje|comunicación|messaggio|mensagem|bericht|wiadomość|meddelande|сообщение|письмо)", re.I)


def is_notice(text: str) -> bool:
    """Whether a paragraph is a legal notice."""
    return bool(_NOTICE.search(text) or legalese(text)) or bool(_ITSELF.search(text)) and sum(bool(t.search(text)) for t in _TOPICS) >= 3


def _contact(line: str) -> bool:
    """Whether a line may belong to a signature: a name, a rank, a firm, an address, a number, not a sentence."""
    x = line.strip()
    if _CONTACT.search(x) or _NAME.match(x):
        return True
    words = x.split()
    return len(words) <= 12 and not (re.search(r"[.!?:;]$", x) and len(words) > 3)


@dataclass
class Node:
    kind: str
    start: int  # line numbers from 0, end exclusive
    end: int
    children: list["Node"] = field(default_factory=list)


def _para_end(lines: list[str], i: int, most: int = 1 << 30) -> int:
    """End of the paragraph, or of its first lines."""
    end = min(len(lines), i + most)
    while i < end and lines[i].strip():
        i += 1
    return i


def _skip_blank(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i].strip():
        i += 1
    return i


class Grammar:
    """Recursive descent over the lines of one part."""

    def __init__(self, lines: list[str], base: int = 0, depth: int = 0):
        self.lines, self.base, self.depth = lines, base, depth
        self.colon = [len(lines)] * (len(lines) + 1)  # for each line the next one of its paragraph that ends in a colon, or where the paragraph ends
        for k in range(len(lines) - 1, -1, -1):
            x = lines[k].rstrip()
            self.colon[k] = k if not x or x.endswith(":") or _MARK.match(x) else self.colon[k + 1]
        self.blocks: dict[int, int] = {}  # where signatures' lines end, by line

    def mail(self) -> list[Node]:
        nodes, i, lines = [], 0, self.lines
        while i < len(lines):
            j, node = i, None
            if lines[i].strip():
                for rule in (self.forward, self.quote, self.disclaimer, self.signature):
                    if node := rule(i):
                        break
            if node:
                j = node.end - self.base
                nodes.append(node)
            else:
                j = i + 1
                if nodes and nodes[-1].kind == "authored" and nodes[-1].end == self.base + i:
                    nodes[-1].end += 1
                else:
                    nodes.append(Node("authored", self.base + i, self.base + j))
            i = j
        return nodes

    def _inner(self, start: int, end: int, strip: bool) -> list[Node]:
        if self.depth >= 40:
            return []
        part = self.lines[start:end]
        return Grammar([_MARK.sub("", x, count=1) for x in part] if strip else part, self.base + start, self.depth + 1).mail()

    def _intro(self, i: int) -> int:
        """End of the lines that introduce a quote at i, or 0: up to the next line of the paragraph that ends in a colon."""
        lines = self.lines
        if not _INTRO_START.search(lines[i]):
            if lines[i].rstrip().endswith(":") and (not i or not lines[i - 1].strip()) and _ANY_INTRO.search(lines[i].strip()):
                k = _skip_blank(lines, i + 1)
                return i + 1 if k < len(lines) and _MARK.match(lines[k]) else 0
            return 0
        j = self.colon[i]
        if j >= len(lines) or not lines[j].rstrip().endswith(":") or _MARK.match(lines[j]):
            return 0
        said = self._said(i, j + 1)
        if not _INTRO.search(said) or _SELF.search(said):
            return 0
        later = any(_BEGINS.search(lines[k]) and _DATED.search(self._said(k, j + 1)) for k in range(max(i + 1, j - 4), j + 1))
        return 0 if later else j + 1  # of two beginnings the one nearer to the end counts

    def _said(self, i: int, j: int) -> str:
        """An introduction's lines as one; of long ones the beginning and the end, which tell what it is."""
        part = self.lines[i:j] if j - i <= 8 else [self.lines[i], *self.lines[j - 4 : j]]
        return re.sub(r"\s+:$", ":", " ".join(x.strip() for x in part))

    def quote(self, i: int) -> Node | None:
        lines, start = self.lines, i
        if at := self._intro(i):
            k = _skip_blank(lines, at)
            if k < len(lines) and _MARK.match(lines[k]):
                i = k
            elif _DATED.search(self._said(start, at)):
                if at < len(lines):  # an unmarked quote runs to the end
                    return Node("quote", self.base + start, self.base + len(lines), self._inner(at, len(lines), False))
                return Node("quote", self.base + start, self.base + at)
            else:
                return None
        if not _MARK.match(lines[i]):
            return None
        j = i
        while j < len(lines) and _MARK.match(lines[j]):
            j += 1
        return Node("quote", self.base + start, self.base + j, self._inner(i, j, True))

    def forward(self, i: int) -> Node | None:
        lines, j = self.lines, i
        if _DIVIDER.match(lines[i]):
            j = _skip_blank(lines, i + 1)
        k, names = j, []
        while k < len(lines) and (m := _HEADER.match(lines[k])):
            names.append(m[1])
            k += 1
        if len(names) < 2 or names[0] not in _SENDERS:
            return None
        return Node("forward", self.base + i, self.base + len(lines), self._inner(k, len(lines), False))

    def disclaimer(self, i: int) -> Node | None:
        lines, j = self.lines, i
        if i and lines[i - 1].strip() and not (_RULE.match(lines[i]) or _NOTICE.match(lines[i]) or legalese(lines[i])):
            return None  # no notice begins here; said before anything longer than the line is read
        if i and _RULE.match(lines[i]) and _RULE.match(lines[i - 1]) and not _DELIMITER.match(lines[i - 1]):
            return None  # the first of the rules was asked already
        while j < len(lines) and _RULE.match(lines[j]) and not _DELIMITER.match(lines[j]):
            j += 1
        if j >= len(lines):
            return None
        k = j
        while k < len(lines) and lines[k].strip() and not _MARK.match(lines[k]):
            k += 1
        text = " ".join(x.strip() for x in lines[j:k])
        if not is_notice(text):
            return None
        while k < len(lines) and _RULE.match(lines[k]):
            k += 1
        return Node("disclaimer", self.base + i, self.base + k)

    def _block(self, j: int, every: bool) -> int:
        """End of the signature's lines from j on: up to a blank line, and beyond it while paragraphs hold addresses or numbers and no sentence. `every` takes the lines of the first paragraph as they are."""
        lines, start = self.lines, j
        if not every and j in self.blocks:
            return self.blocks[j]
        j = self._lines(j, every)
        if not every:
            end = self._beyond(j)
            self.blocks.update(dict.fromkeys(range(start, j + 1), end))
            return end
        return self._beyond(j)

    def _lines(self, j: int, every: bool) -> int:
        lines = self.lines
        while j < len(lines) and lines[j].strip() and not self._other(j) and (every or _contact(lines[j])):
            j += 1
        return j

    def _beyond(self, j: int) -> int:
        lines = self.lines
        if j < len(lines) and lines[j].strip():
            return j
        while (k := _skip_blank(lines, j)) < len(lines) and not self._other(k):
            end = k
            while end < len(lines) and lines[end].strip() and _contact(lines[end]):
                end += 1
            if end < len(lines) and lines[end].strip() or not any(_CONTACT.search(x) for x in lines[k:end]) or any(self._other(x) for x in range(k, end)):
                break
            j = end
        return j

    def _other(self, i: int) -> bool:
        """Whether something that is no signature begins here."""
        x = self.lines[i]
        return bool(_MARK.match(x) or _DIVIDER.match(x) or _RULE.match(x) or _NOTICE.match(x) or legalese(x) or _ITSELF.match(x) or self._intro(i) or self._is_header(i))

    def _is_header(self, i: int) -> bool:
        m = _HEADER.match(self.lines[i])
        return bool(m and m[1] in _SENDERS and i + 1 < len(self.lines) and _HEADER.match(self.lines[i + 1]))

    def _ends(self, j: int) -> bool:
        """Whether nothing newly written can follow: the end, or something that is no signature."""
        k = _skip_blank(self.lines, j)
        return k >= len(self.lines) or self._other(k) or bool(_DELIMITER.match(self.lines[k]) or _DEVICE.match(self.lines[k].strip()))

    def signature(self, i: int) -> Node | None:
        lines, x = self.lines, self.lines[i].strip("\r")
        if _DEVICE.match(x.strip()):
            return Node("signature", self.base + i, self.base + i + 1)
        if _DELIMITER.match(x):
            return Node("signature", self.base + i, self.base + self._block(i + 1, x.startswith("--")))
        formula = bool(_CLOSING.match(x.strip()))
        if not formula and not (x.rstrip().endswith(",") and len(x.split()) <= 5 and i and any(y.strip() for y in lines[max(0, i - 3) : i])):
            return None
        j = self._block(i + 1, False)
        blank = i + 1 >= len(lines) or not lines[i + 1].strip()
        if not formula:  # any short line with a comma before a name with which the mail ends
            named = not blank and _NAME.match(lines[i + 1].strip()) and j < i + 9
            return Node("signature", self.base + i, self.base + j) if named and self._ends(j) else None
        if j < len(lines) and lines[j].strip() and not self._other(j):  # what goes on is a sentence
            return None
        if blank and (k := _skip_blank(lines, i + 1)) < len(lines) and _NAME.match(lines[k].strip()):
            j = self._block(k, False)
            if j < len(lines) and lines[j].strip() and not self._other(j):
                j = i + 1
        return Node("signature", self.base + i, self.base + max(j, i + 1))


def lines_of(text: str) -> list[str]:
    return [x.rstrip("\r") for x in text.split("\n")]


def parse(text: str) -> list[Node]:
    return Grammar(lines_of(text)).mail()


def authored(text: str) -> str:
    """The newly written lines, runs of blank lines squeezed."""
    lines = lines_of(text)
    kept = "\n".join("\n".join(lines[n.start : n.end]) for n in parse(text) if n.kind == "authored")
    return re.sub(r"\n{3,}", "\n\n", kept).strip("\n")


def others(text: str) -> list[int]:
    """Numbers, from 1, of the non-blank lines the sender didn't newly write."""
    lines = lines_of(text)
    return [i + 1 for n in parse(text) if n.kind != "authored" for i in range(n.start, n.end) if lines[i].strip()]


def decode(body: str | None, kind: str | None, transfer: str | None) -> str:
    if not body:
        return ""
    transfer = (transfer or "").strip().lower()
    if transfer not in ("base64", "quoted-printable"):
        return body
    try:
        raw = base64.b64decode(re.sub(r"[^A-Za-z0-9+/=]", "", body) + "==") if transfer == "base64" else quopri.decodestring(body.encode("utf-8", "surrogatepass"))
    except (binascii.Error, ValueError):
        return body
    m = re.search(r"charset\s*=\s*\"?([^\s\";]+)", kind or "", re.I)
    try:
        return raw.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return raw.decode("latin-1")


class _Html(HTMLParser):
    _BLOCK = {"div", "p", "br", "tr", "li", "blockquote", "h1", "h2", "h3", "h4", "table", "ul", "ol", "hr", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.quoted, self.skip = [""], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "title"):
            self.skip += 1
        if tag == "blockquote":
            self.quoted += 1
        if tag in self._BLOCK and (self.out[-1] or tag == "br"):
            self.out.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head", "title"):
            self.skip = max(0, self.skip - 1)
        if tag in self._BLOCK and self.out[-1]:
            self.out.append("")
        if tag == "blockquote":
            self.quoted = max(0, self.quoted - 1)

    def handle_data(self, data):
        if not self.skip:
            data = data.replace("\n", " ") if self.out[-1] else data.strip("\n").replace("\n", " ")
            if data:
                self.out[-1] = (self.out[-1] or "> " * self.quoted) + data


def html_lines(html: str) -> str:
    p = _Html()
    p.feed(html)
    p.close()
    return "\n".join(p.out)


def _parts(parts: DataFrame) -> DataFrame:
    h = F.col("headers")
    return spread(parts.select("part_id", h["content-type"].alias("kind"), h["content-transfer-encoding"].alias("transfer"), "body"))


def _each(frames, emit, columns):
    for pdf in frames:
        out = []
        for pid, kind, transfer, body in zip(pdf["part_id"], pdf["kind"], pdf["transfer"], pdf["body"]):
            out.extend(emit(pid, (kind or "text/plain").strip().lower(), decode(body, kind, transfer)))
        yield pd.DataFrame(out, columns=columns)


def foreign_lines(parts: DataFrame) -> DataFrame:
    """(part_id, line_no) of the non-blank lines of text/plain parts that the sender didn't newly write."""
    emit = lambda pid, kind, text: ((pid, i) for i in others(text)) if kind.startswith("text/plain") else ()
    return _parts(parts).mapInPandas(lambda frames: _each(frames, emit, ["part_id", "line_no"]), "part_id bigint, line_no bigint").distinct()


def new_text(parts: DataFrame) -> DataFrame:
    """(part_id, new_text) of each text part; HTML parts are read as lines first."""
    def emit(pid, kind, text):
        yield pid, authored(html_lines(text) if kind.startswith("text/html") else text)

    return _parts(parts).mapInPandas(lambda frames: _each(frames, emit, ["part_id", "new_text"]), "part_id bigint, new_text string")
