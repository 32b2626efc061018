"""Scans and mails."""

import random

from fernweh.llm import mail, scans


def book():
    rng = random.Random(6)
    vocab = "the narrow bridge repaired every lantern during quiet morning while another teacher described modern furnaces behind signed contract and several workers returned with second-hand tools near harbour".split()
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    def page(k, title):
        body = [prose(8) for _ in range(14)]
        return f"{title}\n\n" + "\n".join(body) + f"\n\n     Page {k} of 3"
    return ["\f".join(page(k, f"ANNUAL NOTES OF {c}") for k in (1, 2, 3)) for c in ("ALPHA", "BETA", "GAMMA", "DELTA", "OMEGA", "KAPPA", "SIGMA", "THETA")]


def test_furniture():
    t = book()[0]
    lines = [x for p in t.split("\f") for x in p.split("\n")]
    got = scans.furniture(t)
    assert {lines[n - 1].strip() for n in got} == {"ANNUAL NOTES OF ALPHA", "Page 1 of 3", "Page 2 of 3", "Page 3 of 3"} and len(got) == 6
    assert scans.furniture("diary 7 x 47.87\nTotal\n156") == set()
    assert scans.furniture("text of a page that goes on\n\n     23") == {3}
    assert scans.furniture("") == set()


def test_noise_and_text(spark):
    good = book()
    good[0] = good[0].replace("\n\n", "\n\nnear every lantern again\n", 1).replace("again", "behind", 1)
    bad = good[0].replace("every lantern", "evcry lan-\ntern", 1).replace("second-hand", "second-\nhand", 1).replace("bridge", "bri-\ndge", 1).replace("modern", "rnodem", 1).replace("ANNUAL", "@NNUAL", 1)
    rows = [(k, t, "w", 1) for k, t in enumerate(good)] + [(100, bad, "w", 1), (101, None, "w", 1), (102, "", "w", 1), (103, "x\f\f\n\fy", "w", 1), (104, "word-", "w", 1), (None, "a b", "w", 1)]
    df = spark.createDataFrame(rows, "id long, data string, word string, n long")
    noise = {}
    for r in scans.noise(df).collect():
        noise.setdefault(r.id, set()).add((r.line_no, r.noise))
    assert all(kind == "furniture" for k in range(8) for _, kind in noise[k])
    lines = [x for p in bad.split("\f") for x in p.split("\n")]
    hy = {lines[n - 1].split()[-1] for n, kind in noise[100] if kind == "hyphen"}
    mis = {n for n, kind in noise[100] if kind == "misread"}
    assert hy == {w for w in ("lan-", "bri-") if any(x.endswith(w) for x in lines)}
    assert {n for n, x in enumerate(lines, 1) if "evcry" in x or "rnodem" in x} == mis
    text = {r.id: r.text for r in scans.repaired(df).collect()}[100]
    assert "Page" not in text and "NNUAL" not in text and "every lantern" in text and "second-hand" in text and "rnodem" not in text and "-\n" not in text
    assert scans.noise(df.limit(0)).count() == 0


def test_candidates(spark):
    pairs = [("rnodem", "modern"), ("c1ear", "clear"), ("qii1ck", "quick"), ("1nf0rm@t10n", "information"), ("l0ng" * 12, "long" * 12), ("l", "i"), ("sec0nd-h@nd", "second-hand"), ("vvlndovv", "window"), ("cllclclcd", "dlddcd")]
    assert all(scans.channel(a, b) is not None for a, b in pairs)
    assert scans.channel("648", "648") == 0.0 and scans.channel("cat", "dog") is None and scans.channel("c1ear", "clear") > scans.channel("c1car", "clear")
    df = spark.createDataFrame(pairs, "a string, b string").select(scans.stroke_key(scans.F.col("a")).alias("a"), scans.stroke_key(scans.F.col("b")).alias("b"))
    assert df.filter("a <> b").count() == 0
    one = spark.createDataFrame([(x, y) for x, y, _ in scans.CONFUSIONS], "a string, b string").select(scans.stroke_key(scans.F.col("a")).alias("a"), scans.stroke_key(scans.F.col("b")).alias("b"))
    assert one.filter("a <> b").count() == 0


def kept(text):
    return mail.authored(text)


def test_quotes_introductions_and_nesting():
    assert kept("Hi\n\nNew text.\n\nOn 8 May 2023 A B wrote:\n> old\n>> older\n") == "Hi\n\nNew text."
    assert kept("Am 01.08.2023 um 03:18 schrieb A B:\n>alt\n\nNeu.\n\n>alt2\n\nAuch neu.") == "Neu.\n\nAuch neu."
    assert kept("x\n\nEl 4 de may. de 2021, A B\n<a@b.example> escribió:\n| viejo\n") == "x"
    assert kept("x\n\nA B schrieb am 9. 7. 2023:\n> y") == "x"
    assert kept("x\n\nOn Monday A B wrote: that the query describes it.") == "x\n\nOn Monday A B wrote: that the query describes it."
    assert kept("x\n>= 87 per passage will do.") == "x\n>= 87 per passage will do."


def test_forwards_signatures_and_notices():
    assert kept("x\n\n-----Original Message-----\nFrom: A\nSent: 1 Jan\nTo: B\n\nold text\n") == "x"
    assert kept("x\nFrom: A to B takes 3 hours.") == "x\nFrom: A to B takes 3 hours."
    assert kept("x\n\nKind regards\nA B\n\n-- \nA B\nLead\nwww.a.example\n") == "x"
    assert kept("x\n---\n\ny\n-- palette, lathe") == "x\n---\n\ny\n-- palette, lathe"
    assert kept("x\n\nSent from my phone\n\n________________\nDisclaimer: for the addressee\nonly.\n") == "x"
    assert kept("x\nSent from Vloford by ferry, so allow 3 days.") == "x\nSent from Vloford by ferry, so allow 3 days."
    assert kept("x\nRegards to Ann and the cache!") == "x\nRegards to Ann and the cache!"


# Written by hand, apart from the tables: what the sender wrote stands first.
MAILS = [
    ("Hi Bob,\n\nsee you soon.", "\n\nTake care,\nAnn Lee"), ("Hoi,\n\ntot dan.", "\n\nMet vriendelijke groet,\nJan"), ("ok", "\n\nOp ma 3 jan 2022 om 10:15 schreef Jan Jansen:\n> oud"), ("ok", "\n\nW dniu 3.01.2022 o 10:15, Jan Kowalski pisze:\n> stare"),
    ("ok", "\n\nThis e-mail and any files transmitted with it are privileged and intended solely for the addressee. If you received it in error, delete it."), ("a\n\nOn Monday I wrote a report at 10:\nit was long\nand good", ""),
    ("x", "\n\nBest\nA B\nHead of Works\nFirm Ltd\n1 Street\n12345 Town\n+44 123 456789\nwww.a.example\nOffice 7"), ("x", "\n\n-- \nA\n1\n2\n3\n4\n5\n6\n7\n8\n9\n10\n\n> q"), ("Thanks\nfor the help with it, we go on now.", ""),
    ("Ciao,\n\na domani.", "\n\nCordiali saluti,\nMaria Rossi\nUfficio Tecnico"), ("Hej!\n\nVi ses.", "\n\nMed vänlig hälsning\nEva"), ("ok", "\n\nOn Tue, Jan 4, 2022 at 3:15 PM Ann Lee <ann@b.example> wrote:\n\n> old\n> older"),
    ("We shall meet.", "\n\nAm Di., 4. Jan. 2022 um 15:15 Uhr schrieb Ann Lee <ann@b.example>:\n\nalter Text ohne Zeichen\nnoch mehr"), ("Sure.", "\n\n-- \nAnn Lee\n\nPhone: +44 20 1234567\nwww.lee.example"), ("Here is the list:\n\nBread,\nButter\n\nand that is all for now.", ""),
    ("She wrote that it was fine: I agree.", ""), ("fine", "\n\nLe mar. 4 janv. 2022 à 15:15, Ann Lee <ann@b.example> a écrit :\n> vieux"), ("Добрый день,\n\nвсё готово.", "\n\nС уважением,\nИван Петров"),
    ("ok", "\n\nCe message et les pièces jointes sont confidentiels et réservés au destinataire. Toute diffusion est interdite; en cas d'erreur, merci de le supprimer."), ("The contract is confidential; it may not be forwarded by mistake, so please delete your copy.", ""),
    ("On the table is the lamp.\nIt is old.", "\nOn 4 May 2022, A B wrote:\n> old"), ("Done.", "\n\nKind regards,\n\nAnn Lee\nTeam Lead"), ("Please answer these:\n1. when?\n2. where?", "\n\nSent from my phone"), ("Hello,\n\nas agreed.\n\nI think Best\nis a shop.", ""), ("ok", "\n\n" + "\n".join(["From: A B <a@b.example>", "Date: 1 Jan 2022", "To: C", "Subject: D", "", "old"])),
]


def test_mails_written_by_hand():
    assert [m for m, rest in MAILS if kept(m + rest) != m] == []


def test_long_paragraphs_cost_no_more_than_their_length():
    import time

    began = time.process_time()
    for line in ("On 3 May 2022 all is well", "Best,", "-- ", "From: x", "it wrote 3 things", "a" * 50, "> q", "Ann,"):
        mail.others("\n".join([line] * 5_000 + ["end:"]))
    assert time.process_time() - began < 30


def test_decoding():
    assert mail.decode("Y2Fm\nw6k=", "text/plain; charset=utf-8", "BASE64") == "café"
    assert mail.decode("caf=E9 =\r\nx", 'text/plain; charset="iso-8859-1"', "quoted-printable") == "café x"
    assert mail.decode("x", None, "7bit") == "x" and mail.decode(None, None, None) == ""
    assert mail.decode("=E9", "text/plain; charset=nope", "quoted-printable") == "é"


def test_frames(spark):
    rows = [(1, {"content-type": "text/plain"}, "a\r\n\r\n> q\r\n", 1), (2, None, "> q", 1), (3, {}, None, 1), (4, {"content-type": "text/html"}, "<div>a</div><blockquote>q</blockquote>", 1), (5, {}, "", 1), (1, {"content-type": "text/plain"}, "a\r\n\r\n> q\r\n", 1)]
    df = spark.createDataFrame(rows, "part_id long, headers map<string,string>, body string, line_no int")
    assert sorted(map(tuple, mail.foreign_lines(df).collect())) == [(1, 3), (2, 1)]
    new = {r.part_id: r.new_text for r in mail.new_text(df).collect()}
    assert new == {1: "a", 2: "", 3: "", 4: "a", 5: ""}
    assert mail.foreign_lines(df.limit(0)).count() == 0
    deep = "".join("> " * k + "x\n" for k in range(120))
    assert len(mail.others(deep)) == 119
