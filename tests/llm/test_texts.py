"""Encoding repair, markup, look-alikes and leaks."""

import random

import pytest

from fernweh.llm import encoding as E
from fernweh.llm import leaks as L
from fernweh.llm import lookalikes as K
from fernweh.llm import markup as M

WORDS = "größer Brücke schließen später Zähler Möhren geändert natürlich gehört Straße français élève théâtre déjà préféré".split()


def corpus(n=60):
    rng = random.Random(2)
    return [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def damaged():
    good = corpus()
    bad = {
        1000: good[0].encode("utf-8").decode("cp1252", "replace").replace("�", "\x9d"), 1001: good[1].encode("cp1252").decode("cp850"), 1002: good[2].encode("mac_roman").decode("cp1252", "replace"), 1003: good[3].encode("utf-8").decode("mac_roman"),
        1004: good[4].encode("cp1252").decode("utf-8", "replace"), 1005: "vorher " + "Brücke".encode().decode("cp1252") + " nachher größer", 1006: good[6].encode("utf-8").decode("gbk", "replace"),
    }
    return good, bad


def test_encoding(spark, damaged):
    good, bad = damaged
    rows = [(i, t, "x", None) for i, t in enumerate(good)] + [(i, t, "x", None) for i, t in bad.items()]
    rows += [(2000, None, "", None), (2001, "", "", None), (2002, "plain ascii", "", None), (2003, "Ð and ð are letters; √2 ≈ 1.4, Œuvre, 会議 Ångström", "", None), (2004, good[0] + " alone � here", "", None), (None, good[0], "", None)]
    df = spark.createDataFrame(rows, "id long, data string, chunk string, channel int")
    out = {r.id: r for r in E.restore(df).collect()}
    assert set(out) == set(bad)
    same = sum(a == b for a, b in zip(out[1001].restored.split(), good[1].split())) / 60
    assert same > 0.95 and out[1005].restored == "vorher Brücke nachher größer"
    assert sum(a.lower() == b.lower() for a, b in zip(out[1004].restored.split(), good[4].split())) > 40
    assert E.restore(df.limit(0)).count() == 0


def test_lost_letters_follow_the_language(spark):
    rows = ["a casa tem três janelas e o mês foi longo"] * 40 + ["la maison est très belle, il était très tôt"] * 15 + ["el perro quiere más agua"] * 10
    damaged = {900: "la maison est tr�s belle", 901: "a casa tem tr�s janelas", 902: "el perro quiere m�s agua", 906: "o M�S foi longo", 903: "il �tait tr�s t�t", 904: "x tr�s", 905: "zq�x und �"}
    df = spark.createDataFrame([*enumerate(rows), *damaged.items()], "id long, data string")
    out = {r.id: (r.restored, r.whole) for r in E.restore(df).collect()}
    assert out == {
        900: ("la maison est très belle", True), 901: ("a casa tem três janelas", True), 902: ("el perro quiere más agua", True), 906: ("o MÊS foi longo", True),
        903: ("il était très tôt", True), 904: ("x três", True), 905: ("zq�x und �", False),
    }
    assert {r.id for r in E.restore(df, wording=False).collect()} == set(damaged)


def test_lost_bytes_of_letters_and_signs_beside_damage(spark):
    good = ["die Bücher stehen im früheren Frühstück ähnlich", "er sagte: „ja” und ging dann später nach oben", "le café déjà fermé"] * 30
    bad = {
        900: ("alle BÃ\ufffdcher dort", "alle Bücher dort"), 901: ("etwas \u00abÃ¤hnlich\u00bb war", "etwas \u00abähnlich\u00bb war"), 902: ("ein frÃ¼\ufffdst\ufffdck", "ein frÃ¼\ufffdst\ufffdck"), 903: ("er sagte jaâ€\ufffd und ging", "er sagte ja” und ging"),
        904: ("ein Fr\ufffdhstück hier", "ein Frühstück hier"), 905: ("le cafÃ\ufffd dÃ©jÃ\ufffd", "le café déjà"),
    }
    del bad[902]
    df = spark.createDataFrame([*enumerate(good), *((k, v[0]) for k, v in bad.items())], "id long, data string")
    out = {r.id: r.restored for r in E.restore(df).collect()}
    assert out == {k: v[1] for k, v in bad.items()}


def test_lattice():
    k = next(k for k, c in enumerate(E.CHANNELS) if c[0] == "utf-8 as cp1252")
    assert E.lattice("BÃ\ufffdcher", k) == ("B\ufffdcher", 0) and E.lattice("â€\ufffd", k) == ("”", 0) and E.lattice("\u00abÃ¤\u00bb", k) == ("\u00abä\u00bb", 2)
    assert E.lattice("größer", k) is None and E.lattice("\ufffd", k) is None and E.lattice("\ufffd" * 5000, k) is None


@pytest.mark.parametrize("k", range(len(E.CHANNELS)))
def test_channels_round_trip(k):
    _, wrong, right, times = E.CHANNELS[k]
    for word in ("Größe", "élève", "żółty", "ответ", "学生", "it’s"):
        s = word
        try:
            for _ in range(times):
                s = s.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if s != word and not ("一" <= max(s) <= "鿿" and wrong != "gbk"):
            assert E.read_as(s, k) == word


PAGES = {
    "html": ["<p>One</p>", "a&nbsp;b", "x</span> y", "&lt;b&gt;x&lt;/b&gt;", "<table border=1><tr><td>a</td><td>b</td></tr></table>", "text<!-- c -->"], "markdown": ["# Head\n\ntext", "Head\n====\n\ntext", "see [a](https://x.example/)", "```\nx = 1\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "**bold** and `code`", "* [ ] do\n* [x] done"],
    "wiki": ["== Head ==\ntext", "see [[Page|name]]", "{{Infobox x\n| a = b\n}}\ntext", "'''bold''' text", "{| class=\"wikitable\"\n! a !! b\n|-\n| 1 || 2\n|}", "[https://x.example/ label]"], "latex": ["\\section{Head}\ntext", "where $\\alpha \\leq \\frac{a}{b}$", "\\begin{itemize}\n\\item a\n\\end{itemize}", "\\[ \\sum_{i=1} x \\]"],
}


@pytest.mark.parametrize("kind,page", [(k, p) for k, ps in PAGES.items() for p in ps])
def test_markup_kinds(kind, page):
    assert M.read("Some prose before it.\n\n" + page)[1] == {kind}


@pytest.mark.parametrize("page", ["def f(a, b=1):\n    return a == b\n# copies that query\n", "$ ls --all > out.log", "Use list<draft> in the header, not map<int, x>.", "Mail a <b@c.example> or visit https://x.example/a_b_c", "if [[ -f a.txt ]]; then x == y", "from C:\\draft\\old_x.doc to D:\\", "It costs $ 23 to $ 47, see #738.", "Total = 4 * 51 * queue_count", "If a < 81 and b > 72, call.", "- one\n- two", "1. a\n2. b", "", "prose"])
def test_no_markup(page):
    assert M.read(page)[1] == set() and M.clean(page) == page


def test_mixed_and_held_out_accuracy():
    assert M.read("### Head\n\ntext <kbd>x</kbd>")[1] == {"markdown", "html"}
    pages = list(M._training(300, seed=99))
    right = sum(M.read(t)[1] == k for t, k in pages)
    assert right / len(pages) > 0.93


def test_cleaning_keeps_structure():
    assert M.clean("<h1>T</h1><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table>") == "T\n\n- a\n- b\n\n1 | 2"
    assert M.clean("# T\n\n- **a**\n\n```py\nx = 1\n```") == "T\n\n- a\n\nx = 1"
    assert M.clean("== T ==\n* [[P|name]] ''x''\n{|\n! a !! b\n|-\n| 1 || 2\n|}") == "T\n- name x\na | b\n1 | 2"
    assert M.clean("\\section{T}\n\\begin{itemize}\n\\item a $\\frac{1}{2}$\n\\end{itemize}") == "T\n- a \\frac{1}{2}"
    assert M.clean("a &lt; b &amp; c") == "a < b & c"


def test_markup_frames(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "a"), (2, None, "b"), (3, "", "c"), (3, "# h\n\ntext", "c"), (4, "plain " * 50_000, None)], "id long, data string, text string")
    assert sorted(map(tuple, M.kinds(df).collect())) == [(1, "html"), (3, "markdown")]
    got = {(r.text_id, r.changed) for r in M.cleaned(df).collect()}
    assert got == {(1, True), (2, False), (3, False), (3, True), (4, False)}
    assert M.kinds(df.limit(0)).count() == 0


def test_lookalikes(spark):
    base = "The quick résumé of a pretty copy, cop and sea.\nОтвет на вопрос о сахаре."
    same = [base.replace("e", "е"), base.replace("é", "é"), base.replace(" of ", " of "), base.replace("quick", "qu​ick"), base.replace("pretty", "ｐｒｅｔｔｙ"), base.replace("Ответ", "Oтвeт"), base.replace("cop ", "сор ")]
    other = [base.replace("é", "e"), base.lower(), base + "1", base.replace("copy", "cope")]
    rows = [(i, t) for i, t in enumerate([base, *same, base, *other])] + [(50, None), (51, ""), (52, "​"), (None, base.replace("e", "е"))]
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, form string, form_hash binary")
    got = set(map(tuple, K.same_look(docs).collect()))
    n = len(same)
    group = set(range(n + 2))
    text = dict(rows)
    want = {(a, b) for a in group for b in group if a < b and text[a] != text[b]} | {(51, 52)}
    assert got == want
    assert K.same_look(docs.limit(0)).count() == 0
    classes = {r.doc_id: (r.look, r.texts) for r in K.look_classes(docs).collect()}
    assert set(classes) == {x for pair in want for x in pair} and {classes[0]} == {classes[k] for k in group} and classes[51][1] == 2
    forms = {r.doc_id: r.form for r in K.forms(docs).collect() if r.doc_id is not None}
    assert forms[0] == base and forms[6] == base


def test_lookalike_reading_depends_on_looks_only():
    reader = K.Reader({"^c": 5, "co": 5, "op": 5, "p$": 5, "^с": 1, "со": 1, "ор": 1, "р$": 1})
    assert reader.word("cop") == reader.word("сор") == reader.word("cор") == "cop"
    assert K.plain("👩‍💻 a‍b") == "👩‍💻 ab" and K.skeleton("ﬁnal x²") == "final x²"


@pytest.mark.parametrize("odd,form", [("wo\u3164rd", "word"), ("wo\U000e0041rd", "word"), ("wo\uffa0rd", "word"), ("\u13aaB\u13df", "ABC"), ("\U0001d407i \U0001d7d9", "Hi 1"), ("\u2163 \ufb01n \u2026", "IV fin ..."), ("\uff11\uff12", "12"), ("a\u200bb\u2060c\ufeff", "abc")])
def test_characters_that_look_the_same(odd, form):
    assert K.skeleton(odd) == form and K.Reader({"^A": 9, "AB": 9, "BC": 9, "C$": 9}).text(odd) == form


@pytest.mark.parametrize("kept", ["x\u00b2", "\u00bd", "\u2474", "\u017f", "\u3131\u314f", "\u0605 1", "\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U0001f469\u200d\U0001f4bb"])
def test_characters_that_look_different_stay(kept):
    assert K.plain(kept) == kept


def brute(doc, item, apart=8):
    """Longest stretch by filling all cells: words of the item by (words since the last edit) at each pair of positions."""
    a, b = L.words(doc), L.words(item)
    cell = {}
    best = 0
    for d in range(len(a) + 1):
        for i in range(len(b) + 1):
            now = {apart: 0}
            if d and i and a[d - 1] == b[i - 1]:
                for s, n in cell[d - 1, i - 1].items():
                    now[min(apart, s + 1)] = max(now.get(min(apart, s + 1), 0), n + 1)
                best = max(best, *now.values())
            for x, y, n in ((d - 1, i - 1, 1), (d, i - 1, 1), (d - 1, i, 0)):
                if x >= 0 and y >= 0 and cell[x, y][apart] and not (n and x < d and a[d - 1] == b[i - 1]):
                    now[0] = max(now.get(0, 0), cell[x, y][apart] + n)
            cell[d, i] = now
    return best


def coded(doc, item):
    items = L.Items([(1, item)])
    return bool(items.found(L.np.array([items.ids.get(x, 0) for x in L.words(doc)], dtype=L.np.int32)))


def test_a_clean_stretch_beside_a_densely_edited_one():
    w = [f"w{k}" for k in range(100)]
    edited = ["x" if k % 6 == 5 else x for k, x in enumerate(w[:70])]
    assert not coded(" ".join(edited), " ".join(w))
    assert coded(" ".join(edited + w[10:32]), " ".join(w)) and coded(" ".join(w[10:32] + edited), " ".join(w))
    assert not coded(" ".join(edited + w[10:29]), " ".join(w)) and coded(" ".join(edited + w[10:30]), " ".join(w))
    assert coded(" ".join(w[:10] + ["x"] + w[11:19] + w[20:30]), " ".join(w)) and not coded(" ".join(w[:6] + w[7:10] + ["x"] + w[11:20]), " ".join(w))


def test_stretches_equal_those_of_all_paths():
    rng = random.Random(12)
    shown = 0
    for _ in range(150):
        item = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(20, 40))]
        doc = list(item[rng.randrange(0, 8) :])
        for _ in range(rng.randint(0, 3)):
            at, act = rng.randrange(len(doc)), rng.randrange(4)
            doc[at : at + 1] = [["zz9"], [], [doc[at], "q9"], [doc[at], doc[at]]][act]
        doc = ["x1", "x2", *doc, *item[: rng.randint(0, 12)]]
        a, b = " ".join(doc), " ".join(item)
        assert coded(a, b) == (brute(a, b) >= 20), (a, b)
        shown += brute(a, b) >= 20
    assert 30 < shown < 140


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(60)) + ".") for k in range(12)] + [(90, None), (91, "")]
    docs = []
    for k in range(80):
        w = items[k % 12][1].rstrip(".").split()
        lo, n = rng.randrange(0, 25), rng.randrange(8, 34)
        part = w[lo : lo + n]
        for p in range(9 + k % 5, len(part) - 1, 9 + k % 5):
            act = rng.randrange(3)
            part[p : p + 1] = [rng.choice(vocab)] if act == 0 else [] if act == 1 else [part[p], rng.choice(vocab)]
        body = " ".join(part)
        body = body.upper() if k % 7 == 0 else body.replace(" ", "\n> ") if k % 7 == 1 else body.replace("a", "а") if k % 7 == 2 else body
        docs.append((k, " ".join(say(40)) + "\n> " + body + " " + " ".join(say(40))))
    rows = [(i, t, 1) for i, t in docs] + [(200, None, 1), (201, "", 1), (202, "few words", 1), (0, docs[0][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    ev = spark.createDataFrame([(i, p, "q") for i, p in items], "item_id long, passage string, text string")
    got = set(map(tuple, L.leaks(df, ev).collect()))
    want = {(d, i) for d, t in docs for i, p in items if p and d % 12 == i and brute(t, p) >= 20}
    assert got == want and 15 < len(want) < 60
    assert L.leaks(df.limit(0), ev).count() == 0 and L.leaks(df, ev.limit(0)).count() == 0


def test_more_items_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 100)
    ev = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(9)], "item_id long, passage string")
    docs = ev.selectExpr("item_id AS doc_id", "passage AS text")
    assert sorted(map(tuple, L.leaks(docs, ev).collect())) == [(k, k) for k in range(9)]
