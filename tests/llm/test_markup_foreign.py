"""Markup in pages written by hand, apart from the tables and the generator."""

from fernweh.llm import markup as M

FOREIGN = [
    ('We write the source as <syntaxhighlight lang="c">int a;</syntaxhighlight> here.', {"wiki"}), ("The vector \\myvec{a} has \\operatorname{rank} two.", {"latex"}), ("A text.<!--" + " note" * 3000 + " -->\nMore.", {"html"}), ("So\n\\[" + " x + y = z" * 400 + " \\]\nholds.", {"latex"}),
    ("Dear all, the price rose from 3 to 4 in May. Tom & Co. agreed; see p. 7.", set()), ("#REDIRECT [[Old harbour]]", {"wiki"}), ("The harbour ({{lang|la|portus}}) is old.", {"wiki"}), ("Call `make install` and then **wait**.", {"markdown"}), ("Tea &hellip; and more&nbsp;tea.", {"html"}),
    ("int main(void) {\n    return a < b && c > d;\n}", set()), ("Type cd ~/docs and ls *.txt there.", set()), ("See <https://a.example/~joe/x> or ask joe.", set()), ("We have $E = mc^{2}$ and $\\alpha$ here.", {"latex"}), ("<p>One <em>two <strong>three</strong></em></p>", {"html"}), ("1. first\n2. second\n\nThen go on.", set()),
    ("Heading\n-------\n\nSome words follow it.", {"markdown"}), ("x = [[1, 2], [3, 4]]\nprint(x)", set()), ("The set {a, b} and the list [a, b] differ.", set()), ("| Name | Age |\n| --- | --- |\n| Ann | 7 |", {"markdown"}), ("{| class=wikitable\n|-\n| a || b\n|}", {"wiki"}),
    ("grep -E '^[a-z]+$' x.txt | sort > y.txt", set()), ("std::map<int, std::string> m;", set()), ("\\begin{align*}\na &= b \\\\\nc &= d\n\\end{align*}", {"latex"}), ("The file is at C:\\Users\\ann\\old_notes.txt now.", set()),
]


def test_pages_of_another_hand():
    assert [t for t, kinds in FOREIGN if M.read(t)[1] != kinds] == []


def test_cleaning_leaves_what_is_no_markup():
    assert M.clean("An \\emph{old} page: <https://a.b/~joe/x> and ~/docs, see Fig.~3.") == "An old page: <https://a.b/~joe/x> and ~/docs, see Fig. 3."
    assert M.clean("#REDIRECT [[Foo]]") == "#REDIRECT Foo"
    assert M.clean("{{Infobox|a={{b|c}}}}\n'''Foo''' is old.") == "a: c\nFoo is old."
    assert M.clean("\\textbf{a \\emph{b \\text{c \\underline{d \\texttt{e}}}}} \\foo{x}") == "a b c d e \\foo{x}"


def test_deep_nesting():
    deep = "{{x|" * 3000 + "y" + "}}" * 3000
    assert M.clean("'''b''' " + deep) == "b y"
    assert M.read("<b>" * 3000 + "x" + "</b>" * 3000)[1] == {"html"}
    assert M.read("<!-- a\n" * 3000)[1] == {"html"} and M.read("\\[ a \n" * 3000 + "\\emph{x}")[1] == {"latex"}


def test_nodes_nest():
    tree = M.parse("<p>a <b>c <i>d</i></b></p> and <br> e")
    assert [c.feature for c in tree.children[0].children] == ["html.tag", "html.tag", "html.end", "html.tag"]
    assert [c.feature for c in tree.children[0].children[1].children] == ["html.tag", "html.end"]
