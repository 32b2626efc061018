import io
import struct
import zipfile

from fernweh.sources import extract, sinks


def pack(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return b.getvalue()


W = 'xmlns:w="w" xmlns:a="a" xmlns:r="http://r"'


def test_plain_text():
    assert extract.extract("a.txt", b"\xef\xbb\xbfhi\r\n")[2] == "hi\n"
    assert extract.extract("a.txt", "café".encode("cp1252") * 50)[2].startswith("café")
    assert extract.extract("a.bin", b"\0\1\2")[:2] == ("skipped", "binary")
    assert extract.extract("a.txt", b"")[:2] == ("skipped", "empty") == extract.extract("a.txt", None)[:2]
    assert extract.extract("a.txt", "x".encode("utf-16"))[2] == "x"
    assert extract.extract("k.pem", b"-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----")[:2] == ("skipped", "secret")
    assert extract.extract("x.pdf", b"%PDF")[:2] == ("skipped", "unsupported")


def test_html():
    t = extract.html_text("<html><head><title>T</title><style>x</style></head><body><h1>A&amp;B</h1><p>one<br>two</p><table><tr><td>1</td><td>2</td></tr></table><script>no</script></body></html>")
    assert "T" in t and "A&B" in t and "one\ntwo" in t and "1\t2" in t and "no" not in t


def test_office():
    docx = pack({"word/document.xml": f'<w:document {W}><w:p><w:t>Hello</w:t></w:p><w:p><w:t>World</w:t><w:tab/></w:p></w:document>', "word/footnotes.xml": f"<w:f {W}><w:p><w:t>note</w:t></w:p></w:f>"})
    assert extract.extract("a.docx", docx)[2] == "Hello\nWorld\n\nnote"
    pptx = pack({
        "ppt/presentation.xml": f'<p {W}><sldId id="1" r:id="r2"/><sldId id="2" r:id="r1"/></p>', "ppt/_rels/presentation.xml.rels": '<R><x Id="r1" Target="slides/slide1.xml"/><x Id="r2" Target="slides/slide2.xml"/></R>',
        "ppt/slides/slide1.xml": f"<s {W}><a:p><a:t>first</a:t></a:p></s>", "ppt/slides/slide2.xml": f"<s {W}><a:p><a:t>second</a:t></a:p></s>",
    })
    assert extract.extract("a.pptx", pptx)[2] == "second\ffirst"
    xlsx = pack({
        "xl/workbook.xml": f'<w {W}><sheet name="S" r:id="r1"/></w>', "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": "<s><si><t>word</t></si></s>",
        "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>5</v></c><c t="b"><v>1</v></c></row></w>',
    })
    assert extract.extract("a.xlsx", xlsx)[2] == "S\nword\t5\tTRUE"
    odt = pack({"content.xml": "<d><body><h>Head</h><p>text<tab/>x</p></body></d>"})
    assert extract.extract("a.odt", odt)[2] == "Head\ntext\tx"
    epub = pack({"META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p><item id="a" href="1.html"/><item id="b" href="2.html"/><itemref idref="b"/><itemref idref="a"/></p>', "O/1.html": "<p>one</p>", "O/2.html": "<p>two</p>"})
    assert extract.extract("a.epub", epub)[2] == "two\fone"
    assert extract.extract("a.docx", b"junk")[0] == "error"


def test_other_formats():
    assert extract.rtf(b"{\\rtf1{\\fonttbl x}Hello\\par caf\\'e9 \\u8364?{\\*\\gen z}\\tab end}") == "Hello\ncafé €\tend"
    eml = b"Subject: =?utf-8?q?Caf=C3=A9?=\r\nFrom: a@b.example\r\nContent-Type: multipart/alternative; boundary=X\r\n\r\n--X\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nna=C3=AFve\r\n--X\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--X--\r\n"
    assert "Café" in extract.mail(eml) and "naïve" in extract.mail(eml) and "no" not in extract.mail(eml).split("\n\n")[1]
    assert extract.notebook(b'{"cells":[{"source":["a\\n","b"]},{"source":"c"}]}') == "a\nb\n\nc"
    assert extract.calendar(b"BEGIN:VEVENT\r\nSUMMARY:Tea\\, cake\r\n  and more\r\nUID:1\r\n") == "summary: Tea, cake and more"
    assert extract.strings(b"\0\0hello world\0\1\2abc") == "hello world"
    assert extract.palmdoc(b"abc \x80\x1b"[:4] + bytes([0x80 | (4 << 3 >> 8), (4 << 3 & 0xFF) | 0])) == b"abc abc"
    head = struct.pack(">HHIHHHI", 1, 0, 3, 1, 4096, 0, 0) + b"\0" * 20
    book = b"n" * 76 + struct.pack(">H", 2) + struct.pack(">II", 94, 0) + struct.pack(">II", 94 + len(head), 0) + head + b"<p>Hi</p>"
    assert extract.mobi(book) == "Hi"
    assert extract.legacy(b"{\\rtf1 x}") == "x" and extract.legacy(b"<html><p>y</p>") == "y"


def test_read_folder_and_sinks(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.md").write_text("# x")
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.text) for r in extract.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.md"] == ("indexed", "# x") and got["b.docx"][0] == "error"
    hits = spark.createDataFrame([('a"b', "text", 1)], "path string, kind string, size long")
    assert sinks.rendered(hits, "csv").first()[0] == '"a""b","text","1"'
    assert sinks.rendered(hits, "nul").first()[0] == 'a"b\0'
    sinks.write(hits, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_merged_pages(spark):
    own = spark.createDataFrame([(1, "text one\f--\flast page")], "id long, text string")
    scan = spark.createDataFrame([(1, "zz\fscanned page\fqq")], "id long, text string")
    assert extract.merge_pages(own, scan).first().text == "text one\fscanned page\flast page"


def test_a_registered_reader_reaches_the_workers(spark):
    extract.register("zzz", lambda data: data.decode()[::-1])
    try:
        got = extract.extracted(spark.createDataFrame([("/a/b.zzz", bytearray(b"abc"))], "path string, content binary")).collect()
        assert [(r.text, r.status) for r in got] == [("cba", got[0].status)]
    finally:
        extract._plugins.pop("zzz")
