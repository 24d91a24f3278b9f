"""Text, locale, file, chat and plugin rules."""

import contextlib
import io
import re
import sys
import types
import zipfile
from dataclasses import dataclass

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions import locale, text
from sparkloom.plans.plugins import Extension, Plugins
from sparkloom.sources import files, office
from sparkloom.streaming import chat


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("s", ["", " ", "\t a \n", "\x1ca\x1f", "\x85a", "\xa0a　", "​a", "﻿a", "a b"])
def test_strip(spark, s):
    assert one(spark, text.strip_py(F.lit(s))) == s.strip()
    js = s.strip(text.WS_JS)
    assert one(spark, text.strip_js(F.lit(s))) == js
    assert one(spark, text.is_filled(F.lit(s))) == bool(s.strip())


def test_fill(spark):
    fill = lambda t, **v: one(spark, text.fill(F.lit(t), {k: F.lit(x) for k, x in v.items()}))
    assert fill("{a} of {b}", a="{b}", b="2") == "{b} of 2"
    assert fill("{a} {c}", a="1") == "{a} {c}"
    assert fill("plain") == "plain"


@pytest.mark.parametrize(
    ("tag", "want"),
    [("", "en-US"), (None, "en-US"), ("  ", "en-US"), ("fr-FR", "fr-FR"), ("ZH_tw", "zh-TW"), ("zh", "zh-CN"), ("FR", "fr-FR"), ("zh-Hant-TW", "zh-CN"), ("en-GB", "en-US"), ("pt-BR", "en-US"), ("*", "en-US")],
)
def test_locale(spark, tag, want):
    assert one(spark, locale.resolve_locale(F.lit(tag).cast("string"))) == want


def test_messages(spark):
    m = lambda tag, key, **v: one(spark, locale.message(F.lit(tag), F.lit(key), **{k: F.lit(x) for k, x in v.items()}))
    assert m("de", "status_list_done", count="3", active_count="1") == "3 Skills, davon 1 aktiv"
    assert m("de", "status_done") == "Finished"
    assert m("de", "nothing") == "nothing"
    assert m("en", "status_show_done", other="x") == "Read {name}"


def test_messages_of_all_locales(spark):
    """Each locale has a text of its own, with the same placeholders, for all keys but those that are left to English."""
    table = {(r.locale, r.key): r.template for r in locale.catalogue(spark).collect()}
    base = {k: t for (lang, k), t in table.items() if lang == locale.DEFAULT}
    for lang in set(locale.LOCALES) - {locale.DEFAULT}:
        own = {k: t for (at, k), t in table.items() if at == lang}
        assert set(base) - set(own) == {"msg_manual_enable_required"} | ({"status_done"} if lang == "de-DE" else set())
        assert all(t != base[k] and set(re.findall("{.*?}", t)) == set(re.findall("{.*?}", base[k])) for k, t in own.items())
    assert one(spark, locale.message(F.lit("fr"), F.lit("msg_created"))) == "La compétence a été sauvegardée"


def test_small_functions(spark):
    assert one(spark, text.unquote(F.lit('"'))) == ""
    assert one(spark, text.unquote(F.lit("'a\""))) == "'a\""
    assert one(spark, text.first_tag(F.lit("de-DE;q=0.5,en"))) == "de-DE"
    assert one(spark, text.list_items(F.lit(" a, b,,a ,c"))) == ["a", "b", "c"]
    assert one(spark, text.preview(F.lit("ab"))) == "ab..."
    assert one(spark, text.is_url(F.lit("https://a.b/c"))) and not one(spark, text.is_url(F.lit("not a url")))
    assert one(spark, text.basename(F.lit("/a/b.txt"))) == "b.txt"
    assert (one(spark, text.cell_column(F.lit("AB12"))), one(spark, text.cell_row(F.lit("AB12")))) == ("AB", 12)
    assert (one(spark, text.slide_number(F.lit("ppt/slides/slide7.xml"))), one(spark, text.slide_number(F.lit("x")))) == ("7", "?")
    assert one(spark, text.xml_texts(F.lit("<a xmlns:w='q'><w:t>x</w:t><w:t>y</w:t></a>"), "t")) == ["x", "y"]
    assert one(spark, text.label_or(F.lit("  "), "d")) == "d"
    with pytest.raises(PySparkException):
        one(spark, text.required_list(F.lit(" , "), "ids"))


def test_env(spark):
    raw = "# c\n\nexport A=1\n  B = 'two words'  \nA=again\nnokey\n=v\nC=\"\nD=a=b\r"
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(raw.split("\n"))] + [(0, 0, "A=shell")], "priority int, line int, value string")
    got = {r.key: r.value for r in files.merged_env(files.env_entries(rows)).collect()}
    assert got == {"A": "shell", "B": "two words", "C": "", "D": "a=b"}


def test_file_sources(spark, tmp_path):
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "b.md").write_text("---\nname: n\ndescription: d e\n---\n# T\nbody")
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "p.py").write_text('"""\ntitle: T\nversion: 1.0\n"""\nx: int = 1\n')
    at = f"file://{tmp_path}"
    assert files.first_file(spark, at).first().path.endswith("a.csv")
    assert files.first_file(spark, at, f"{at}/b.md").first().path.endswith("b.md")
    assert {r.path.rpartition("/")[2]: r.format for r in files.uploads(spark, at).collect()}["a.csv"] == "csv"
    doc = files.skill_documents(spark, f"{at}/b.md").first()
    assert (doc.name, doc.description, doc.body) == ("n", "d e", "# T\nbody")
    assert one(spark, files.front_matter(F.lit("no head"))).body == "no head"
    assert [(r.key, r.value) for r in files.plugin_manifests(spark, f"{at}/p.py").collect()] == [("title", "T"), ("version", "1.0")]
    assert files.csv_uploads(spark, f"{at}/a.csv").first().y == "2"
    assert files.env_lines(spark, f"{at}/a.csv", 1).count() == 3


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return bytearray(out.getvalue())


def as_files(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "path string, content binary")


def test_office(spark):
    sheet = "<w xmlns='m'><row r='2'><c r='A2'><v>5</v></c><c r='AA2'><v>7</v></c><c r='Z2'><v>9</v></c></row><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c><c r='AA1' t='s'><v>9</v></c></row><row r='3'><c r='A3'/></row></w>"
    shared = "<sst xmlns='m'><si><t>h</t></si><si><r><t>rich</t></r></si></sst>"
    book = as_files(spark, x=archive({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet10.xml": "<w/>", "xl/worksheets/sheet2.xml": sheet}))
    cells = {(r.row_num, r.col): r.value for r in office.cells(book).collect()}
    assert cells == {(1, "A"): "h", (1, "B"): "", (1, "AA"): "9", (2, "A"): "5", (2, "AA"): "7", (2, "Z"): "9"}
    assert [r.asDict() for r in office.first_sheet(book).collect()] == [{"row_num": 2, "A": "5", "B": "", "AA": "7"}]
    assert office.first_sheet(book, "first_row").columns == ["row_num", "h", "", "9"]
    docx = as_files(spark, d=archive({"word/document.xml": "<w:d xmlns:w='w'><w:t>wo</w:t><w:t>rd</w:t><w:t/></w:d>"}))
    assert office.docx_text(docx).first().text == "wo rd"
    slides = {f"ppt/slides/slide{k}.xml": f"<a xmlns='a'><t>{k}</t></a>" for k in (1, 2, 10)} | {"ppt/slides/slide3.xml": "<a/>"}
    pptx = as_files(spark, p=archive(slides))
    assert office.pptx_text(pptx).first().text == "Slide 1: 1\nSlide 10: 10\nSlide 2: 2"
    assert office.pptx_text(pptx, numeric=True).first().text == "Slide 1: 1\nSlide 2: 2\nSlide 10: 10"
    assert office.members(pptx, "ppt/", "3.xml").count() == 1
    with pytest.raises(PySparkException, match="document type"):
        office.docx_text(as_files(spark, d=archive({"word/document.xml": "<!DOCTYPE x><x/>"}))).collect()
    with pytest.raises(PySparkException, match="pymupdf"):
        office.pdf_text(as_files(spark, d=bytearray(b"%PDF"))).collect()


def test_chat(spark, sf, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "assistant", " "), (2, 0, "system", None)], "conv_id long, turn long, role string, text string")
    assert [r.text for r in chat.inlet(rows, F.upper).orderBy("conv_id", "turn").collect()] == ["HI", "yes", " ", None]
    assert chat.inlet(rows, F.upper, enabled=False) is rows and chat.outlet(rows).collect() == rows.collect()
    assert [tuple(r) for r in chat.last_assistant_message(rows).collect()] == [(1, 1, "yes")]
    assert chat.Pipe(answer=lambda t: iter(t)).run(rows).count() == 2
    assert chat.Pipe().pipes(spark).count() == 2
    out = f"file://{tmp_path}/out"
    chat.stream(spark, f"{sf}/conversations.parquet", lambda d: d.select("conv_id"), out, f"file://{tmp_path}/state")
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{sf}/conversations.parquet").count()


def test_plugins(spark):
    @dataclass(frozen=True)
    class Settings:
        suffix: str = "!"

    plugins = Plugins()
    plugins.register(Extension("filter", "mark", lambda d, c: d.withColumn("x", F.concat("x", F.lit(c.settings.suffix))), Settings()))
    df = spark.createDataFrame([("a",)], "x string")
    assert plugins.run("filter", "mark", df).first().x == "a!"
    assert plugins.run("filter", "mark", df, suffix="?").first().x == "a?"
    assert plugins.chain("filter", df).first().x == "a!" and plugins.names("filter") == ["mark"]
    with pytest.raises(ValueError, match="unknown settings"):
        plugins.run("filter", "mark", df, other=1)
    with pytest.raises(ValueError, match="kind"):
        plugins.register(Extension("other", "x", lambda d, c: d))


def test_said_is_message(spark):
    """The driver's twin answers as the column does."""
    tags = (None, "", " ", "de_DE", "FR", "zh-Hant-TW", "en-GB", "ja", "xx", "ZH_tw")
    asked = [(t, k) for t in tags for k in ("status_list_done", "err_not_found", "no_such_key", "status_done")]
    rows = spark.createDataFrame(asked, "tag string, key string").select("tag", "key", locale.message(F.col("tag"), F.col("key"), count=F.lit(3), active_count=F.lit("{name}")).alias("m")).collect()
    assert [r.m for r in rows] == [locale.said(r.tag, r.key, count=3, active_count="{name}") for r in rows]


def test_office_broken_files(spark):
    good = archive({"xl/worksheets/sheet1.xml": "<w><row><c r='A7' t='s'><v>x</v></c></row></w>"})
    files_ = as_files(spark, good=good, cut=good[:60], xml=archive({"xl/worksheets/sheet1.xml": "<w><row>"}), none=None)
    assert [tuple(r) for r in office.cells(files_, permissive=True).collect()] == [("good", 1, 7, "A", "x")]
    assert sorted(r.path for r in office.unreadable(files_, "xlsx_cells").collect()) == ["cut", "none", "xml"]
    with pytest.raises(PySparkException, match="BadZipFile|ParseError"):
        office.cells(files_).collect()


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_office_late_doctype(spark, encoding):
    late = f'<?xml version="1.0" encoding="{encoding}"?><!--{"x" * 200_000}--><!DOCTYPE d [<!ENTITY e "boom">]><d><t>&e;</t></d>'
    file = as_files(spark, d=archive({"word/document.xml": late.encode(encoding)}))
    assert office.docx_text(file, permissive=True).collect() == []
    assert "document type" in office.unreadable(file, "docx_texts").first().error


@pytest.mark.parametrize("size", [10, 4_080, 65_500, 200_000])
def test_office_long_tokens(spark, size):
    text_after = f'<d><t>a</t><!--{"x" * size}--><t b="{"y" * size}">b</t></d>'
    assert office.docx_text(as_files(spark, d=archive({"word/document.xml": text_after}))).first().text == "a b"


def test_pdf(spark, monkeypatch):
    """The function of pages with a stand-in for the package, and what is made from its rows."""

    class Page:
        def __init__(self, text):
            self.get_text = lambda: text

    @contextlib.contextmanager
    def opened(stream, filetype):
        if not stream.startswith(b"%PDF"):
            raise RuntimeError("no PDF")
        yield [Page(x) for x in stream.decode().split("|")[1:]]

    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=opened))
    read = office.PdfPages.func().eval
    assert list(read(b"%PDF|a|b")) == [(1, "a", None), (2, "b", None)] and list(read(b"%PDF")) == []
    assert list(read(b"")) == list(read(None)) == [(None, None, "RuntimeError: no PDF")]
    pages = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 1, "c")], "path string, page int, text string")
    monkeypatch.setattr(office, "_rows", lambda files, function, permissive: pages)
    assert {tuple(r) for r in office.pdf_text(pages).collect()} == {("p", "a\nb", 2), ("q", "c", 1)}
