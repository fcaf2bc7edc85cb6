"""Office documents, dates, policies and fill-in-the-middle on small fixtures."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textmill.functions import dates
from textmill.operators import fim, ordered, policy
from textmill.sources import office


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w"'
FILES = {
    "a.docx": zipped({"word/document.xml": f"<w:document {W}><w:p><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:p><w:p><w:t>Bye</w:t></w:p></w:document>"}),
    "b.xlsx": zipped({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<s><row><c t="s"><v>0</v></c><c><v>3</v></c></row></s>'}),
    "c.pptx": zipped({"ppt/slides/slide10.xml": "<s><p><t>ten</t></p></s>", "ppt/slides/slide2.xml": "<s><p><t>two</t></p></s>"}),
    "d.epub": zipped({"x.xhtml": "<p>one<br/>two</p>"}),
    "e.eml": b"Subject: x\nContent-Type: text/html\n\n<p>hi <b>there</b></p>",
    "f.docx": b"no zip",
    "g.zzz": zipped({"a": "b"}),
}


def test_office(spark):
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in FILES.items()], "path string, content binary")
    got = {}
    for r in office.read_office(df).collect():
        got.setdefault(r.path, []).append((r.page, r.text, r.problem is not None))
    assert got["a.docx"] == [("1", "Hello\tyou\nBye", False)]
    assert got["b.xlsx"] == [("1", "name\t3", False)]
    assert got["c.pptx"] == [("2", "two", False), ("10", "ten", False)]
    assert got["d.epub"] == [("x.xhtml", "one\ntwo", False)] and got["e.eml"] == [("body", "hi there", False)]
    assert got["f.docx"] == [(None, None, True)] and got["g.zzz"] == [(None, None, True)]


def test_dates(spark):
    cases = [("2024-02-29", datetime.date(2024, 2, 29), None), ("March 3rd, 2021", datetime.date(2021, 3, 3), None), ("13/02/2020", datetime.date(2020, 2, 13), None), ("02/13/2020", datetime.date(2020, 2, 13), None), ("03/02/2020", None, "ambiguous"), ("05/05/2020", datetime.date(2020, 5, 5), None), ("soon", None, "no date"), ("2023-02-30", None, "no date")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(dates.parse_date("x")).collect()]
    assert got == [c[1:] for c in cases]
    one = spark.range(1).select(*[dates.serial_date(F.lit(n)) for n in (1, 59, 60, 61, 44927)], dates.serial_date(F.lit(0), 1904)).first()
    assert list(one) == [datetime.date(1900, 1, 1), datetime.date(1900, 2, 28), None, datetime.date(1900, 3, 1), datetime.date(2023, 1, 1), datetime.date(1904, 1, 1)]
    n = spark.range(1).select(*[dates.parse_number(F.lit(x)) for x in ("1,234.5", "12,34", "-7")], dates.parse_number(F.lit("1.234,5"), "continental")).first()
    assert list(n) == [1234.5, None, -7.0, 1234.5]


def test_policy(spark):
    rows = spark.createDataFrame([(1, "task foo\nx"), (2, "see mbpp_12 and heldout3"), (3, "task bar"), (4, "clean")], "k long, text string")
    ids = spark.createDataFrame([(12,), (1,)], "id long")
    names = spark.createDataFrame([("bar",)], "name string")
    assert {r.k: r.reason for r in policy.gate(rows, "k", "text", ids, names).collect()} == {1: "id", 2: "alias", 3: "name", 4: None}
    assert spark.range(1).select(policy.aliases(F.lit("mbpp_12 Task-7 heldout3 xtask9 mbpp12"))).first()[0] == [7, 12, 1003]
    assert spark.range(1).select(policy.without_head(F.lit("Problem: a\nExample: b\ncode\nSpec: c"))).first()[0] == "code\nSpec: c"


def test_fim_loses_nothing(spark):
    df = spark.createDataFrame([(i, "abcdefghij"[: i % 11]) for i in range(60)], "doc_id long, text string")
    for r in fim.rows(df).join(df.withColumnRenamed("text", "plain"), "doc_id").collect():
        if r.layout == "plain":
            assert r.text == r.plain
            continue
        first, second = (fim.PREFIX, fim.SUFFIX) if r.layout == "psm" else (fim.SUFFIX, fim.PREFIX)
        a, rest = r.text.removeprefix(first).split(second)
        b, mid = rest.split(fim.MIDDLE)
        pre, suf = (a, b) if r.layout == "psm" else (b, a)
        assert pre + mid + suf == r.plain


@pytest.mark.parametrize("then", [None, ["k"]])
def test_sum_before(spark, then):
    data = [(k, float(k * 7 % 13), k % 3) for k in range(200)]
    df = spark.createDataFrame(data, "k int, o double, v int")
    for r in ordered.sum_before(df, "o", F.col("v"), then, "b").collect():
        assert r.b == sum(v for k, o, v in data if o < r.o or (then and o == r.o and k < r.k))
