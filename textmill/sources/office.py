"""Text of office documents (docx, xlsx, pptx, odt, epub, eml), from their zipped XML alone."""

from __future__ import annotations

import io
import re
import zipfile
from email import message_from_bytes, policy
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.python_text import html_text, python_udf
from ..session import ship_code

#: Unpacked bytes of a member beyond which a file is refused.
MEMBER_LIMIT = 256 << 20


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes, para: str, run: str) -> str:
    out = []
    for p in ET.fromstring(xml).iter():
        if _local(p.tag) == para:
            out.append("".join((e.text or "") if _local(e.tag) == run else "\t" if _local(e.tag) == "tab" else "\n" if _local(e.tag) == "br" else "" for e in p.iter()))
    return "\n".join(out)


def _cells(xml: bytes, shared: list[str]) -> str:
    rows = []
    for row in ET.fromstring(xml).iter():
        if _local(row.tag) != "row":
            continue
        cells = []
        for cell in row:
            value = next((e.text or "" for e in cell if _local(e.tag) == "v"), None)
            if cell.get("t") == "s" and value is not None:
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(e.text or "" for e in cell.iter() if _local(e.tag) == "t")
            cells.append(value or "")
        rows.append("\t".join(cells))
    return "\n".join(rows)


def _number(name: str) -> int:
    return int((re.findall(r"\d+", name) or ["0"])[-1])


def pages(name: str, content: bytes) -> list[dict]:
    """[{page, text}]: the parts of one document; raises ValueError for kinds it can't read."""
    content, kind = bytes(content), name.lower().rsplit(".", 1)[-1]
    if kind == "eml":
        mail = message_from_bytes(content, policy=policy.default)
        body = mail.get_body(preferencelist=("plain", "html"))
        text = body.get_content() if body else ""
        return [{"page": "body", "text": html_text(text) if body and body.get_content_subtype() == "html" else text}]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if any(i.file_size > MEMBER_LIMIT for i in z.infolist()):
            raise ValueError("too large unpacked")
        if kind == "docx":
            return [{"page": "1", "text": _paragraphs(z.read("word/document.xml"), "p", "t")}]
        if kind in ("odt", "odp"):
            return [{"page": "1", "text": "\n".join("".join(e.itertext()) for e in ET.fromstring(z.read("content.xml")).iter() if _local(e.tag) in ("p", "h"))}]
        if kind == "pptx":
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
            return [{"page": str(_number(n)), "text": _paragraphs(z.read(n), "p", "t")} for n in slides]
        if kind == "xlsx":
            shared = ["".join(t.text or "" for t in e.iter() if _local(t.tag) == "t") for e in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(e.tag) == "si"] if "xl/sharedStrings.xml" in names else []
            sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
            return [{"page": str(_number(n)), "text": _cells(z.read(n), shared)} for n in sheets]
        if kind == "epub":
            return [{"page": n, "text": html_text(z.read(n).decode("utf-8", "replace"))} for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]
    raise ValueError(f"unsupported: {kind}")


def _read(name: str, content: bytes) -> tuple[list[dict] | None, str | None]:
    try:
        return pages(name, content), None
    except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ET.ParseError) as e:
        return None, f"{type(e).__name__}: {e}"


def read_office(files: DataFrame) -> DataFrame:
    """path, page, text, problem of binaryFile rows: one row a page; unreadable files have one row with the problem."""
    ship_code(files.sparkSession)
    got = files.select("path", python_udf(_read, "pages array<struct<page string, text string>>, problem string")("path", "content").alias("r"))
    return got.select("path", F.explode_outer("r.pages").alias("p"), "r.problem").select("path", "p.page", "p.text", "problem")
