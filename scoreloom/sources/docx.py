"""Word documents by the standard library alone: lines with style, size, weight and zone, and the evidence that the document checks read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
APP = "{http://schemas.openxmlformats.org/officeDocument/2006/extended-properties}"
MOST_XML = 64 << 20  # bytes of one part; a larger one is an error, as it may be a bomb

LINE = T.StructType([T.StructField(n, t) for n, t in (("text", T.StringType()), ("zone", T.StringType()), ("size", T.DoubleType()), ("bold", T.BooleanType()), ("style", T.StringType()))])
EVIDENCE = T.StructType([
    T.StructField("lines", T.ArrayType(LINE)),
    *[T.StructField(n, T.IntegerType()) for n in ("docx_columns", "table_count", "textbox_words", "header_footer_words", "image_count", "stated_pages")],
    T.StructField("error", T.StringType()),
])


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    if z.getinfo(name).file_size > MOST_XML:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def _on(run: ElementTree.Element, name: str) -> bool:
    mark = run.find(f"{W}rPr/{W}{name}")
    return mark is not None and mark.get(f"{W}val", "true") not in ("0", "false", "off")


def _said(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            out.append(" ")
    return " ".join("".join(out).split())


def _paragraphs(node: ElementTree.Element, zone: str) -> Iterator[tuple[ElementTree.Element, str]]:
    """Paragraphs in reading order with their zone; a merged cell counts once, a text box is a zone of its own."""
    for x in node:
        if x.tag == f"{W}p":
            yield x, zone
        elif x.tag == f"{W}tbl":
            for row in x.iter(f"{W}tr"):
                for cell in row.findall(f"{W}tc"):
                    merged = cell.find(f"{W}tcPr/{W}vMerge")
                    if merged is None or merged.get(f"{W}val") == "restart":
                        yield from _paragraphs(cell, "table")
        elif x.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}body"):
            yield from _paragraphs(x, zone)


def read(content: bytes) -> dict:
    """The lines and evidence of one document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(z, "word/document.xml").find(f"{W}body")
        lines, boxes = [], 0
        for p, zone in _paragraphs(body, "body"):
            for box in p.iter(f"{W}txbxContent"):
                boxes += len(_said(box).split())
            inner = {x for box in p.iter(f"{W}txbxContent") for x in box.iter(f"{W}r")}
            runs = [r for r in p.iter(f"{W}r") if r not in inner and _said(r) and r.find(f".//{W}txbxContent") is None]
            text = " ".join("".join((x.text or "") if x.tag == f"{W}t" else " " for r in runs for x in r.iter() if x.tag in (f"{W}t", f"{W}tab", f"{W}br")).split())
            if not text:
                continue
            sizes = [float(s.get(f"{W}val")) / 2 for r in runs if (s := r.find(f"{W}rPr/{W}sz")) is not None and s.get(f"{W}val", "").isdigit()]
            style = p.find(f"{W}pPr/{W}pStyle")
            lines.append({"text": text, "zone": zone, "size": max(sizes, default=None), "bold": all(_on(r, "b") for r in runs), "style": "" if style is None else style.get(f"{W}val", "")})
        columns = [int(c.get(f"{W}num", "1")) for c in body.iter(f"{W}cols") if c.get(f"{W}num", "1").isdigit()]
        edges = [n for n in z.namelist() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml")]
        app = _xml(z, "docProps/app.xml")
        pages = None if app is None else app.findtext(f"{APP}Pages")
        return {
            "lines": lines, "docx_columns": max(columns, default=1), "table_count": sum(1 for _ in body.iter(f"{W}tbl")), "textbox_words": boxes,
            "header_footer_words": sum(len(_said(_xml(z, n)).split()) for n in edges), "image_count": sum(n.startswith("word/media/") for n in z.namelist()),
            "stated_pages": int(pages) if pages and pages.isdigit() and len(pages) < 7 else None, "error": None,
        }


def text_of(content: bytes) -> str:
    return "\n".join(x["text"] for x in read(content)["lines"])


# The parts of a package with one document of plain paragraphs, as parsers read them best.
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": f'<w:styles xmlns:w="{W[1:-1]}"><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style>'
    '<w:style w:type="paragraph" w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>',
}
POINTS = {"name": 18, "contact": 9, "heading": 12, "body": 10.5}


def rendered(name: str, contact: str, sections: list[dict]) -> bytes:
    """A document of plain paragraphs: name, contact line, then sections (heading, blocks of text and bullets). The same input gives the same bytes."""

    def paragraph(text: str, size: float, bold: bool = False, style: str = "") -> str:
        clean = "".join(c for c in text if c in "\t\n\r" or (c >= " " and not 0xD800 <= ord(c) <= 0xDFFF and c not in "\ufffe\uffff"))
        marks = f'<w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{round(size * 2)}"/></w:rPr>'
        own = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{own}<w:r>{marks}<w:t xml:space="preserve">{escape(clean)}</w:t></w:r></w:p>'

    out = [paragraph(name, POINTS["name"], True)] + ([paragraph(contact, POINTS["contact"])] if contact else [])
    for s in sections:
        out.append(paragraph(s["heading"], POINTS["heading"], True, "Heading1"))
        for b in s["blocks"]:
            if b["text"]:
                out.append(paragraph(b["text"], POINTS["body"], bool(b["bullets"])))
            out += [paragraph(x, POINTS["body"], False, "ListBullet") for x in b["bullets"] or ()]
    parts = PARTS | {"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(out)}</w:body></w:document>'}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path, xml in parts.items():
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml)
    return buffer.getvalue()


def of_layouts(rows: DataFrame) -> DataFrame:
    """(name, content) of rows (name, title, contact, sections): a file per row, for ``sinks.write_files`` with the layout ``files``."""
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                made = [rendered(r["title"] or "", r["contact"] or "", r["sections"] or []) for r in b.select(["title", "contact", "sections"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(made, pa.binary())], names=["name", "content"])

    return rows.select("name", "title", "contact", "sections").mapInArrow(run, "name string, content binary")


def documents(files: DataFrame) -> DataFrame:
    """``files`` (path, content, ...) of this format: adds docx (lines, evidence, error); a file that can't be read has an error instead."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    keep = files.drop("docx")
    schema = T.StructType([*keep.schema.fields, T.StructField("docx", EVIDENCE)])
    arrow = to_arrow_type(EVIDENCE)

    def one(content: bytes | None) -> dict:
        try:
            return read(content or b"")
        except Exception as e:  # noqa: BLE001  a broken file is a row, not a failure
            return {"error": f"unreadable: {type(e).__name__}"}

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 50):
                b = whole.slice(at, 50)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(x.as_py()) for x in b.column("content")], arrow)], names=schema.names)

    return keep.mapInArrow(run, schema)
