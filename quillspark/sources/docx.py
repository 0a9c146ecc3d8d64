"""Word documents: paragraphs with heading levels, and table rows with merged cells filled, in order of the body."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillspark.sources import registry

# Fixed value: the namespace of word processing markup.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, kind (heading, text, row or error), level and text of every block of the documents under a path."""
    return blocks(spark.read.format("binaryFile").load(path), "path", "content")


def blocks(files: DataFrame, key: str, content: str) -> DataFrame:
    """The blocks of documents held as bytes. A file that can't be read is one row that says so; others go on."""
    kind = files.schema[key].dataType.simpleString()
    name = key

    def text_of(node) -> str:
        parts = []
        for x in node.iter():
            if x.tag == f"{W}t":
                parts.append(x.text or "")
            elif x.tag in (f"{W}tab", f"{W}br"):
                parts.append(" ")
        return "".join(parts).strip()

    def table_rows(table) -> Iterator[list[str]]:
        above: dict[int, str] = {}
        for row in table.findall(f"{W}tr"):
            cells: list[str] = []
            for cell in row.findall(f"{W}tc"):
                props = cell.find(f"{W}tcPr")
                span, merge = None, None
                if props is not None:
                    span, merge = props.find(f"{W}gridSpan"), props.find(f"{W}vMerge")
                wide = int(span.get(f"{W}val", "1")) if span is not None else 1
                value = " ".join(t for t in map(text_of, cell.findall(f"{W}p")) if t)
                if merge is not None and merge.get(f"{W}val") != "restart":
                    value = above.get(len(cells), "")
                for _ in range(wide):
                    above[len(cells)] = value
                    cells.append(value)
            yield cells

    def parse(raw: bytes) -> Iterator[tuple[str, int, str]]:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{W}body")
        for node in body:
            if node.tag == f"{W}p":
                style = node.find(f"{W}pPr/{W}pStyle")
                found = re.fullmatch(r"(?i)heading\s*([1-9])", style.get(f"{W}val", "")) if style is not None else None
                text = text_of(node)
                if text:
                    yield ("heading", int(found[1]), text) if found else ("text", 0, text)
            elif node.tag == f"{W}tbl":
                for cells in table_rows(node):
                    yield "row", 0, " | ".join(cells)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, raw in zip(frame[name], frame[content], strict=True):
                try:
                    found = list(parse(bytes(raw)))
                except Exception as error:  # noqa: BLE001
                    found = [("error", 0, type(error).__name__)]
                yield pd.DataFrame([(k, i, *x) for i, x in enumerate(found)], columns=[name, "pos", "kind", "level", "text"])

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, pos int, kind string, level int, text string")


registry.register_reader("docx", read)
