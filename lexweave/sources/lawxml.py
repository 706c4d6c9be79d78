"""Consolidated law XML to flat block rows.

The reader only flattens: one row for each ``bloque`` with its last version and
its direct paragraphs. What the blocks mean is decided by DataFrame operators
(``lexweave.operators.structure``).
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCKS = "doc_id string, pos int, block_id string, tipo string, titulo string, version struct<id_norma:string,fecha_vigencia:string>, paras array<struct<class:string,text:string>>, error string"
_PARA = pa.list_(pa.struct([("class", pa.string()), ("text", pa.string())]))
_SCHEMA = pa.schema([("doc_id", pa.string()), ("pos", pa.int32()), ("block_id", pa.string()), ("tipo", pa.string()), ("titulo", pa.string()), ("version", pa.struct([("id_norma", pa.string()), ("fecha_vigencia", pa.string())])), ("paras", _PARA), ("error", pa.string())])


def problem(xml: str) -> str | None:
    """Why a document isn't read: empty, a DTD or entities in its prologue, malformed, or without a text."""
    if not xml.strip():
        return "empty document"
    head = min((at for at in (xml.find("<bloque"), xml.find("<response")) if at >= 0), default=len(xml))
    prologue = xml[:head].lower()
    if "<!doctype" in prologue or "<!entity" in prologue:
        return "DTD or entities"
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return f"malformed: {e}"
    return None if root.find(".//texto") is not None else "no text element"


def blocks(doc_id: str, xml: str) -> Iterator[dict]:
    """The rows of one document; a document that can't be read gives one row with ``error``."""
    if why := problem(xml):
        yield {"doc_id": doc_id, "pos": None, "block_id": None, "tipo": None, "titulo": None, "version": None, "paras": None, "error": why}
        return
    for pos, b in enumerate(ElementTree.fromstring(xml).find(".//texto").iter("bloque")):
        versions = b.findall("version")
        last = versions[-1] if versions else None
        yield {
            "doc_id": doc_id,
            "pos": pos,
            "block_id": b.get("id"),
            "tipo": b.get("tipo") or "",
            "titulo": (b.get("titulo") or "").strip(),
            "version": None if last is None else {"id_norma": last.get("id_norma") or "", "fecha_vigencia": last.get("fecha_vigencia") or None},
            "paras": None if last is None else [{"class": p.get("class") or "", "text": "".join(p.itertext()).strip()} for p in last.findall("p")],
            "error": None,
        }


def blocks_of(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", mode: str = "PERMISSIVE") -> DataFrame:
    """Block rows of a column of documents. PERMISSIVE keeps error rows, DROPMALFORMED leaves them out, FAILFAST raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, xml in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = list(blocks(i, xml or ""))
                if mode == "FAILFAST" and rows and rows[0]["error"]:
                    raise ValueError(f"{i}: {rows[0]['error']}")
                yield from pa.Table.from_pylist(rows, schema=_SCHEMA).to_batches()

    out = docs.selectExpr(f"cast({id_col} as string) as doc_id", f"cast({xml_col} as string) as xml").mapInArrow(run, BLOCKS)
    return out.where("error is null") if mode == "DROPMALFORMED" else out


def read_law_xml(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Block rows of all files under ``path``; a document's id is its path. Any store that Spark reads will do."""
    files = spark.read.format("binaryFile").load(path).selectExpr("path as doc_id", "decode(content, 'UTF-8') as xml")
    return blocks_of(files, mode=mode)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class LawXmlReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[_File]:
        import glob

        return [_File(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open(partition.path, encoding="utf-8") as f:
            yield from pa.Table.from_pylist(list(blocks(partition.path, f.read())), schema=_SCHEMA).to_batches()


class LawXmlSource(DataSource):
    """``spark.dataSource.register(LawXmlSource)``, then ``spark.read.format("law_xml").load(glob)`` for files that every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "law_xml"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> LawXmlReader:
        return LawXmlReader(self.options)
