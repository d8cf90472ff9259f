"""Folders of bid files as tables: file scan, HTML sections, PDF pages.

One row per file comes from Spark's binaryFile source; parsing runs on the executors in Arrow batches, a file at a time.
A file that cannot be parsed yields one row with `error` and no text, so that nothing is lost silently.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no content of the document, and elements without an end tag.
DROPPED = frozenset("script style nav footer header aside meta link noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LABEL_TAGS = frozenset("strong b th label".split())
MAIN = "Main Content"
_MORE = re.compile(r"See more(\s+description)?", re.I)

#: What a parser yields of a section: name, page, text, truncated, printed label, tables.
Section = tuple[str, int | None, str, bool, str | None, list | None]
_KINDS = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.list_(pa.list_(pa.string()))), pa.string())

SECTION = T.StructType(
    [
        T.StructField("bid_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("section_seq", T.IntegerType()),
        T.StructField("section_identifier", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("truncated", T.BooleanType()),
        T.StructField("printed_label", T.StringType()),
        T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
        T.StructField("error", T.StringType()),
    ]
)


def _exists(spark: SparkSession, folder: str) -> bool:
    """Whether anything is there, by the file system of the path; patterns with wildcards are Spark's to expand."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return found is not None and len(found) > 0


def scan(spark: SparkSession, *folders: str) -> DataFrame:
    """bid_id (the folder's name), filename, doc_id (content hash), kind (pdf or html), content of the files of bid folders.

    Only files right in a folder count; other kinds than .pdf, .html and .htm, in any case of letters, are left out. A
    folder that is not there has no files; it is warned of, as it may be a slip.
    """
    there = [f for f in folders if _exists(spark, f)]
    if absent := sorted(set(folders) - set(there)):
        warnings.warn(f"no such folders: {absent}", stacklevel=2)
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    raw = source.load(there) if there else spark.createDataFrame([], "path string, content binary")
    parts = F.split("path", "/")
    kind = F.when(F.lower("path").endswith(".pdf"), "pdf").when(F.lower("path").rlike(r"\.html?$"), "html")
    return raw.select(
        F.element_at(parts, -2).alias("bid_id"),
        F.element_at(parts, -1).alias("filename"),
        F.substring(F.sha1("content"), 1, 12).alias("doc_id"),
        kind.alias("kind"),
        "content",
    ).where("kind IS NOT NULL")


@dataclass
class _Node:
    tag: str
    dropped: bool = False
    has_body: bool = False


@dataclass
class _Texts(HTMLParser):
    """Text nodes outside dropped elements, each with its parent's tag and whether it is in the body."""

    found: list[tuple[str, str, bool]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.body = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        inside = bool(self.open) and self.open[-1].dropped
        self.body |= tag == "body" and not inside
        if tag not in VOID:
            in_body = tag == "body" or (bool(self.open) and self.open[-1].has_body)
            self.open.append(_Node(tag, inside or tag in DROPPED, in_body))

    def handle_endtag(self, tag: str) -> None:
        # Closes the nearest element of that name and all within it; an end tag without a begin is ignored.
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1] if self.open else _Node("")
        if not top.dropped and (text := data.strip()):
            self.found.append((text, top.tag, top.has_body))


def html_sections(markup: str) -> list[tuple[str, str, bool]]:
    """(section name, text, whether it held a "See more" mark) of a page, cut at its labels.

    A text that ends with a colon and stands in strong, b, th or label, or is shorter than 50 characters, begins a
    section of that name; the label stays the first words of its section. A page without a body is one section.
    """
    parser = _Texts()
    parser.feed(markup)
    parser.close()
    sections: list[tuple[str, list[str]]] = [(MAIN, [])]
    if parser.body:
        for text, tag, in_body in parser.found:
            if not in_body:
                continue
            if text.endswith(":") and (tag in LABEL_TAGS or len(text) < 50):
                sections.append((text.rstrip(":"), []))
            sections[-1][1].append(text)
    else:
        sections[0][1].extend(text for text, _, _ in parser.found)
    out = []
    for name, texts in sections:
        joined = " ".join(texts).strip()
        cut = _MORE.sub("", joined).strip()
        if cut:
            out.append((name, cut, cut != joined))
    return out


@dataclass
class PdfPage:
    """A page as a reader gives it: its text, the label printed on it, and its tables (rows of cells)."""

    text: str
    label: str | None = None
    tables: list[list[list[str | None]]] = field(default_factory=list)


def _rows(df: DataFrame, parse: Callable[[bytes], list[Section]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, name, doc, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    rows = [(bid, doc, name, k, *section, None) for k, section in enumerate(parse(content), 1)]
                except Exception as e:  # noqa: BLE001: a broken file must not end the job
                    rows = [(bid, doc, name, *[None] * 7, f"{type(e).__name__}: {e}"[:500])]
                if rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, SECTION.names)

    return df.select("bid_id", "filename", "doc_id", "content").mapInArrow(run, SECTION)


def parse_html(files: DataFrame) -> DataFrame:
    """The sections of the html files of `scan`; bytes that are no UTF-8 make an error row."""

    def sections(content: bytes) -> list[Section]:
        return [(name, None, text, more, None, None) for name, text, more in html_sections(content.decode("utf-8"))]

    return _rows(files.where("kind = 'html'"), sections)


def mupdf_pages(content: bytes) -> list[PdfPage]:
    """The text blocks, the printed label and the tables of every page, with the optional MuPDF binding."""
    import fitz  # not installed everywhere; any reader of the same form can be given instead

    out = []
    with fitz.open(stream=content, filetype="pdf") as document:
        for page in document:
            blocks = [b[4].strip() for b in page.get_text("blocks") if b[6] == 0]
            out.append(PdfPage("\n\n".join(blocks), printed_label(blocks), [t.extract() for t in page.find_tables()]))
    return out


_PRINTED = re.compile(r"(?:page\s+)?\d+\s+(?:of|\|)\s+\d+", re.I)


def printed_label(blocks: list[str]) -> str | None:
    """The first line like `Page 3 of 12` or `3 | 12` in the first or last three blocks of a page."""
    edges = blocks[:3] + blocks[max(3, len(blocks) - 3) :]
    lines = (line.strip() for block in edges for line in block.split("\n"))
    return next((line for line in lines if _PRINTED.fullmatch(line)), None)


def parse_pdf(files: DataFrame, reader: Callable[[bytes], list[str | PdfPage]] = mupdf_pages) -> DataFrame:
    """A section for every page of the pdf files of `scan`, named "Page n".

    reader: bytes to the pages, each a text or a PdfPage. Missing cells of tables become empty ones.
    """

    def sections(content: bytes) -> list[Section]:
        out: list[Section] = []
        for n, page in enumerate(reader(content), 1):
            page = PdfPage(page) if isinstance(page, str) else page
            tables = [[["" if cell is None else cell for cell in row] for row in table] for table in page.tables]
            out.append((f"Page {n}", n, page.text, False, page.label, tables))
        return out

    return _rows(files.where("kind = 'pdf'"), sections)


def parse(files: DataFrame, reader: Callable[[bytes], list[str | PdfPage]] = mupdf_pages) -> DataFrame:
    """The sections of all files."""
    return parse_html(files).unionByName(parse_pdf(files, reader))


def low_text_pages(sections: DataFrame, least: int = 10) -> DataFrame:
    """filename and low_pages: pages with fewer than `least` words."""
    words = F.size(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: w != ""))
    low = sections.where(F.col("page_number").isNotNull() & (words < least))
    return low.groupBy("bid_id", "filename").agg(F.array_sort(F.collect_set("page_number")).alias("low_pages"))


def parsed_documents(sections: DataFrame) -> DataFrame:
    """bid_id, stem (file name without extension) and document: JSON of metadata and sections in order, for every file.

    A file that could not be parsed has no document. What `sinks.write_by_bid` takes, with the stem as its name and
    `_parsed.json` as its suffix.
    """
    body = F.struct("section_seq", "section_identifier", "page_number", "text", "printed_label", "tables")
    whole = sections.where("error IS NULL").groupBy("bid_id", "filename", "doc_id").agg(
        F.array_sort(F.collect_list(body)).alias("sections"), F.count("*").alias("section_count"), F.bool_or("truncated").alias("truncated_description")
    )
    metadata = F.struct("doc_id", F.col("filename").alias("source_filename"), "section_count", "truncated_description")
    text = F.to_json(F.struct(metadata.alias("metadata"), "sections"), {"ignoreNullFields": "false"})
    return whole.select("bid_id", F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem"), text.alias("document"))


def write_json(records: DataFrame, folder: str, partition: str = "bid_id") -> None:
    """Records as JSON lines, one folder per bid (or per file, with partition="filename"); null fields are written."""
    columns = [c for c in records.columns if c != partition]
    lines = records.select(partition, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").partitionBy(partition).text(folder)
