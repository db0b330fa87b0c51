"""Documents, manifests, vector stores and labelled cases from files."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import cut

SUPPORTED = ("txt", "docx", "pdf")

MANIFEST = "id string, stockCode string, stockName string, content string, category string, source string, tags string, createdAt string"
VECTORS = "entries array<struct<id: string, embedding: struct<vector: array<float>>, embedded: struct<text: string, metadata: struct<metadata: map<string, string>>>>>"
CASES = "id string, question string, knowledgeContext string, toolObservations array<string>, answer string, expected string, category string"
CSV_COLUMNS = ("stock_code", "stock_name", "category", "content", "tags", "source")


def docx_text(raw: bytes) -> str:
    """Paragraphs and breaks as lines, tabs as tabs, all other tags out, entities resolved."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("no word/document.xml in this docx file")
        xml = z.read("word/document.xml").decode("utf-8")
    xml = re.sub(r"</w:p>|<w:br\s*/>", "\n", xml)
    xml = re.sub(r"<w:tab\s*/>", "\t", xml)
    return html.unescape(re.sub(r"<[^>]+>", "", xml))


def in_reading_order(pieces: list[tuple[float, float, str]]) -> str:
    """Text of pieces (x, y, text), y growing upwards: from the top line down, each from the left.

    Pieces less than half a unit apart in height stand in one line."""
    lines: dict[int, list[tuple[float, str]]] = {}
    for x, y, text in pieces:
        if text.strip():
            lines.setdefault(round(-2 * y), []).append((x, text.strip("\n")))
    return "\n".join("".join(t for _, t in sorted(lines[k], key=lambda p: p[0])) for k in sorted(lines))


def pdf_text(raw: bytes) -> str:
    """By whichever public PDF reader is installed; pieces of a page sorted by their position."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise NotImplementedError("PDF files need the pypdf package") from e
    pages = []
    for page in PdfReader(io.BytesIO(raw)).pages:
        pieces: list[tuple[float, float, str]] = []
        page.extract_text(visitor_text=lambda text, cm, tm, *_: pieces.append((tm[4], tm[5], text)))
        pages.append(in_reading_order(pieces))
    return "\n".join(pages)


def document_text(path: str, raw: bytes) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "txt":
        return raw.decode("utf-8")
    if kind == "docx":
        return docx_text(raw)
    if kind == "pdf":
        return pdf_text(raw)
    raise ValueError(f"unsupported document format: {path}")


@F.pandas_udf(T.StringType())
def _texts(paths: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else document_text(p, r) for p, r in zip(paths, raw)], dtype=object)


def texts(path: str, raw: str) -> Column:
    """Texts of files: of txt by Spark, which fails on what is not UTF-8, so that no worker holds a whole
    file several times; of docx, pdf and any other format by document_text."""
    plain = F.lower(F.element_at(F.split(path, "\\."), -1)) == "txt"
    return F.when(plain, F.decode(raw, "UTF-8")).otherwise(_texts(F.col(path), F.when(~plain, F.col(raw))))


#: Names of txt files, and of those that a library reads as a whole.
PLAIN, PACKED = "{*.,}[tT][xX][tT]", "{*.,}{[dD][oO][cC][xX],[pP][dD][fF]}"
_BOM = "\ufeff"
#: Files with such a mark up to which every task gets their names.
MARKED = 100_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, part, k, line of txt files below path, lines as their LF cut them; part and k order those of a
    file. What is not UTF-8 is an error.

    Files are read in as many parts as their size asks for, so that no task holds one. Spark drops a mark of
    the byte order from a file's start; where a file has three bytes more than its lines, it is put back (a file of nothing else has no lines).
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", PLAIN).option("lineSep", "\n").text(path)
    where = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    raw = read.select(where.alias("path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("k"), F.col("value").cast("binary").alias("_raw"))
    first = F.min(F.when(F.col("part") == 0, F.col("k"))).alias("_k")
    sizes = raw.groupBy("path").agg(F.max("_size").alias("_size"), F.sum(F.octet_length("_raw") + F.lit(1)).alias("_read"), first)
    marked = cut(sizes.where(F.col("_size") - F.col("_read") >= 2).select(F.col("path").alias("_path"), "_k"))
    line = F.decode("_raw", "UTF-8")
    near = F.broadcast if marked.count() <= MARKED else lambda d: d  # so that no line is shuffled for them
    rows = raw.join(near(marked), (F.col("path") == F.col("_path")) & (F.col("k") == F.col("_k")), "left")
    return rows.select("path", "part", "k", F.when(F.col("_k").isNull(), line).otherwise(F.concat(F.lit(_BOM), line)).alias("line"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, text of txt, docx and pdf files; any other format is an error when read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), texts("path", "content").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge entries of a JSON array; what cannot be read gives no rows."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="DROPMALFORMED")
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return rows.select("id", blank("stockCode").alias("stock_code"), blank("stockName").alias("stock_name"), blank("content").alias("content"), F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("general")).alias("category"), blank("source").alias("source"), blank("tags").alias("tags"), F.try_to_timestamp("createdAt").alias("created_at"))


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, vector, content, metadata of a stored-embeddings file; a corrupt one gives no rows."""
    rows = spark.read.schema(VECTORS).json(path, multiLine=True, mode="DROPMALFORMED")
    e = rows.select(F.explode("entries").alias("e"))
    return e.select(F.col("e.id").alias("chunk_id"), F.col("e.embedding.vector").alias("vector"), F.col("e.embedded.text").alias("content"), F.col("e.embedded.metadata.metadata").alias("metadata"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases from JSON lines; a bad line is an error."""
    return spark.read.schema(CASES).json(path, mode="FAILFAST")


def split_csv(line: str) -> list[str]:
    """Fields of one line; quotes may hold commas, and doubled quotes stand for one."""
    fields, held, quoted, k = [], [], False, 0
    while k < len(line):
        c = line[k]
        if c == '"':
            if quoted and line[k + 1 : k + 2] == '"':
                held.append(c)
                k += 1
            else:
                quoted = not quoted
        elif c == "," and not quoted:
            fields.append("".join(held))
            held = []
        else:
            held.append(c)
        k += 1
    return [*fields, "".join(held)]


def csv_rows(lines: DataFrame) -> DataFrame:
    """lines(line_no, line) without the header → line_no, status and fields; nothing is fatal.

    status: skipped (blank or # lines), short (fewer than 4 fields), missing (no code or content), ok.
    """

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [f.strip() for f in split_csv(x or "")])

    line = F.regexp_replace(F.coalesce("line", F.lit("")), "^\\uFEFF", "")
    kept = [c for c in lines.columns if c == "file"]
    rows = lines.select(*kept, "line_no", line.alias("line")).withColumn("_f", cut("line"))
    part = lambda k, other: F.coalesce(F.get("_f", F.lit(k)), F.lit(other))
    fields = [part(k, "general" if n == "category" else "").alias(n) for k, n in enumerate(CSV_COLUMNS)]
    blank = (F.trim("line") == "") | F.trim("line").startswith("#")
    out = rows.select(*kept, "line_no", "line", F.size("_f").alias("_n"), *fields)
    status = F.when(blank, "skipped").when(F.col("_n") < 4, "short").when((F.col("stock_code") == "") | (F.col("content") == ""), "missing").otherwise("ok")
    return out.select(*kept, "line_no", status.alias("status"), *CSV_COLUMNS)


def csv_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "ok").alias("imported"), F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("status") != "ok").alias("skipped"), F.count_if(F.col("status").isin("short", "missing")).alias("errors"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """csv_rows of files, and file; every line is a record, and the first line of each file is its header.

    Files are read by lines, in as many parts as their size asks for. A line's number is its
    place among those of its file, by where its part and it begin.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("k"))
    sizes = rows.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("least"))
    ahead = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "part", "least", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    lines = rows.join(starts, ["file", "part"]).select("file", (F.col("ahead") + F.col("k") - F.col("least") + 1).alias("line_no"), F.col("value").alias("line"))
    return csv_rows(lines.where("line_no > 1"))
