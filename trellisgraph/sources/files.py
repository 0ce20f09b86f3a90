"""Readers: CSV, JSON, JDBC, and files of other formats through ``binaryFile`` and a parser in a pandas UDF."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; ``_file`` says where a row is from, unreadable files are skipped. Without a schema all text."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True)
    r = r.schema(schema) if schema else r
    return r.csv(paths).withColumn("_file", F.col("_metadata.file_path"))


def read_json(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """A file with one object or an array of them."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(paths)


def read_sql(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_table(spark: SparkSession, url: str, table: str, limit: int | None = None, **options) -> DataFrame:
    """A whole table; with partitionColumn, bounds and numPartitions among the options it is read in parallel."""
    if not all(IDENTIFIER.fullmatch(part) for part in table.split(".")):
        raise ValueError(f"not a table name: {table!r}")
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.limit(limit) if limit is not None else df


def tables(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, suffix, content) of all files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"[^/\\]+$", 0)
    return df.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)).alias("suffix"), "content")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, else GB18030, else GBK, else Latin-1."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for code in ("utf-8", "gb18030", "gbk"):
            try:
                return raw.decode(code)
            except UnicodeDecodeError:
                pass
        return raw.decode("latin-1")

    return content.map(one)


@F.pandas_udf(T.StringType())
def lenient(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8, without what is not."""
    return content.map(lambda raw: None if raw is None else raw.decode("utf-8", "ignore"))


@F.pandas_udf(T.StringType())
def wide_text(content: pd.Series) -> pd.Series:
    """Bytes as UTF-16, without what is not."""
    return content.map(lambda raw: None if raw is None else raw.decode("utf-16-le", "ignore"))


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Headers, paragraphs, tables as ``a | b`` and footers of a Word file."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        order = [n for n in names if re.fullmatch(r"word/header\d*\.xml", n)] + ["word/document.xml"] + [n for n in names if re.fullmatch(r"word/footer\d*\.xml", n)]
        out: list[str] = []
        say = lambda p: "".join(t.text or "" for t in p.iter(f"{_WORD}t"))
        for n in order:
            if n not in names:
                continue
            root = ElementTree.fromstring(z.read(n))
            for part in [*root] if n != "word/document.xml" else [*(root.find(f"{_WORD}body") or [])]:
                if part.tag == f"{_WORD}p":
                    out.append(say(part))
                elif part.tag == f"{_WORD}tbl":
                    out += [" | ".join(" ".join(say(p) for p in c.iter(f"{_WORD}p")) for c in r.iter(f"{_WORD}tc")) for r in part.iter(f"{_WORD}tr")]
        return "\n".join(x for x in out if x.strip())


def table_text(rows: Column) -> Column:
    """An array of rows, each an array of cells, as lines with bars."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(F.trim(c), F.lit(""))), " | ")), "\n")


class _Page(HTMLParser):
    """Text of main or article, else of the body, without parts that hold no content."""

    skip = {"script", "style", "nav", "header", "footer", "aside", "noscript"}
    blocks = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.main, self.all, self.best = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip
        self.main += tag in ("main", "article")
        if tag in self.blocks:
            self.handle_data("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.skip and self.depth > 0
        if tag in self.blocks:
            self.handle_data("\n")
        self.main -= tag in ("main", "article") and self.main > 0

    def handle_data(self, data):
        if not self.depth:
            self.all.append(data)
            if self.main:
                self.best.append(data)


def page_text(html: str | None) -> str:
    if not html:
        return ""
    p = _Page()
    p.feed(html)
    p.close()
    text = "".join(p.best) if "".join(p.best).strip() else "".join(p.all)
    return "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in text.split("\n")) if x)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Readable text of web pages; a page that cannot be parsed gives an empty text."""

    def one(h):
        try:
            return page_text(h)
        except Exception:  # noqa: BLE001  one bad page must not end the job
            return ""

    return html.map(one)


def url_problem(url: Column) -> Column:
    """Null for a URL that may be fetched, else why not: scheme, credentials, blocked host or non-public address."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    octet = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]
    a, b = octet[0], octet[1]
    private = (a == 10) | (a == 127) | (a == 0) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    v6 = host.rlike(r"^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*)\]?$")
    return (
        F.when(~F.lower(F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit(""))).isin("http", "https"), "scheme")
        .when(F.try_parse_url(url, F.lit("USERINFO")).isNotNull(), "credentials")
        .when((host == "") | (host == "localhost") | host.endswith(".localhost") | host.endswith(".local") | host.endswith(".internal") | (host == "metadata"), "host")
        .when(F.coalesce(private, F.lit(False)) | v6, "address")
    )


def _docx(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: None if raw is None else docx_text(raw))


def routed(files: DataFrame) -> DataFrame:
    """``files`` with ``text`` by suffix; office formats that need a converter get ``error``."""
    docx = F.pandas_udf(_docx, T.StringType())
    kind = F.col("suffix")
    text = F.when(kind.isin(".txt", ".md", ".csv", ".json", ".step", ".stp", ".iges", ".igs", ".dxf"), decoded("content")).when(kind == ".docx", docx(F.when(kind == ".docx", F.col("content")))).when(kind.isin(".html", ".htm"), html_text(decoded("content"))).when(~kind.isin(".doc", ".xls", ".ppt", ".pptx", ".xlsx", ".pdf", ".dwg"), lenient("content"))
    return files.withColumn("text", text).withColumn("error", F.when(kind.isin(".doc", ".xls", ".ppt", ".pptx", ".xlsx"), F.concat(F.lit("unsupported: "), kind)))
