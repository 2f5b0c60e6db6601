"""Files as DataFrames: snapshots, texts, query sets, side-cars, delimited tables, archives and HTML."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this size a file's hash is its time of change.
LARGE = 50 * 1024 * 1024
#: Limits of archives: members, unpacked bytes, archives within archives.
MEMBERS, UNPACKED, DEPTH = 10_000, 512 * 1024 * 1024, 3
ENCODINGS = ("utf-8-sig", "gbk", "latin-1")


def _files(spark: SparkSession, root: str, suffixes: Sequence[str] = ()) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.length(F.lit(root.rstrip("/"))) + F.locate(root.rstrip("/"), F.col("path"))
    out = df.select(F.expr("path").alias("uri"), F.substring("path", at + 1, F.length("path")).alias("path"), "modificationTime", "length", "content")
    if suffixes:
        out = out.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin([s.lower() for s in suffixes]))
    return out


def snapshot(spark: SparkSession, root: str, suffixes: Sequence[str] = (), large: int = LARGE) -> DataFrame:
    """Rows (path, size, mtime, hash): SHA-256 of the content, or 'mtime:...' above ``large`` bytes, which aren't read."""
    df = _files(spark, root, suffixes)
    small = df.where(F.col("length") <= large).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))
    big = df.where(F.col("length") > large).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.concat(F.lit("mtime:"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss")).alias("hash"))
    return small.unionByName(big)


def decode(raw: bytes | None) -> str | None:
    """Text of bytes in the first encoding that fits."""
    if raw is None:
        return None
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def read_texts(spark: SparkSession, root: str, suffixes: Sequence[str] = (".md", ".txt"), largest: int | None = None) -> DataFrame:
    """Rows (path, text) of text files, however large; a .txt file gets its stem as a heading. With ``largest``, files of more bytes have a null text."""
    fix = F.pandas_udf(lambda s: s.map(decode), "string")
    content = F.col("content") if largest is None else F.when(F.col("length") <= largest, F.col("content"))
    df = _files(spark, root, suffixes).select("path", fix(content).alias("text"))
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return df.select("path", F.when(F.lower("path").endswith(".txt"), F.concat(F.lit("# "), stem, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")).alias("text"))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """Rows (line_no, query, expected_files, category) of a JSON-lines file; blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    return lines.select("line_no", F.from_json("value", "query string, expected_files array<string>, category string").alias("q")).select("line_no", "q.*").where("query is not null")


def read_cases(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """Rows of the ``cases`` array of JSON files, kept where the named fields have the given values."""
    cases = spark.read.json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    for name, value in equal.items():
        cases = cases.where(F.col(name) == value)
    return cases


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Rows (id, path, title, tags) of the .md.json files beside texts."""
    fields = "id string, title string, tags array<string>, keywords array<string>"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", fields).alias("j"))
    return raw.select("j.id", "path", "j.title", F.coalesce("j.tags", "j.keywords").alias("tags")).where("id is not null")


def delimited_to_markdown(rows: DataFrame, line_no: str, columns: Sequence[str]) -> DataFrame:
    """Rows (line_no, line): a pipe table of ``rows`` in the order of ``line_no``, its head first."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in columns]
    body = rows.select((F.col(line_no).cast("bigint") + 2).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "line_no bigint, line string")
    return head.unionByName(body)


def _members(name: str, raw: bytes, depth: int = 0) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(path, size, content, error) of an archive's files; what would leave the archive's folder, links and the excess are errors."""
    total = 0
    try:
        if raw[:2] == b"PK":
            box = zipfile.ZipFile(io.BytesIO(raw))
            listed = [(i.filename, i.file_size, i.is_dir(), (i.external_attr >> 16) & 0o170000 == 0o120000, lambda i=i: box.read(i)) for i in box.infolist()]
        else:
            tape = tarfile.open(fileobj=io.BytesIO(raw))
            listed = [(m.name, m.size, m.isdir(), m.issym() or m.islnk(), lambda m=m: tape.extractfile(m).read()) for m in tape.getmembers()]
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
        yield name, len(raw), None, f"unreadable: {type(e).__name__}"
        return
    for k, (path, size, folder, link, read) in enumerate(listed):
        full = f"{name}/{path}"
        if folder:
            continue
        total += size
        if k >= MEMBERS or total > UNPACKED:
            yield full, size, None, "over the limit"
        elif link or path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/"):
            yield full, size, None, "unsafe path"
        else:
            content = read()
            if path.lower().endswith((".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
                yield from _members(full, content, depth + 1) if depth + 1 < DEPTH else [(full, size, None, "nested too deep")]
            else:
                yield full, size, content, None


def unpack(files: DataFrame) -> DataFrame:
    """Rows (path, size, content, error) of the members of zip and tar archives given as rows (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                for row in _members(path, bytes(raw)):
                    yield pd.DataFrame([row], columns=["path", "size", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, size bigint, content binary, error string")


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.cells: list[str] | None = None
        self.rows = 0
        self.lists: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "blockquote"):
            self.out.append("\n\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append(tag)
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n" + ("1. " if self.lists[-1:] == ["ol"] else "- "))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "tr" and self.cells is not None:
            self.out.append("| " + " | ".join(c.strip() for c in self.cells) + " |\n")
            self.rows += 1
            if self.rows == 1:
                self.out.append("|" + "---|" * len(self.cells) + "\n")
            self.cells = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.cells:
            self.cells[-1] += " ".join(data.split("\n"))
        elif self.cells is None:
            self.out.append(data if data.strip() or "\n" not in data else "")


def html_to_markdown(html: str | None) -> str | None:
    """Markdown of an HTML string: headings, paragraphs, lists, emphasis and tables; scripts and styles dropped."""
    if html is None:
        return None
    import re

    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = "\n".join(x.strip() for x in "".join(parser.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def convert_html(df: DataFrame, html: Column) -> DataFrame:
    """``df`` with a column ``markdown`` made of its HTML."""
    return df.withColumn("markdown", F.pandas_udf(lambda s: s.map(html_to_markdown), "string")(html))
