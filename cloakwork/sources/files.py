"""File sources and sinks: text, office documents, folders."""

from __future__ import annotations

import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("node_modules", ".git")
# Extensions and names read as text.
TEXT_EXTENSIONS = "txt md markdown rst csv tsv json jsonl ndjson yaml yml xml html htm toml ini cfg conf properties env log sql py js mjs cjs ts tsx jsx java kt go rs rb php c h cpp hpp cs swift scala sh bash zsh ps1 bat r lua pl tf hcl gradle css scss less vue svelte graphql proto ipynb tex".split()
TEXT_NAMES = "Dockerfile Makefile Jenkinsfile Vagrantfile Procfile Gemfile LICENSE".split()


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def extension(path: Column) -> Column:
    """``.env.production`` has ``env``, ``a.tar.GZ`` has ``gz``, ``Makefile`` none."""
    base = base_name(path)
    return F.when(base.rlike(r"^\.[^.]+"), F.lower(F.regexp_extract(base, r"^\.([^.]+)", 1))).otherwise(F.lower(F.regexp_extract(base, r".\.([^.]*)\z", 1)))


def file_format(path: Column) -> Column:
    """xlsx, docx, pptx, pdf, text, or null for anything else."""
    ext = extension(path)
    return F.when(ext.isin("xlsx", "docx", "pptx", "pdf"), ext).when(ext.isin(*TEXT_EXTENSIONS) | base_name(path).isin(*TEXT_NAMES), "text")


def output_path(path: Column, prefix: str = "masked_") -> Column:
    """Next to the source, with a prefix; extracts of PDFs become Markdown."""
    base = base_name(path)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(base))
    return F.when(extension(path) == "pdf", F.concat(folder, F.regexp_replace(base, r"(?i)\.pdf\z", ""), F.lit("_masked.md"))).otherwise(F.concat(folder, F.lit(prefix), base))


def ignore_patterns(lines: list[str]) -> list[str]:
    """Regular expressions for the lines of an ignore file (no negation)."""
    out = []
    for line in (x.strip() for x in lines):
        if line and line[0] not in "#!":
            body = fnmatch.translate(line.strip("/"))[:-2].removeprefix("(?s:").removesuffix(")")
            out.append(f"{'^' if line.startswith('/') else '(?:^|/)'}{body}(?:/|$)")
    return out


def read_folder(spark: SparkSession, root: str, ignore: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """(path, format, content): all files below a folder that are neither ignored nor masked outputs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.col("path")
    skip = base_name(path).startswith("masked_")
    for name in SKIPPED:
        skip = skip | path.contains(f"/{name}/")
    for rx in ignore_patterns(ignore or []):
        skip = skip | F.regexp_replace(path, f"^(?:file:)?/*{re.escape(root.lstrip('/'))}/*", "").rlike(rx)
    kept = files.where(~skip).select("path", file_format(path).alias("format"), "content")
    return kept.where(extension(path).isin(*[e.lstrip(".").lower() for e in extensions])) if extensions else kept


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _paragraphs(data: bytes, ns: str) -> list[str]:
    return ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in ElementTree.fromstring(data).iter(f"{ns}p")]


def _sheet(data: bytes, shared: list[str]) -> list[str]:
    rows = []
    for row in ElementTree.fromstring(data).iter(f"{_S}row"):
        cells: list[str] = []
        for c in row.iter(f"{_S}c"):
            at = 0
            for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                at = at * 26 + ord(ch) - 64
            cells += [""] * (at - 1 - len(cells))
            value, kind = c.find(f"{_S}v"), c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else "" if value is None else value.text or ""
            cells.append(shared[int(text)] if kind == "s" and text else text)
        if any(cells):
            rows.append(" | ".join(cells))
    return rows


def office_text(content: bytes, kind: str) -> str:
    """Text of an xlsx, docx or pptx file: cells by `` | ``, rows and paragraphs by lines, sheets by a blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        order = lambda n: (re.sub(r"\d+", "", n), int((re.findall(r"\d+", n) or ["0"])[-1]))
        if kind == "xlsx":
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
            return "\n\n".join("\n".join(_sheet(z.read(n), shared)) for n in sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=order))
        rx, ns = (r"word/(document|header\d*|footer\d*|comments)\.xml$", _W) if kind == "docx" else (r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml$", _A)
        return "\n".join(p for n in sorted((n for n in names if re.match(rx, n)), key=order) for p in _paragraphs(z.read(n), ns))


def texts(files: DataFrame) -> DataFrame:
    """(path, format, text, error) of files as read_folder gives them; a broken file is a row with an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, kind, content in zip(pdf["path"], pdf["format"], pdf["content"], strict=True):
                try:
                    if kind == "pdf" or kind is None:
                        out.append((path, kind, None, "unsupported format"))
                    else:
                        out.append((path, kind, content.decode("utf-8", "replace") if kind == "text" else office_text(content, kind), None))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    out.append((path, kind, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "format", "text", "error"])

    return files.mapInPandas(read, "path string, format string, text string, error string")
