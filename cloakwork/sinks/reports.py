"""Compliance reports as text tables: Markdown and HTML (English, Arabic), JSON lines, usage totals.

The head of a report has a bounded size.  Sections, one per file, are built by column
expressions and written by Spark, so a report may cover any number of files; each lists
its first findings and how many more there are.  Reports hold no values.

``found``: as detect.findings gives it, with a source column.  Defined results: no
findings give a head with zeros and no sections; null sources are one file, named ``?``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import report
from ..registry import BY_ID, SEVERITIES

FIRST_MARKDOWN, FIRST_HTML = 30, 100
# Titles of the cited articles.
ARTICLE_TITLES = {
    1: ("Definitions of Personal Data", "تعريفات البيانات الشخصية"),
    5: ("Conditions for Processing Personal Data", "شروط معالجة البيانات الشخصية"),
    6: ("Consent for Processing Personal Data", "الموافقة على معالجة البيانات الشخصية"),
    9: ("Rights of the Data Subject", "حقوق صاحب البيانات"),
    15: ("Sensitive Personal Data", "البيانات الشخصية الحساسة"),
    20: ("Security of Personal Data", "أمن البيانات الشخصية"),
    21: ("Reporting a Personal Data Breach", "الإبلاغ عن انتهاك البيانات الشخصية"),
    22: ("Cross-Border Transfer of Personal Data", "نقل البيانات الشخصية عبر الحدود"),
    25: ("Appointment of a Data Protection Officer", "تعيين مسؤول حماية البيانات"),
}
WORDS = {
    "en": {"title": "Compliance report", "files": "Files with findings", "total": "Findings", "articles": "Articles cited", "line": "Line", "type": "Type", "severity": "Severity", "more": "more"},
    "ar": {"title": "تقرير الامتثال", "files": "ملفات فيها نتائج", "total": "إجمالي النتائج", "articles": "المواد المستشهد بها", "line": "السطر", "type": "النوع", "severity": "الخطورة", "more": "أخرى"},
}


def summary(found: DataFrame, source: str) -> dict:
    """Totals of a report; one row, a row per severity and a row per article reach the driver."""
    totals = report.by_category(found).first().asDict()
    severities = dict(map(tuple, report.by_severity(found).collect()))
    articles = [tuple(r) for r in report.top_articles(found, len(ARTICLE_TITLES)).collect()]
    return totals | {"files": found.select(source).distinct().count(), "severities": {s: severities.get(s, 0) for s in SEVERITIES[:0:-1]}, "articles": articles}


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("id")]


def _per_file(found: DataFrame, source: str, first: int) -> DataFrame:
    """(source, n, rows): the first findings of each file.

    Counts are aggregated apart, and only findings with a place among the first are
    collected, so a file with very many findings costs its task a bounded array.
    """
    named = found.withColumn(source, F.coalesce(F.col(source).cast("string"), F.lit("?")))
    counts = named.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    top = report.first_per_group(report.enrich(named), source, ["line", "start"], first)
    labels, cited = _lookup({i: d.label for i, d in BY_ID.items()}), _lookup({i: ", ".join(f"Art. {a}" for a in d.articles) for i, d in BY_ID.items()})
    rows = top.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("rank", "line", labels.alias("label"), "severity", cited.alias("articles")))).alias("rows"))
    return counts.join(rows, source)


def markdown_sections(found: DataFrame, source: str) -> DataFrame:
    """(source, section)."""
    line = lambda r: F.concat(F.lit("| "), r["line"].cast("string"), F.lit(" | "), r["label"], F.lit(" | "), r["severity"], F.lit(" | "), r["articles"], F.lit(" |"))
    n = F.col("n")
    more = F.when(n > FIRST_MARKDOWN, F.array(F.concat(F.lit("| … | … | … | ("), (n - FIRST_MARKDOWN).cast("string"), F.lit(" more) |")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("### `"), F.col(source), F.lit("` — "), n.cast("string"), F.lit(" finding(s)")), F.lit(""), F.lit("| Line | Type | Severity | Articles |"), F.lit("| ---: | --- | --- | --- |"))
    return _per_file(found, source, FIRST_MARKDOWN).select(source, F.array_join(F.concat(head, F.transform("rows", line), more, F.array(F.lit(""))), "\n").alias("section"))


def markdown_head(s: dict) -> str:
    lines = ["# Compliance report", "", f"**Files:** {s['files']}", "", "## Summary", "", f"- **Total findings:** {s['total']}", f"- **By category:** {s['n_id']} ID & docs · {s['n_pii']} personal info · {s['n_cred']} credentials"]
    lines += ["- **By severity:** " + " · ".join(f"{n} {k}" for k, n in s["severities"].items()), "", "## Top articles cited", "", "| Article | Title | Findings |", "| --- | --- | ---: |"]
    return "\n".join([*lines, *(f"| Art. {a} | {ARTICLE_TITLES[a][0]} | {n} |" for a, n in s["articles"]), "", "## Files with findings", ""])


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def html_sections(found: DataFrame, source: str, lang: str = "en") -> DataFrame:
    """(source, section)."""
    w, n = WORDS[lang], F.col("n")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = lambda r: F.concat(F.lit("<tr>"), cell(r["line"].cast("string")), cell(escaped(r["label"])), F.lit('<td class="'), r["severity"], F.lit('">'), r["severity"], F.lit("</td>"), cell(r["articles"]), F.lit("</tr>"))
    head = F.concat(F.lit("<section><h3>"), escaped(F.col(source)), F.lit(" ("), n.cast("string"), F.lit(f")</h3><table><tr><th>{w['line']}</th><th>{w['type']}</th><th>{w['severity']}</th><th>{w['articles']}</th></tr>"))
    more = F.when(n > FIRST_HTML, F.concat(F.lit("<p>+"), (n - FIRST_HTML).cast("string"), F.lit(f" {w['more']}</p>"))).otherwise(F.lit(""))
    return _per_file(found, source, FIRST_HTML).select(source, F.concat(head, F.array_join(F.transform("rows", row), ""), F.lit("</table>"), more, F.lit("</section>")).alias("section"))


def html_head(s: dict, lang: str = "en") -> str:
    w, k = WORDS[lang], 1 if lang == "ar" else 0
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px}.critical{color:#a00}.high{color:#c60}@media print{section{break-inside:avoid}}"
    articles = "".join(f"<tr><td>Art. {a}</td><td>{ARTICLE_TITLES[a][k]}</td><td>{n}</td></tr>" for a, n in s["articles"])
    severities = " · ".join(f"{n} {name}" for name, n in s["severities"].items())
    return f'<!doctype html><html lang="{lang}" dir="{"rtl" if k else "ltr"}"><head><meta charset="utf-8"><title>{w["title"]}</title><style>{style}</style></head><body><h1>{w["title"]}</h1><p>{w["total"]}: {s["total"]} ({severities})</p><h2>{w["articles"]}</h2><table>{articles}</table><h2>{w["files"]}: {s["files"]}</h2>'


def write(found: DataFrame, source: str, path: str, kind: str = "markdown", lang: str = "en") -> None:
    """A folder of text parts in the order of sources; kind: markdown, html or json."""
    spark = found.sparkSession
    if kind == "json":
        report.redacted(report.enrich(found)).write.mode("overwrite").json(path)
        return
    if kind not in ("markdown", "html"):
        raise ValueError(f"no such kind of report: {kind}")
    s = summary(found, source)
    head, sections, foot = (markdown_head(s), markdown_sections(found, source), "") if kind == "markdown" else (html_head(s, lang), html_sections(found, source, lang), "</body></html>")
    ends = spark.createDataFrame([(0, "", head), (2, "", foot)], "part int, source string, value string")
    body = sections.select(F.lit(1).alias("part"), F.col(source).alias("source"), F.col("section").alias("value"))
    ends.unionByName(body).orderBy("part", "source").select("value").write.mode("overwrite").text(path)


def usage(events: DataFrame) -> DataFrame:
    """Totals per month of (ts, cat) events; holds counts only."""
    cat = F.col("cat")
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("bucket")).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(cat == c).alias(f"n_{c}") for c in ("id", "pii", "cred")))


def audit(decisions: DataFrame, key: str, path: str) -> None:
    """Append value-free release decisions to a log of JSON lines."""
    decisions.select(F.col(key).cast("string").alias("resource"), "decision", "reason", "iterations", F.current_timestamp().alias("at")).write.mode("append").json(path)
