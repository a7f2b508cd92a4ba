"""Reports and the command line."""

import glob

from pyspark.sql import functions as F

from cloakwork.__main__ import main
from cloakwork.operators import detect
from cloakwork.registry import select
from cloakwork.sinks import reports


def text_of(folder):
    return "\n".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{folder}/part-*")))


def test_reports(spark, tmp_path):
    rows = [("a<b>.txt", "\n".join(f"u{k}@x.org" for k in range(35))), ("b.txt", "784-1990-1234567-9"), ("c.txt", "clean"), (None, "1.2.3.4")]
    found = detect.findings(spark.createDataFrame(rows, "source string, text string"), "source", detectors=select(["email", "national_id", "ip"]))
    reports.write(found, "source", f"{tmp_path}/md")
    md = text_of(tmp_path / "md")
    assert "**Total findings:** 37" in md and "(5 more)" in md and md.count("| Email |") == 30 and "### `?` — 1 finding(s)" in md and "c.txt" not in md and "@x.org" not in md
    assert md.index("# Compliance report") < md.index("a<b>.txt") < md.index("### `b.txt`")
    reports.write(found, "source", f"{tmp_path}/html", "html", "ar")
    html = text_of(tmp_path / "html")
    assert 'dir="rtl"' in html and "a&lt;b&gt;.txt" in html and html.count("<td>Email</td>") == 35 and html.rstrip().endswith("</html>")
    reports.write(found, "source", f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == 37 and "@x.org" not in text_of(tmp_path / "json")
    reports.write(found.where(F.lit(False)), "source", f"{tmp_path}/none")
    assert "**Total findings:** 0" in text_of(tmp_path / "none")
    usage = reports.usage(spark.createDataFrame([("2024-01-05 00:00:00", "pii"), ("2024-01-06 00:00:00", "id"), ("2024-02-01 00:00:00", "pii")], "ts string, cat string").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, usage.collect())) == [("2024-01", 2, 1, 1, 0), ("2024-02", 1, 0, 1, 0)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail a@x.org and a@x.org")
    (tmp_path / "in" / "b.txt").write_text("nothing here")
    (tmp_path / "in" / ".gitignore").write_text("c.txt\n")
    (tmp_path / "in" / "c.txt").write_text("z@x.org")
    folder = str(tmp_path / "in")
    assert main(["scan", f"{folder}/b.txt"], spark) == 0
    assert main(["audit", folder], spark) == 1 and "email\ta@x.org" in capsys.readouterr().out
    assert main(["scan-dir", folder, "-o", f"{tmp_path}/report"], spark) == 1 and "a.txt" in text_of(tmp_path / "report")
    assert main(["mask-dir", folder, "-o", f"{tmp_path}/masked"], spark) == 0
    masked = {r.path.rsplit("/", 1)[1]: r.text for r in spark.read.parquet(f"{tmp_path}/masked").collect()}
    assert masked == {"masked_a.txt": "mail [EMAIL_1] and [EMAIL_1]", "masked_b.txt": "nothing here", "masked_.gitignore": "c.txt\n"} or masked == {"masked_a.txt": "mail [EMAIL_1] and [EMAIL_1]", "masked_b.txt": "nothing here"}
    assert main(["db-scan", "mock:empty"], spark) == 0 and main(["db-audit", "mock:leaky"], spark) == 1
    assert main(["db-mask", "mock:customers", "-o", f"{tmp_path}/rows"], spark) == 0
    rows = spark.read.json(f"{tmp_path}/rows").orderBy("id").collect()
    assert rows[0].email == rows[2].email == "[EMAIL_1]" and rows[1].email != rows[0].email
    assert main(["db-scan", "nothing"], spark) == 2 and main(["list-patterns"]) == 0
    assert main(["guard", f"{folder}/a.txt", "--agent", "claude", "--destination", "external_model"], spark) == 0


def test_jdbc_urls():
    from cloakwork.sources.database import jdbc_url

    assert jdbc_url("postgres://u:p%40w@h:5432/d?ssl=true") == ("jdbc:postgresql://h:5432/d?ssl=true", {"user": "u", "password": "p@w"})
    assert jdbc_url("mariadb://h/d") == ("jdbc:mysql://h/d", {})
    assert jdbc_url("data/x.sqlite3") == ("jdbc:sqlite:data/x.sqlite3", {})
    assert jdbc_url("jdbc:mysql://h/d") == ("jdbc:mysql://h/d", {})
