"""Files in and out: streams of new files, and trees of files written whole or not at all."""

import os

import duckdb
import pytest

from quillspark import catalogue
from quillspark.sources import files as S
from quillspark.sources import mirror as M


def _tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8", newline="").read() for d, _, names in os.walk(folder) for f in names}


def test_new_files_only(spark, tmp_path):
    """A second run reads what came meanwhile, a third nothing; each file is in the table once."""
    source, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "log")
    (source / "deep").mkdir(parents=True)
    for i in range(7):
        (source / f"f{i}.txt").write_bytes(f"text {i}\r\n".encode())
    run = lambda: S.convert_new(spark, str(source), out, log, files_a_batch=3)
    assert run() == 7
    (source / "deep/new.csv").write_text("a,b\n1,2\n")
    (source / "f0.txt").write_text("changed, but seen")
    assert run() == 1 and run() == 0
    got = {r["filename"]: r["markdown"] for r in spark.read.parquet(out).collect()}
    assert got == {f"f{i}.txt": f"text {i}\n" for i in range(7)} | {"new.csv": "| a | b |\n| --- | --- |\n| 1 | 2 |"} and spark.read.parquet(out).count() == 8


def test_mirror(spark, tmp_path):
    rows = [("a/b.md", "x\ny", "http://h/a/b"), ("index.md", "é", "http://h/"), ("a/b.md", "later", "http://h/a/b.html"), ("a/c/index.md", "", "http://h/a/c"), ("index.md", "no key", None)]
    files = spark.createDataFrame(rows, "path string, content string, url string").repartition(3)
    site = str(tmp_path / "site")
    M.write_mirror(files, site)
    assert _tree(site) == {"a/b.md": "x\ny", "index.md": "é", "a/c/index.md": ""} and os.listdir(tmp_path) == ["site"]
    with pytest.raises(Exception, match="overwrite replaces it"):
        M.write_mirror(files.limit(0), site)
    assert len(_tree(site)) == 3 and os.listdir(tmp_path) == ["site"]
    M.write_mirror(files.where("path = 'index.md'"), site, overwrite=True)
    assert _tree(site) == {"index.md": "é"} and os.listdir(tmp_path) == ["site"]
    M.write_mirror(files.limit(0), site, overwrite=True)
    assert _tree(site) == {} and os.listdir(tmp_path) == ["site"]


def test_of_pages_with_one_address_the_first_is_mirrored(spark, tmp_path):
    """As the SQL has it in one thread: contents don't decide, whatever their order."""
    html = lambda t: f"<title>{t}</title>"
    rows = [(1, "http://h.test/b", html("z")), (2, "http://h.test/b", html("a")), (3, "http://i.test/b", html("b")), (4, "http://h.test/c", html("c")), (5, "http://h.test/c", html("d")), (6, "http://g.test/c/", html("y"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, catalogue.snk_03_mirror(spark, str(tmp_path)).select("path", "content").collect()))
    assert got == sorted(duck.execute(catalogue.ORACLE_SQL["snk_03_mirror"]).fetchall()) and 'title: "z"' in got[0][1]


def test_a_failed_job_leaves_the_mirror_as_it_was(spark, tmp_path):
    site = str(tmp_path / "site")
    fine = spark.createDataFrame([("a.md", "x", "u")], "path string, content string, url string")
    M.write_mirror(fine, site)
    for bad in ("../out.md", "/abs.md", "a//b.md"):
        with pytest.raises(Exception, match="no path within"):
            M.write_mirror(fine.union(spark.createDataFrame([(bad, "x", "u")], fine.schema)), site, overwrite=True)
    with pytest.raises(ValueError, match="a file and a folder"):
        M.write_mirror(fine.union(spark.createDataFrame([("a.md/b.md", "x", "u")], fine.schema)), site, overwrite=True)
    assert _tree(site) == {"a.md": "x"} and os.listdir(tmp_path) == ["site"]


def test_attempts_that_are_run_again_leave_no_strays(tmp_path):
    """An attempt that breaks off, its second run and a third beside it: each file once and whole."""
    writer = M.MirrorWriter(str(tmp_path / "site"), False, ["path", "content"])
    rows = [("a/1.md", "one"), ("2.md", "two")]

    def broken():
        yield rows[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(broken())
    messages = [writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))]
    assert not os.path.exists(tmp_path / "site")
    writer.commit(messages)
    assert _tree(tmp_path / "site") == {"a/1.md": "one", "2.md": "two"} and os.listdir(tmp_path) == ["site"]
    other = M.MirrorWriter(str(tmp_path / "other"), False, ["path", "content"])
    other.write(iter(rows))
    other.abort([])
    other.abort([])
    assert os.listdir(tmp_path) == ["site"]


@pytest.mark.parametrize("columns", [["markdown"], ["markdown", "warnings"]])
def test_csv_is_read_once(spark, capsys, columns):
    """Rows of a CSV file are worked out once for its table and its warnings: the plan has the pattern of cells once."""
    files = spark.createDataFrame([("a.csv", "x,y\n1,2,3\n"), ("b.csv", " , \n"), ("c.csv", '"a""b",c'), ("d.txt", "p,q")], "filename string, text string")
    out = S.convert(files).select(*columns)
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count(',((?:[^",]') == 1
    assert [r["markdown"] for r in out.collect()] == ["| x | y | Column 3 |\n| --- | --- | --- |\n| 1 | 2 | 3 |", "", '| a"b | c |\n| --- | --- |', "p,q"]
