"""A million source files: no process and no copy of the settings for each."""

import gzip

from tokenloom.contract import queries as q
from tokenloom.sources.corpus import read_source_files


def test_local_files_are_written_by_the_tasks(spark, sf_dir, tmp_path, monkeypatch):
    """Hadoop's local file system starts a process for the mode of each file and of its checksum."""
    monkeypatch.setattr(q, "scratch_path", lambda s, name: str(tmp_path / name))
    rows = {r.doc_id: r.clean_text for r in q.source_files(spark, sf_dir).collect()}
    files = [p for p in (tmp_path / "files").rglob("*") if p.is_file()]
    assert sorted(int(p.stem) for p in files) == sorted(rows)
    assert {p.suffix for p in files} == {".txt"}
    assert all(p.read_bytes().startswith(f"{p.stem}\n".encode()) and p.read_bytes().endswith(b"\n") for p in files)
    assert rows == {r.doc_id: r.clean_text for r in q.cleaned_code(spark, sf_dir).collect()}


def test_other_file_systems_are_written_by_spark(spark, sf_dir, monkeypatch):
    local = {r.doc_id: r.clean_text for r in q.source_files(spark, sf_dir).collect()}
    monkeypatch.setattr("tokenloom.sources.corpus._local_path", lambda s, path: None)
    assert {r.doc_id: r.clean_text for r in q.source_files(spark, sf_dir).collect()} == local


def test_files_are_read_without_the_text_reader(spark, tmp_path):
    """Any bytes come as before; empty files too; names that a codec knows are still unpacked."""
    (tmp_path / "a.py").write_bytes(b"x = '\xe9\xff'\r\n\0")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "b c.py").write_bytes(b"")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "c.py").write_bytes(b"")
    (tmp_path / "d.py.gz").write_bytes(gzip.compress(b"y = 1\n"))
    rows = read_source_files(spark, str(tmp_path))
    assert "binaryFile" in rows._jdf.queryExecution().toString()
    got = {r.doc_id.rsplit("/", 1)[1]: bytes(r.b) for r in rows.selectExpr("doc_id", "CAST(content AS BINARY) AS b").collect()}
    assert got == {"a.py": b"x = '\xe9\xff'\r\n\0", "b%20c.py": b""}
    assert [r.content for r in read_source_files(spark, str(tmp_path), "*.gz").collect()] == ["y = 1\n"]
    everything = [r.content for r in read_source_files(spark, str(tmp_path), "d*").collect()]
    assert everything == ["y = 1\n"]
