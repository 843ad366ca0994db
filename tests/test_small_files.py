"""Small source files: few folders, few tasks."""

from tokenloom.contract import queries as q
from tokenloom.sources.corpus import default_spread, read_source_files


def test_small_files_share_a_task(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"f{i}.py").write_text(f"x = {i}\n")
    rows = read_source_files(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= default_spread(spark)
    assert sorted(r.content for r in rows.collect()) == sorted(f"x = {i}\n" for i in range(600))


def test_source_files_take_few_folders(spark, sf_dir, monkeypatch):
    seen = []
    read = q.read_source_files
    monkeypatch.setattr(q, "read_source_files", lambda *a: seen.append(read(*a)) or seen[0])
    monkeypatch.setattr(q, "FILE_FOLDERS", 5)
    rows = {r.doc_id: r.clean_text for r in q.source_files(spark, sf_dir).collect()}
    files = [r.doc_id for r in seen[0].select("doc_id").collect()]
    assert len({f.rsplit("/", 1)[0] for f in files}) <= 5
    assert len(files) == len(rows)
    assert rows == {r.doc_id: r.clean_text for r in q.cleaned_code(spark, sf_dir).collect()}
