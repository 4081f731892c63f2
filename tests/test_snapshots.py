import os

import pytest
from pyspark.sql import functions as F

from folioscan.operators import search
from folioscan.sources import catalog, lines, snapshots


def page(n, title):
    return f'<TEI xml:id="i{n}"><teiHeader><fileDesc><titleStmt><title>{title}</title></titleStmt></fileDesc></teiHeader></TEI>'


def titles(spark, folder):
    return {r["path"].rpartition("/")[2]: r["title"] for r in snapshots.index(spark, folder).collect()}


def test_only_changed_files_are_parsed(spark, tmp_path, monkeypatch):
    root, folder = tmp_path / "corpus", str(tmp_path / "catalogue")
    (root / "a").mkdir(parents=True)
    for n in range(100):
        f = root / "a" / f"f{n:03d}.xml"
        f.write_text(page(n, f"Title {n}"))
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    assert titles(spark, folder) == {} and snapshots.current(spark, folder) is None
    assert snapshots.refresh(spark, str(root), folder) == {"parsed": 100, "kept": 0, "gone": 0}
    assert snapshots.refresh(spark, str(root), folder) == {"parsed": 0, "kept": 100, "gone": 0}
    (root / "a" / "f007.xml").write_text(page(7, "Changed title"))
    before = titles(spark, folder)
    assert before["f007.xml"] == "Title 7"  # the old snapshot is whole until the new one is
    assert snapshots.refresh(spark, str(root), folder) == {"parsed": 1, "kept": 99, "gone": 0}
    assert titles(spark, folder) == {**before, "f007.xml": "Changed title"}
    (root / "a" / "f001.xml").unlink()
    (root / "new.xml").write_text(page(1, "New"))
    assert snapshots.refresh(spark, str(root), folder) == {"parsed": 1, "kept": 98 + 1, "gone": 1}
    assert "f001.xml" not in titles(spark, folder) and titles(spark, folder)["new.xml"] == "New" and len(titles(spark, folder)) == 100
    assert snapshots.clean(spark, folder) == 2 and len(titles(spark, folder)) == 100
    monkeypatch.setattr(snapshots, "RULES", 2)  # other rules: everything is parsed anew
    assert snapshots.refresh(spark, str(root), folder)["parsed"] == 100 and len(titles(spark, folder)) == 100


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    root, folder = tmp_path / "corpus", str(tmp_path / "catalogue")
    root.mkdir()
    (root / "a.xml").write_text(page(1, "One"))
    snapshots.refresh(spark, str(root), folder)
    (root / "b.xml").write_text(page(2, "Two"))

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(snapshots, "_point", dies)
    with pytest.raises(OSError):
        snapshots.refresh(spark, str(root), folder)
    assert titles(spark, folder) == {"a.xml": "One"}
    monkeypatch.undo()
    assert snapshots.refresh(spark, str(root), folder) == {"parsed": 1, "kept": 1, "gone": 0}
    index = snapshots.index(spark, folder)
    assert index.columns == [f.split()[0] for f in catalog.INDEX.split(", ")] and catalog.validity(index, index.select("path")).first()["valid"]


def written(tmp_path, files):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_a_file_cut_into_ranges_gives_the_same_lines(spark, tmp_path):
    text = "".join(f"line {i} {'lotus' if i % 7 == 0 else 'none'} é法\r\n" if i % 3 else f"{'x' * (i % 50)} lotus  \n" for i in range(2000)) + "the end lotus"
    other = "\n\nlotus\n\n"
    root = written(tmp_path, {"a.txt": text.encode(), "b.txt": other.encode(), "c.txt": b"lotus\n\0\nlotus\n", "d.txt": b"", "e.txt": b"none"})
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", len(text.encode()) // 7 + 1)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        ranges = lines._ranges(spark, root).filter("path LIKE '%a.txt'").select("at").distinct().count()
        got = {(r["path"].rpartition("/")[2], r["line_number"]): (r["context"], r["highlight"]) for r in lines.hits(spark, root, "lotus").collect()}
        every = {(r["path"].rpartition("/")[2], r["line_number"]): r["line"] for r in lines.lines(spark, root).collect()}
        capped = sorted((r["path"].rpartition("/")[2], r["line_number"]) for r in lines.hits(spark, root, "lotus", 3).collect())
        assert lines.hits(spark, root, "(").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert ranges >= 7
    whole = spark.createDataFrame([("a.txt", text), ("b.txt", other), ("c.txt", "lotus\n\0\nlotus\n"), ("d.txt", ""), ("e.txt", "none")], "path string, text string")
    assert got == {(r["path"], r["line_number"]): (r["context"], r["highlight"]) for r in search.hits(whole, "lotus", "path").collect()}
    assert capped == sorted((r["path"], r["line_number"]) for r in search.hits(whole, "lotus", "path", 3).collect())
    assert [every["b.txt", k] for k in range(1, 5)] == ["", "", "lotus", ""] and ("b.txt", 5) not in every and every["a.txt", 2001] == "the end lotus" and every["e.txt", 1] == "none"


def test_payloads_are_stored_once(spark, tmp_path):
    table = str(tmp_path / "payloads")
    answers = spark.createDataFrame([(1, "x" * 50), (2, "short"), (3, "x" * 50), (4, "y" * 60), (5, None)], "id int, p string")
    first = {r["id"]: r for r in search.spill_to(answers, "p", table, 20, 5).collect()}
    assert [first[i]["shown"] for i in (1, 2, 4, 5)] == ["xxxxx", "short", "yyyyy", None] and first[1]["key"] == first[3]["key"] and first[2]["key"] is None and not first[2]["spilled"]
    stored = spark.read.parquet(table)
    assert {r["key"]: r["payload"] for r in stored.collect()} == {first[1]["key"]: "x" * 50, first[4]["key"]: "y" * 60}
    search.spill_to(answers.union(spark.createDataFrame([(6, "z" * 30)], "id int, p string")), "p", table, 20, 5)
    assert spark.read.parquet(table).count() == 3 and spark.read.parquet(table).select(F.countDistinct("key")).first()[0] == 3
    search.spill_to(answers, "p", table, 20, 5)
    assert spark.read.parquet(table).count() == 3
