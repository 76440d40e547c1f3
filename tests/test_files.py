import io
import zipfile

import pytest

from lectern.operators import corpus, manifest
from lectern.sources import files
from lectern.streaming import ingest


def tree(root, names):
    for n, data in names.items():
        p = root / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_listing(spark, tmp_path):
    tree(tmp_path, {"Manuals/alpha.txt": b"a", "gamma.txt": b"g", "_kept.txt": b"k", "sheet.xlsx": b"x", "notes.md": b"x", "@eaDir/t.txt": b"", "@Recently-Snapshot/GMT_1/Manuals/alpha.txt": b"a", "x/@Snapshot/b.txt": b"", ".hidden/x.txt": b"", "Thumbs.db": b"", "~$draft.docx": b"", "Manuals/.DS_Store": b""})
    r = {x.relpath: (x.verdict, x.folder) for x in files.listing(spark, str(tmp_path)).collect()}
    assert {k for k, v in r.items() if v[0] == "ok"} == {"Manuals/alpha.txt", "gamma.txt", "_kept.txt"} and r["sheet.xlsx"][0] == r["notes.md"][0] == "unsupported"
    assert r["@eaDir"][0] == r["@Recently-Snapshot"][0] == r["x/@Snapshot"][0] == r[".hidden"][0] == "excluded" and not any("GMT_1" in k for k in r)
    assert {x.relpath for x in files.listing(spark, str(tmp_path), "Manuals").collect()} == {"Manuals/alpha.txt", "Manuals/.DS_Store"}
    assert r["gamma.txt"][1] == "General" and r["Manuals/alpha.txt"][1] == "Manuals"
    for bad in ("..", "../etc", "Manuals/../..", "/etc"):
        with pytest.raises(ValueError):
            files.resolve(str(tmp_path), bad)


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, h="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{h}\"/></w:pPr>' if h else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Head", "Heading1") + p("text") + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr></w:tbl>" + p("Tail", "Heading1")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_extract(spark):
    f = spark.createDataFrame([("a.csv", b"name,grade\n\nx|y,1\n"), ("e.csv", b""), ("t.log", b"2024-01-02 03:04:05 z\nkeep \xff"), ("d.docx", _docx()), ("bad.docx", b"no zip"), ("noext", b"n")], "filename string, content binary")
    r = {x.filename: x for x in files.extract(f).collect()}
    assert r["a.csv"].text == "| name | grade |\n| --- | --- |\n| x\\|y | 1 |" and r["e.csv"].text == "" and r["t.log"].text == "keep �"
    assert r["d.docx"].text == "Head\ntext\n\nTail\n\nTable 0\n| a | b |\n| --- | --- |" and r["bad.docx"].error and r["bad.docx"].text is None and r["noext"].text == "n"


def test_manifest(spark):
    m = spark.createDataFrame([("a", 1, 10.0, "d1", "ok", 1), ("a", 2, 11.0, "d1", "ok", 2), ("b", 5, 5.0, None, "error", 1), (None, 1, 1.0, None, "ok", 1)], "relpath string, size long, mtime double, doc_id string, status string, scanned_at int")
    f = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 11.0005), ("b", 5, 5.0), ("c", 1, 1.0), (None, 1, 1.0)], "relpath string, size long, mtime double")
    assert {(r.relpath, r.size) for r in manifest.new_files(f, m).collect()} == {("a", 1), ("c", 1)}
    assert tuple(manifest.preview(f, m).first()) == (2, 2, 2)
    assert manifest.record(m, m.limit(0)).count() == 4 and manifest.forget(m, f).count() == 1
    e = spark.createDataFrame([(f"p{i}", f"m{i}") for i in range(5)], "relpath string, message string")
    assert [r.message for r in manifest.capped_errors(e, 3).orderBy("pos").collect()] == ["m0", "m1", "m2", "... and 2 more errors"]


def test_corpus_and_stream(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    tree(src, {"a.txt": b"Title : Alpha\n  System Mass            59.473       kg\nhello world", "sub/b.txt": b"second file", "copy.txt": b"second file", "blank.txt": b"   ", "bad.docx": b"zz"})
    job = ingest.Ingest(spark, f"file://{src}", out, flush=3)
    job.start().awaitTermination()
    m = {r.path.rsplit("/", 1)[-1]: r.status for r in job.manifest().collect()}
    assert m == {"a.txt": "ok", "b.txt": "ok", "copy.txt": "ok", "blank.txt": "empty", "bad.docx": "error"}
    c = job.corpus.chunks()
    assert c.select("doc_id").distinct().count() == 2 and c.where("chunk_index = -1").first().content == "Alpha | System Mass: 59.473 kg"
    tree(src, {"c.txt": b"third"})
    job.start().awaitTermination()
    assert job.corpus.chunks().select("doc_id").distinct().count() == 3
    one = job.corpus.chunks().where("content = 'third'").select("doc_id")
    job.corpus.delete_documents(spark.createDataFrame(one.collect(), "doc_id string"))
    assert job.corpus.chunks().where("content = 'third'").count() == 0


def test_deletes_are_null_safe(spark):
    c = spark.createDataFrame([("1", "d", None), ("2", "d", "image"), ("3", "e", None), ("4", None, None)], "chunk_id string, doc_id string, chunk_type string")
    d = spark.createDataFrame([("d",), (None,)], "doc_id string")
    assert {r.chunk_id for r in corpus.without_text_of(c, d).collect()} == {"2", "3", "4"}
    assert {r.chunk_id for r in corpus.without_documents(c, d).collect()} == {"3", "4"}


def test_stream_passes_over_known_and_breaks(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    tree(src, {"a.txt": b"first text", "b.txt": b"other text"})
    job = ingest.Ingest(spark, f"file://{src}", out)
    job.start().awaitTermination()
    files_before = {p.name for p in (tmp_path / "out/chunks").rglob("*.parquet")}
    # A stream without its checkpoint sees the files again; the manifest knows them, so nothing is written.
    again = ingest.Ingest(spark, f"file://{src}", out)
    seen = spark.read.format("binaryFile").schema(ingest.FILES).load(f"file://{src}")
    again._batch(seen, 7)
    assert {p.name for p in (tmp_path / "out/chunks").rglob("*.parquet")} == files_before and not (tmp_path / "out/manifest/batch=7").exists()
    # New documents are appended, files of others stay as they are.
    tree(src, {"c.txt": b"third text"})
    job.start().awaitTermination()
    assert files_before < {p.name for p in (tmp_path / "out/chunks").rglob("*.parquet")} and job.corpus.chunks().select("doc_id").distinct().count() == 3
    bad = tmp_path / "bad"
    tree(bad, {f"{i}.docx": b"no zip %d" % i for i in range(4)} | {"1a.txt": b"fine"})
    frame = spark.read.format("binaryFile").schema(ingest.FILES).load(f"file://{bad}")
    ingest.Ingest(spark, f"file://{bad}", f"{out}2", most_errors=2)._batch(frame, 0)
    with pytest.raises(ingest.Unreachable):
        ingest.Ingest(spark, f"file://{bad}", f"{out}3", most_errors=1)._batch(frame, 0)


def test_reindex(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    tree(src, {"a.txt": b"first text", "b.txt": b"other text", "c.md": b"not taken"})
    job = ingest.Ingest(spark, f"file://{src}", out)
    job.start().awaitTermination()
    tree(src, {"d.txt": b"fourth text"})
    assert job.reindex() == 3 and {r.path.rsplit("/", 1)[-1] for r in job.manifest().collect()} == {"a.txt", "b.txt", "d.txt"}
    assert job.reindex(names=["b.txt", "d.txt"], limit=1) == 1 and job.corpus.chunks().first().content == "other text"
