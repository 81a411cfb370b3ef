"""Trees of files through the data source, as tables and as streams."""

import io
import os
import time
import zipfile

import pytest

from tessarium.sources import datasource


def docx(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w">' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:document>")
    return out.getvalue()


@pytest.fixture
def tree(tmp_path):
    files = {"concepts/red-bolt.md": b"# Red\n\n[[a]]", "concepts/deep/x.y.md": "é".encode(), "notes": b"plain", "a.docx": docx("One", "Two"), "bad.docx": b"no zip", "run.py": b"x = 1", "web.html": b"<p>Hi <b>you</b></p>", ".hidden/x.md": b"-", "concepts/.x.md": b"-", "empty.md": b""}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_files_as_a_table(spark, tree):
    datasource.register(spark)
    got = {r.page_id: r for r in spark.read.format("pages").load(str(tree)).collect()}
    assert set(got) == {"concepts/red-bolt", "concepts/deep/x.y", "notes", "a", "bad", "run", "web", "empty"}
    assert got["concepts/red-bolt"].text == "# Red\n\n[[a]]" and got["concepts/deep/x.y"].text == "é" and got["notes"].suffix == "" and got["empty"].text == ""
    assert got["a"].text == "One\n\nTwo" and got["a"].kind == "office" and got["run"].metadata["language"] == "Python" and got["web"].text == "Hi **you**"
    assert got["bad"].text is None and "error" in got["bad"].metadata
    assert got["a"].size == (tree / "a.docx").stat().st_size and abs(got["a"].modified.timestamp() - (tree / "a.docx").stat().st_mtime) < 1
    assert spark.read.format("pages").load(f"{tree}/.hidden/../concepts/deep").count() == 1


def test_partitions_by_size_and_pushed_conditions(spark, tree):
    datasource.register(spark)
    whole = spark.read.format("pages").option("splitBytes", "20").load(str(tree))
    assert whole.rdd.getNumPartitions() > 3 and whole.count() == 8
    assert spark.read.format("pages").load(str(tree)).rdd.getNumPartitions() == 1
    found = whole.where("suffix IN ('md', 'py') AND page_id LIKE 'concepts/%' AND size > 2")
    assert [r.page_id for r in found.collect()] == ["concepts/red-bolt"]
    # conditions on the listing are the source's, the others stay with Spark
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("Filter", 1)[1].split("+- ")[0]
    assert "size" in kept and "suffix" not in kept
    assert whole.where("kind = 'office' AND suffix = 'docx'").count() == 2 and whole.where("suffix = 'none'").count() == 0


def test_splits():
    files = [datasource.File(str(i), f"{i:02}", "md", "markdown", size, 0) for i, size in enumerate((5, 5, 100, 1, 9, 0))]
    assert [[f.size for f in s.files] for s in datasource.splits(files, 10)] == [[5, 5], [100], [1, 9, 0]]
    assert datasource.splits([], 10) == []


def test_files_as_a_stream(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in").mkdir()

    def put(name: str, text: str, ago: float) -> None:
        (tmp_path / "in" / name).write_text(text)
        os.utime(tmp_path / "in" / name, (time.time() - ago, time.time() - ago))

    def run() -> list[tuple]:
        stream = spark.readStream.format("pages").option("lag", "0").load(str(tmp_path / "in"))
        stream.select("page_id", "text").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(120)
        return sorted(map(tuple, spark.read.schema("page_id string, text string").parquet(f"{tmp_path}/out").collect()))

    put("a.md", "one", 50)
    put("b.md", "two", 50)
    assert run() == [("a", "one"), ("b", "two")]
    assert run() == [("a", "one"), ("b", "two")]
    put("c.md", "three", -0.0)
    put("a.md", "changed", 0.0)
    assert run() == [("a", "changed"), ("a", "one"), ("b", "two"), ("c", "three")]
