"""Lines of files by ranges: exact numbers and places, and a stream that goes on where it stopped."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.ingest import transcript_texts
from palimpsest.sources import lines

LONG = "x" * 70 + " says something at last"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_bytes("first\r\n\nthird é\n…\nlast without an end".encode())
    (tmp_path / "in" / "sub" / "b.jsonl").write_bytes(b"".join(b"line %d\n" % k for k in range(40)))
    (tmp_path / "in" / "empty.jsonl").write_bytes(b"")
    (tmp_path / "in" / "_skipped.jsonl").write_bytes(b"no\n")
    (tmp_path / "in" / "other.txt").write_bytes(b"no\n")
    return tmp_path / "in"


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_numbers_are_exact_for_any_range(spark, folder, size):
    got = sorted((r.file.rsplit("/", 1)[1], r.line_number, r.at, r.line) for r in lines.read_lines(spark, str(folder), size=size).collect())
    wanted = []
    for file in (folder / "a.jsonl", folder / "sub" / "b.jsonl"):
        at = 0
        for k, raw in enumerate(file.read_bytes().splitlines(keepends=True)):
            wanted.append((file.name, k + 1, at, raw.decode().rstrip("\n").removesuffix("\r")))
            at += len(raw)
    assert got == sorted(wanted)


def test_texts_of_transcript_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"message": {"role": "user", "content": "%s"}}\nno json\n{"message": {"content": [{"type": "text", "text": "short"}, {"text": "%s"}]}}\n' % (LONG, LONG))
    rows = lines.read_lines(spark, str(tmp_path), size=30).select(F.struct("file", "line_number").alias("line_id"), "line")
    assert sorted((r.line_id.line_number, r.part, r.content) for r in transcript_texts(rows).collect()) == [(1, 0, LONG), (3, 0, LONG)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    lines.register(spark)

    def run():
        stream = spark.readStream.format("numbered_lines").option("suffix", ".jsonl").option("rangeBytes", "8").load(str(source))
        stream.select("file", "at", "line").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.file.rsplit("/", 1)[1], r.at, r.line) for r in spark.read.parquet(str(out)).collect())

    (source / "a.jsonl").write_text("one\ntwo\nthr")
    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    with (source / "a.jsonl").open("a") as f:
        f.write("ee\nfour\n")
    (source / "b.jsonl").write_text("other\n")
    assert run() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("a.jsonl", 8, "three"), ("a.jsonl", 14, "four"), ("b.jsonl", 0, "other")]
    assert len(run()) == 5
