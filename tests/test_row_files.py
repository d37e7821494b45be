"""One file per row: totals, marker, refused paths, repeated tasks, broken writes, pictures there and back."""

import os
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonality.sources import images, row_files


def _files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read()
            for d, _, names in os.walk(root) for f in names if not f.startswith(("_", "."))}


def _frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def test_files_totals_and_marker(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(f"c{i % 3}/f{i}.bin", bytes([i]) * (i + 1)) for i in range(50)] + [(None, b"x"), ("c0/none.bin", None)]
    assert row_files.committed(spark, root) is None
    got = row_files.write_files(_frame(spark, rows).repartition(7), root)
    assert got == {"files": 50, "bytes": sum(range(51)), "skipped": 2} == row_files.committed(spark, root)
    assert _files(root) == {p: c for p, c in rows if p and c is not None}
    assert not os.path.exists(os.path.join(root, row_files.PENDING))
    # Spark reads what was written and passes over the marker
    back = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    assert back.count() == 50 and back.agg(F.sum(F.length("content"))).first()[0] == sum(range(51))


def test_uri_other_columns_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([("x", "a/b.txt", bytearray(b"1"))], "path string, place string, body binary")
    assert row_files.write_files(df, f"file://{tmp_path}/u", "place", "body")["files"] == 1
    assert _files(str(tmp_path / "u")) == {"a/b.txt": b"1"}
    assert row_files.write_files(df.limit(0), f"file:{tmp_path}/e", "place", "body") == {"files": 0, "bytes": 0, "skipped": 0}


@pytest.mark.parametrize("path", ["", "/etc/x", "../x", "a/../../x", "a//b", "./x"])
def test_paths_out_of_the_folder(spark, tmp_path, path):
    root = str(tmp_path / "out")
    with pytest.raises(Exception, match="not a path below the folder"):
        row_files.write_files(_frame(spark, [(path, b"x")]), root)
    assert row_files.committed(spark, root) is None


def test_two_rows_with_one_path(spark, tmp_path):
    with pytest.raises(ValueError, match="a/b"):
        row_files.write_files(_frame(spark, [("a/b", b"x"), ("a/b", b"x")]), str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out")


def test_a_task_that_runs_again_changes_nothing(tmp_path):
    root = str(tmp_path / "out")
    batch = pa.RecordBatch.from_arrays([pa.array(["a/x", "b/y"]), pa.array([b"1", b"22"], pa.binary())], names=["path", "content"])
    writer = row_files.FilesWriter(root)
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first == again == row_files.Written(2, 3, 0)
    writer.commit([again, None])
    assert _files(root) == {"a/x": b"1", "b/y": b"22"} and not os.path.exists(os.path.join(root, row_files.PENDING))


def test_a_broken_write_leaves_no_marker_and_can_be_completed(spark, tmp_path):
    root = str(tmp_path / "out")
    good = [(f"f{i}", bytes([i])) for i in range(20)]
    row_files.write_files(_frame(spark, good[:5]), root)
    with pytest.raises(Exception, match="not a path below the folder"):
        row_files.write_files(_frame(spark, [*good, ("../x", b"x")]).repartition(4), root)
    assert row_files.committed(spark, root) is None
    assert row_files.write_files(_frame(spark, good), root)["files"] == 20
    assert _files(root) == dict(good)


def test_pictures_there_and_back(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(i, ["sad", "glad"][i % 2], bytes((i * 7 + j * 11) % 256 for j in range(2 * 3 * 3))) for i in range(9)]
    df = spark.createDataFrame([*rows, (9, "sad", None), (10, None, rows[0][2])], "k int, c string, p binary")
    assert images.write_image_folder(df, root, "k", "c", "p", 2, 3) == {
        "files": 9, "bytes": sum(map(len, _files(root).values())), "skipped": 2}
    got = images.read_images(spark, root, classes=["sad", "glad"]).collect()
    assert len(got) == 9
    for r in got:
        k, c, pixels = rows[int(r.path.split("/")[-1][:-4])]
        assert (r.category, r.label) == (c, ["sad", "glad"].index(c)) and (r.image.height, r.image.width) == (2, 3)
        bgr = bytes(r.image.data)
        assert b"".join(bgr[j:j + 3][::-1] for j in range(0, 18, 3)) == pixels
    assert images.image_manifest(spark, root).count() == 9
    with pytest.raises(ValueError):
        images.png_bytes(b"123", 2, 3)
    assert zlib.crc32(b"IEND") == 0xAE426082
