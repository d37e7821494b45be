"""Labelled image folders.

A folder per class (``root/<class>/<file>.png``). The manifest reads file paths only:
selecting ``path`` from the ``binaryFile`` source prunes the ``content`` column, so no image
bytes are read to count or label files. ``write_image_folder`` makes such a folder from rows of pixels.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonality.functions.labels import CLASS_NAMES, class_label_index
from tonality.session import ship_package
from tonality.sources.row_files import write_files

# Fixed value: ``*.png`` in any letter case (a plain ``*.png`` glob misses ``.PNG``).
PNG_GLOB = "*.[pP][nN][gG]"


def _class_of(path_col: str = "path") -> F.Column:
    """Name of the folder holding the file (the class)."""
    return F.element_at(F.split(F.col(path_col), "/"), -2)


def image_manifest(spark: SparkSession, root: str, classes=CLASS_NAMES, glob: str = PNG_GLOB) -> DataFrame:
    """``path, filename, category, label`` for every matching file under ``root``.

    ``label`` is the position of the folder name in ``classes`` (-1 for a folder not listed);
    the full path is the key, since one file name can appear in two class folders.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(root).select("path"))
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("filename"), _class_of().alias("category"),
        class_label_index(_class_of(), classes).alias("label"))


def read_images(spark: SparkSession, root: str, classes=CLASS_NAMES, glob: str = PNG_GLOB) -> DataFrame:
    """Decoded images (Spark's ``image`` source, undecodable files dropped) with class label."""
    imgs = (spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).load(root))
    origin = F.col("image.origin")
    return imgs.select(origin.alias("path"), _class_of_expr(origin).alias("category"),
                       class_label_index(_class_of_expr(origin), classes).alias("label"), "image")


def _class_of_expr(c) -> F.Column:
    return F.element_at(F.split(c, "/"), -2)


def png_bytes(pixels: bytes, height: int, width: int) -> bytes:
    """A PNG file of 8-bit RGB pixels, row by row."""
    if len(pixels) != 3 * height * width or not pixels:
        raise ValueError(f"{len(pixels)} bytes are no {height} x {width} RGB image")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + pixels[y * 3 * width:(y + 1) * 3 * width] for y in range(height))
    # The PNG signature, chunk names and header fields (depth 8, colour type 2)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def encode_png(df: DataFrame, pixels_col: str, height: int, width: int, out: str = "content", keep: list[str] | None = None) -> DataFrame:
    """PNG files of rows of RGB bytes (null stays null), a column of Arrow batches."""
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != pixels_col] if keep is None else keep
    src = df.select(*keep, pixels_col)
    k = len(keep)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            files = [None if p is None else png_bytes(p, height, width) for p in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(files, pa.binary())], names=[*batch.schema.names[:k], out])
    return src.mapInArrow(run, src.select(*keep).schema.add(out, "binary"))


def write_image_folder(df: DataFrame, root: str, name_col: str, class_col: str, pixels_col: str, height: int, width: int) -> dict[str, int]:
    """Write rows of RGB bytes as ``root/<class>/<name>.png``; the totals of :func:`write_files`."""
    named = df.select(F.concat(F.col(class_col), F.lit("/"), F.col(name_col).cast("string"), F.lit(".png")).alias("path"), F.col(pixels_col))
    return write_files(encode_png(named, pixels_col, height, width, keep=["path"]), root)
