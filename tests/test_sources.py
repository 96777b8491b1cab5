import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import embed as EM
from tidemark.operators import loss as LO
from tidemark.sources import labelled as S


def test_text_folders(spark, tmp_path):
    for side, texts in (("in", ["first\nline two", ""]), ("out", ["other"])):
        (tmp_path / side).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / side / f"{i}.txt").write_text(t)
    got = S.read_text_dirs(spark, str(tmp_path / "in" / "*.txt"), str(tmp_path / "out" / "*.txt")).collect()
    assert sorted((r.path.rsplit("/", 2)[-2], r.text, r.label) for r in got if r.text) == [("in", "first\nline two", 1), ("out", "other", 0)]


def test_line_corpora(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\ntwo\n")
    (tmp_path / "b.txt").write_bytes(b"three")
    got = S.read_line_corpora(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).collect()
    assert sorted((r.text, r.label) for r in got) == [("", 1), ("one\r", 1), ("three", 0), ("two", 1)]


def _png(colour_type: int, channels: int) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes(range(2 * channels)) for _ in range(2))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, colour_type, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_manifest(spark, tmp_path):
    """Broken files and images without three channels have no row; the rest is numbered in path order."""
    for name, data in (("c.png", _png(2, 3)), ("a.png", _png(2, 3)), ("grey.png", _png(0, 1)), ("broken.png", b"not an image")):
        (tmp_path / name).write_bytes(data)
    got = S.image_manifest(spark, str(tmp_path), 1, "a photo").orderBy("image_id").collect()
    assert [(r.image_id, r.image_paths.rsplit("/", 1)[-1], r.caption, r.label) for r in got] == [(0, "a.png", "a photo", 1), (1, "c.png", "a photo", 1)]


def test_plugin_hooks_get_batches_and_keep_rows(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id long, text string").repartition(4)

    def embed(texts: pd.Series):
        return [[len(t), 1.0] for t in texts]

    def score(texts: pd.Series):
        return texts.str.len() / 2

    got = LO.plugin_loss(EM.plugin_embedding(df, "text", embed), "text", score).collect()
    assert len(got) == 50 and all(r.embeds == [float(r.id), 1.0] and r.loss == r.id / 2 for r in got)
    assert EM.plugin_embedding(df.where(F.col("id") < 0), "text", embed).count() == 0
