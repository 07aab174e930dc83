"""Plain images of 2048-byte sectors from images of any sector size, in parallel spans.

A manifest lists each image's spans of sectors. Tasks read their spans, cut headers and trailers,
and stage the data with a digest of each; one task an image then puts the spans together in
order, a piece at a time, and takes the digest of the whole. A span that is read again replaces
its own piece.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaspark.sources.files import Bytes, put, resolve, sized
from sigmaspark.sources.sacd import SECTOR, Image
from sigmaspark.sources.shared import shared_dir, stored

from .audio import _tracks

SPAN = 4096  # sectors
PIECE = 1 << 20


def manifest(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """path, sectors, sector_size, span and its first and count of sectors, for each image under ``path``."""
    files = spark.createDataFrame(sized(path, (".iso", ".sacd")), "path string, size long").repartition("path")

    def run(batches):
        for b in batches:
            paths, sizes = [], []
            for p in b.column("path").to_pylist():
                with Image(p) as img:
                    paths.append(p)
                    sizes.append((img.size // img.sector_size, img.sector_size))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([n for n, _ in sizes], pa.int64()), pa.array([s for _, s in sizes], pa.int32())], names=["path", "sectors", "sector_size"])

    known = files.mapInArrow(run, "path string, sectors long, sector_size int")
    spans = known.where("sectors > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sectors") - 1) / span))).alias("span"))
    return spans.select("*", (F.col("span") * span).alias("first"), F.least(F.lit(span), F.col("sectors") - F.col("span") * span).alias("count"))


def extract(spark: SparkSession, path: str, folder: str, span: int = SPAN) -> DataFrame:
    """Writes each image under ``path`` as ``folder``/name.iso: rows (path, target, spans, sectors, bytes, md5, digests of the spans).

    The result writes when it is evaluated; evaluate it once.
    """
    stage = f"{shared_dir(spark)}"

    def cut(batches):
        for b in batches:
            digests, pieces = [], []
            for p, no, first, count in zip(*(b.column(c).to_pylist() for c in ("path", "span", "first", "count")), strict=True):
                piece, md5 = f"{stage}/{hashlib.md5(p.encode()).hexdigest()}-{no}", hashlib.md5()
                with Image(p) as img:

                    def parts(img=img, first=first, count=count, md5=md5):
                        for at in range(first, first + count, PIECE // SECTOR):
                            data = img.sectors(at, min(PIECE // SECTOR, first + count - at))
                            md5.update(data)
                            yield data

                    put(piece, parts())
                digests.append(md5.hexdigest())
                pieces.append(piece)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.string()), pa.array(digests, pa.string())], names=[*b.schema.names, "piece", "md5"])

    plan = manifest(spark, path, span).repartition("path", "span")
    done = stored(plan.mapInArrow(cut, "path string, sectors long, sector_size int, span long, first long, count long, piece string, md5 string"), f"{stage}/done")

    def join(batches):
        for first, own in _tracks(batches):
            md5, digests = hashlib.md5(), []

            def data(own=own, md5=md5, digests=digests):
                for r in own("path"):
                    digests.append(r["md5"])
                    with Bytes(r["piece"]) as f:
                        for at in range(0, f.size, PIECE):
                            part = f.at(at, PIECE)
                            md5.update(part)
                            yield part

            name = resolve(first["path"])[1].rpartition("/")[2].rpartition(".")[0]
            target = f"{folder}/{name}.iso"
            size = put(target, data())
            if size != first["sectors"] * SECTOR:
                raise ValueError(f"{target}: {size} bytes of {first['sectors']} sectors")
            yield pa.RecordBatch.from_arrays(
                [pa.array([first["path"]]), pa.array([target]), pa.array([len(digests)], pa.int64()), pa.array([first["sectors"]], pa.int64()), pa.array([size], pa.int64()), pa.array([md5.hexdigest()]), pa.array([digests], pa.list_(pa.string()))],
                names=["path", "target", "spans", "sectors", "bytes", "md5", "span_md5"],
            )

    dealt = done.select("path", "sectors", "span", "piece", "md5").repartition("path").sortWithinPartitions("path", "span")
    return dealt.mapInArrow(join, "path string, target string, spans long, sectors long, bytes long, md5 string, span_md5 array<string>")
