"""An uncompressed archive of an index and its members, written by many tasks.

Where a member begins follows from the sizes of those before it: sizes are summed by range and inside each range, so no task sees all
members. Each task then writes the stretch of its range, streaming one member after the other in pieces, as a file beside the archive; one last task
joins the stretches, in order and in pieces, and takes the digest, which has to see every byte in turn.
The bytes are those that the ``tarfile`` module writes.
"""

from __future__ import annotations

import hashlib
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.sources.shared import staged
from tidemark.sources.sliced import located

# Bytes of a block, and of a record, whose multiple the archive is.
BLOCK, RECORD = 512, 10240
#: Bytes that are moved at once; members of a range.
PIECE, MEMBERS = 1 << 20, 4096


def _head(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.DEFAULT_FORMAT)


def _padding(size: int) -> int:
    return -size % BLOCK


def archive_layout(members: DataFrame) -> DataFrame:
    """Members (name, length, and more) in order of ``place``: adds ``part``, ``start`` (of the member in the archive) and ``data`` (of its first byte).

    A repeated name is an error.
    """
    again = members.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if again:
        raise ValueError(f"repeated members: {[r.name for r in again]}")

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(head=[len(_head(n, int(s))) for n, s in zip(frame["name"], frame["length"], strict=True)])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema.fields)
    parts = max(1, -(-members.count() // MEMBERS))
    placed = members.repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id())
    own = staged(placed.mapInPandas(heads, f"{shape}, part int, head long"))
    size = F.col("head") + F.col("length") + F.pmod(-F.col("length"), F.lit(BLOCK))
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = own.groupBy("part").agg(F.sum(size).alias("_s"))  # a row a range
    sums = sums.select("part", F.coalesce(F.sum("_s").over(every), F.lit(0).cast("long")).alias("_before"))
    upto = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    out = own.withColumn("_in", F.coalesce(F.sum(size).over(upto), F.lit(0).cast("long"))).join(F.broadcast(sums), "part")
    return out.withColumn("start", F.col("_before") + F.col("_in")).withColumn("data", F.col("start") + F.col("head")).drop("_in", "_before", "head")


def write_archive(members: DataFrame, path: str) -> DataFrame:
    """Writes the archive and returns its manifest: ``archive_layout`` without contents.

    ``members``: place (their order), name, length, and either ``content`` (bytes) or ``path`` of a file that is streamed.
    """
    contents = "content" if "content" in members.columns else "path"
    manifest = staged(archive_layout(members))
    rows = manifest.select("part", "place", "name", "length", contents)
    n = max(1, rows.agg(F.max("part")).first()[0] or 0) + 1

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at, done = None, None, []
        for frame in frames:
            for part, name, length, content in zip(frame["part"], frame["name"], frame["length"], frame[contents], strict=True):
                if part != at:
                    if out is not None:
                        out.close()
                    system, own = located(f"{path}.parts/{part}")
                    system.create_dir(own.rsplit("/", 1)[0], recursive=True)
                    out, at = system.open_output_stream(own), part
                    done.append(int(part))
                out.write(_head(name, int(length)))
                moved = 0
                if contents == "content":
                    out.write(content)
                    moved = len(content)
                else:
                    source, own = located(content)
                    with source.open_input_stream(own) as f:
                        while piece := f.read(PIECE):
                            out.write(piece)
                            moved += len(piece)
                if moved != length:
                    raise ValueError(f"{name} has {moved} bytes, not {length}")
                out.write(bytes(_padding(int(length))))
        if out is not None:
            out.close()
        yield pd.DataFrame({"part": done})

    made = rows.repartition(n, "part").sortWithinPartitions("part", "place").mapInPandas(write, "part int")
    parts = sorted(r.part for r in made.collect())  # a row a range

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _ in range(len(frame)):
                digest, total = hashlib.sha256(), 0
                system, own = located(path)
                with system.open_output_stream(own) as out:

                    def put(piece: bytes, out=out, digest=digest) -> int:
                        out.write(piece)
                        digest.update(piece)
                        return len(piece)

                    for part in parts:
                        source, name = located(f"{path}.parts/{part}")
                        with source.open_input_stream(name) as f:
                            while piece := f.read(PIECE):
                                total += put(piece)
                    total += put(bytes(2 * BLOCK))
                    put(bytes(-total % RECORD))
                folder, name = located(f"{path}.parts")
                if parts:
                    folder.delete_dir(name)
                yield pd.DataFrame({"sha256": [digest.hexdigest()]})

    spark = members.sparkSession
    digest = spark.range(1).coalesce(1).mapInPandas(join, "sha256 string").first()[0]
    return manifest.drop("content", "part").withColumn("archive_sha256", F.lit(digest))


def read_members(manifest: DataFrame, path: str) -> DataFrame:
    """(name, content) of the members of a manifest, each read from its own place in the archive."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, own = located(path)
        for frame in frames:
            with system.open_input_file(own) as f:
                for i in range(0, len(frame), 64):
                    part, got = frame.iloc[i : i + 64], []
                    for at, length in zip(part["data"], part["length"], strict=True):
                        f.seek(int(at))
                        got.append(f.read(int(length)))
                    yield pd.DataFrame({"name": part["name"], "content": got})

    return manifest.select("name", "data", "length").mapInPandas(run, "name string, content binary")


def archive_names(spark: SparkSession, path: str) -> DataFrame:
    """The names in an archive, repeated ones too, from its headers alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["path"]:
                system, own = located(p)
                with system.open_input_file(own) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    names = []
                    while (info := tar.next()) is not None:
                        names.append(info.name)
                        tar.members = []
                        if len(names) == 10000:
                            yield pd.DataFrame({"path": names})
                            names = []
                    yield pd.DataFrame({"path": names})

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, "path string")
