"""Sample files: JSON arrays, JSON lines and Parquet to canonical rows, and back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import detect_schema, to_canonical
from .shared import written


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw): the samples of a ``.json`` file (one top-level array) or a ``.jsonl`` file (one a line), in order, as JSON strings.

    Positions run from 0 without gaps. Lines of JSON lines are numbered by a count over the file's
    splits, so that a large file is read in parallel; blank lines don't count.
    """
    kind = _suffix(path)
    if kind == "json":
        whole = spark.read.text(path, wholetext=True)
        return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw")).select(F.col("pos").cast("long").alias("pos"), "raw")
    if kind != "jsonl":
        raise ValueError(f"neither .json nor .jsonl: {path}")
    # splits are written with their lines: planned twice, a file could be cut at other places than those that were counted
    lines = written(_lines(spark, path), "lines")
    before = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = before.select("file", "start", "first", F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # there is one row a split to broadcast
    return lines.join(F.broadcast(before), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first")).cast("long").alias("pos"), "raw")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file, start, at): lines that aren't blank, with their file, the byte at which their split of it begins, and a number that counts up by one within a split. Spark orders splits by size, not by place."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.where(F.trim("raw") != "").withColumn("at", F.monotonically_increasing_id())


def first_sample(spark: SparkSession, path: str) -> str:
    """The first sample of a file as JSON; StopIteration if it has none."""
    if _suffix(path) == "jsonl":
        got = _lines(spark, path).orderBy("file", "start", "at").limit(1).collect()
    else:
        got = read_raw(spark, path).orderBy("pos").limit(1).collect()
    if not got:
        raise StopIteration(path)
    return got[0]["raw"]


def read_samples(spark: SparkSession, paths: str | Sequence[str], schema: str | None = None, mode: str = "first_match", on_error: str = "fail") -> DataFrame:
    """Canonical rows of one or more files, one after the other, with ids from 0; the schema is that given, or the one detected, which must be the same for all."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames, names = [], []
    for path in paths:
        if _suffix(path) == "parquet":
            frames.append(spark.read.parquet(path))
            names.append("canonical")
            continue
        raw = read_raw(spark, path)
        names.append(schema or detect_schema(raw, mode))
        frames.append(to_canonical(raw, names[-1], on_error))
    if len(set(names)) > 1:
        raise ValueError(f"files of several schemas: {sorted(set(names))}")
    return reduce(concat, frames)


def concat(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, ids and positions of the right one shifted to begin behind the largest of the left, so that none meet."""
    last = left.agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in ("id", "pos")]).first()
    return left.unionByName(right.withColumn("id", F.col("id") + last["id"]).withColumn("pos", F.col("pos") + last["pos"]), allowMissingColumns=True)


def to_json(samples: DataFrame) -> DataFrame:
    """(pos, raw): canonical rows as JSON, without nulls; extras stand beside the fields they came with, as strings."""
    merged = lambda base, extras: F.map_concat(base, F.coalesce(extras, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    messages = F.transform("messages", lambda m: merged(F.map_filter(F.create_map(F.lit("role"), m["role"], F.lit("content"), m["content"]), lambda k, v: v.isNotNull()), m["extras"]))
    listed = F.to_json(messages)
    rest = F.to_json("extras")
    inner = F.when(F.size("extras") > 0, F.concat(F.lit(","), F.substring(rest, 2, 1 << 30))).otherwise("}")
    return samples.select("pos", F.concat(F.lit('{"messages":'), listed, inner).alias("raw"))


def write_jsonl(samples: DataFrame, path: str) -> None:
    """Canonical rows as JSON lines in order, in parallel."""
    to_json(samples).orderBy("pos").select(F.col("raw").alias("value")).write.mode("overwrite").text(path)


def write_json_array(samples: DataFrame, path: str, indent: int = 4) -> int:
    """Canonical rows as one JSON array in a file of any file system, in order, letters kept as they are; rows come one partition at a time. Returns their number."""
    import json

    spark = samples.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)
    out, held, n = fs.create(at, True), bytearray(b"["), 0
    try:
        for r in to_json(samples).orderBy("pos").toLocalIterator():
            body = json.dumps(json.loads(r["raw"]), indent=indent, ensure_ascii=False).replace("\n", "\n" + " " * indent)
            held += (("," if n else "") + "\n" + " " * indent + body).encode("utf-8", "surrogatepass")
            n += 1
            if len(held) > 1 << 20:
                out.write(bytes(held))
                held.clear()
        out.write(bytes(held) + (b"\n]" if n else b"]"))
    finally:
        out.close()
    return n


def check_paths(spark: SparkSession, sources: Sequence[str] = (), outputs: Sequence[str] = ()) -> None:
    """Sources must be there; outputs must not be folders, and lie in one folder, which is made."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    for p in sources:
        if not at(p).getFileSystem(conf).exists(at(p)):
            raise FileNotFoundError(p)
    parents = set()
    for p in outputs:
        fs = at(p).getFileSystem(conf)
        if fs.exists(at(p)) and fs.getFileStatus(at(p)).isDirectory():
            raise IsADirectoryError(p)
        parents.add(at(p).getParent().toString())
    if len(parents) > 1:
        raise ValueError(f"outputs in several folders: {sorted(parents)}")
    for p in parents:
        at(p).getFileSystem(conf).mkdirs(at(p))


def file_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes) of the files behind a path, from their metadata alone."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def conversations(table: DataFrame) -> DataFrame:
    """Canonical rows from a table of turns (conv_id, turn, role, text): id and position are conv_id, and each message's extras have its turn as id."""
    turns = table.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    message = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), F.create_map(F.lit("id"), t["turn"].cast("string")).alias("extras"))
    return turns.select(F.col("conv_id").alias("id"), F.col("conv_id").alias("pos"), F.transform("t", message).alias("messages"), F.lit(None).cast("map<string,string>").alias("extras"))
