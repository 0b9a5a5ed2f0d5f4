"""Files as tables: JSON lines, nested cases, texts by line, paths; and sinks with an atomic publish."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "role string, content array<struct<type:string,text:string,id:string,name:string,tool_use_id:string,content:string>>, isMeta boolean, metadata map<string,string>"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A record a line. Bad lines are skipped, or, ``strict``, an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def last_records(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of several records of a key the last one by ``order``."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("b"))
    return best.select(key, f"b.{order}", *(F.col(f"b.{c}").alias(c) for c in rest))


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of nested cases in one JSON file each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def turns(nested: DataFrame, key: str, sessions: str, dates: str) -> DataFrame:
    """``key, session_no, turn_no, at, turn`` from arrays of sessions of turns: a turn is a second after the one before, from the session's date."""
    one = nested.select(key, dates, F.posexplode(sessions).alias("session_no", "s"))
    flat = one.select(key, "session_no", F.get(dates, F.col("session_no")).alias("day"), F.posexplode("s").alias("turn_no", "turn"))
    return flat.select(key, "session_no", "turn_no", (F.col("day") + F.make_interval(secs=F.col("turn_no"))).alias("at"), "turn")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_no`` (from 1)``, line`` of text files. A file is one row until it is split, so files are to be of moderate size."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\n")).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")


def sliced(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """Lines [offset, offset + limit), numbered from 1, of each file."""
    return rows.where((F.col("line_no") >= offset) & (F.col("line_no") < offset + limit))


def grep(rows: DataFrame, pattern: str, mode: str = "content", limit: int = 0) -> DataFrame:
    """Lines that a pattern meets: themselves (``content``), their files (``files``) or how many a file has (``count``)."""
    hits = rows.where(F.col("line").rlike(pattern))
    out = {"content": lambda: hits, "files": lambda: hits.select("path").distinct(), "count": lambda: hits.groupBy("path").agg(F.count("*").alias("n"))}[mode]()
    return out.orderBy("path", *(["line_no"] if mode == "content" else [])).limit(limit) if limit else out


def glob(spark: SparkSession, folder: str, pattern: str, ignored: tuple[str, ...] = (".git", "node_modules"), limit: int = 100) -> DataFrame:
    """``path, modified, size`` of the files that a glob names, newest first, without ignored folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).drop("content")
    inside = "|".join(f"/{x.replace('.', '[.]')}/" for x in ignored)
    return files.where(~F.col("path").rlike(inside)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path").limit(limit)


def results(found: DataFrame, key: str, items: str, limit: int = 10) -> DataFrame:
    """``key, rank, title, url`` of arrays of results: trimmed, those without an address left out, ranked anew."""
    named = F.filter(F.transform(items, lambda r: F.struct(F.trim(r["title"]).alias("title"), F.trim(r["url"]).alias("url"))), lambda r: F.coalesce(r["url"], F.lit("")) != "")
    return found.select(key, F.posexplode(F.slice(named, 1, limit)).alias("i", "r")).select(key, (F.col("i") + 1).alias("rank"), "r.title", "r.url")


def publish(rows: DataFrame, folder: str, expected: int | None = None) -> str:
    """Writes a new version beside the old ones and points to it only when it is whole: readers see the old or the new table, never a part.

    ``folder`` is of a shared file system mounted at the driver. A version with another number of rows than ``expected`` is not published.
    """
    version = f"v-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{version}")
    n = rows.sparkSession.read.parquet(f"{folder}/{version}").count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows written, {expected} expected; the old version stays")
    path = folder.removeprefix("file://")
    with open(f"{path}/.current.tmp", "w") as f:
        json.dump({"version": version, "rows": n}, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}/.current.tmp", f"{path}/current.json")
    return version


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The version that ``publish`` points to."""
    with open(f"{folder.removeprefix('file://')}/current.json") as f:
        return spark.read.parquet(f"{folder}/{json.load(f)['version']}")


def report(rows: DataFrame, path: str) -> tuple[str, str]:
    """A small report (a row a metric) as JSON and as a Markdown table; returns both paths."""
    got = [r.asDict() for r in rows.collect()]  # a report
    with open(path + ".json", "w") as f:
        json.dump(got, f, ensure_ascii=False, indent=1, default=str)
    with open(path + ".md", "w") as f:
        f.write("| " + " | ".join(rows.columns) + " |\n|" + "-|" * len(rows.columns) + "\n")
        f.writelines("| " + " | ".join(str(r[c]) for c in rows.columns) + " |\n" for r in got)
    return path + ".json", path + ".md"
