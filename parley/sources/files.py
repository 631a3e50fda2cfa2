"""File sources and sinks of the meeting pipeline, all through Spark's readers and writers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.audio import wav_column

CHUNK = 512
RATE = 16_000


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """path, samples (16 kHz mono) of the WAV files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", wav_column(F.col("content")).alias("samples"))


def chunks(audio: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """keys, n, start_ms, samples: audio in chunks of ``size`` samples (the last may be shorter)."""
    n = F.ceil(F.size("samples") / F.lit(size)).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    return audio.select(*keys, "samples", at.alias("n")).select(*keys, "n", F.expr(f"(n * {size} * 1000L) div {RATE}").alias("start_ms"), F.slice("samples", F.col("n") * size + 1, F.lit(size)).alias("samples"))


def gaps(chunks: DataFrame, keys: list[str], slack: int = 16) -> DataFrame:
    """``chunks`` (first_sample, n_samples) with pad: the silent samples to write before each."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("first_sample")
    written = F.coalesce(F.max(F.col("first_sample") + F.col("n_samples")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    missing = F.col("first_sample") - written
    return chunks.withColumn("pad", F.when(missing > slack, missing).otherwise(0))


def integrity(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """path, state (missing, corrupt or ok) of the manifest's files (path below the folder, size, sha256).

    Files meet the manifest by their whole path below the folder; only files of the right size are read.
    """
    folder = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", path).rstrip("/") + "/"
    own = F.expr(f"substring(path, locate({_quoted(folder)}, path) + {len(folder)})")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(own.alias("path"), "length", "content")
    met = files.join(manifest.select("path", "size", F.lower("sha256").alias("sha")), "path")
    fine = (F.col("length") == F.col("size")) & F.when(F.col("length") == F.col("size"), F.sha2("content", 256) == F.col("sha"))
    known = met.select("path", F.when(fine, "ok").otherwise("corrupt").alias("state"))
    return manifest.select("path").join(known, "path", "left").select("path", F.coalesce("state", F.lit("missing")).alias("state"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest with one JSON object per line; malformed lines are dropped (``broken_lines`` has them)."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a manifest that are no JSON objects."""
    return spark.read.text(path).filter((F.trim("value") != "") & F.coalesce(~F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")), F.lit(True)))


def tab_separated(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A file of tab-separated fields without quoting."""
    return spark.read.csv(path, sep="\t", quote="").toDF(*columns)


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """token, id, is_blank from lines whose last blank parts them; the blank is ``<blk>``, else the last id.

    A table whose ids are not 0 to n - 1, each once, raises an error when it is read.
    """
    parts = r"^(.*) (\d+)$"
    rows = spark.read.text(path).select(F.regexp_extract("value", parts, 1).alias("token"), F.regexp_extract("value", parts, 2).try_cast("int").alias("id")).filter("id is not null")
    named = F.max(F.when(F.col("token") == "<blk>", F.col("id")))
    of = rows.agg(F.coalesce(named, F.max("id")).alias("blank"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d"), F.max("id").alias("top"))
    whole = (F.col("n") == F.col("d")) & (F.col("top") == F.col("n") - 1)
    checked = F.when(whole, F.col("id")).otherwise(F.raise_error(F.lit("token ids must be 0 to n - 1")).cast("int"))
    return rows.crossJoin(F.broadcast(of)).select("token", checked.alias("id"), (F.col("id") == F.col("blank")).alias("is_blank"))  # of has one row


def info_value(spark: SparkSession, path: str, key: str) -> DataFrame:
    """value: what follows ``key:`` on the first line that begins so."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).filter(F.startswith(F.ltrim("value"), F.lit(f"{key}:")))
    return lines.agg(F.min_by(F.trim(F.substr(F.ltrim("value"), F.lit(len(key) + 2))), "n").alias("value"))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """id, file, raw, text, n_samples, gender of a speech corpus' tab-separated listing."""
    rows = tab_separated(spark, path, ["id", "file", "raw", "text", "characters", "n_samples", "gender"])
    return rows.select(F.col("id").cast("long").alias("id"), "file", "raw", "text", F.col("n_samples").cast("long").alias("n_samples"), "gender")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """id, text, sound (bytes) of a corpus of read sentences in Parquet (columns sentence and audio.bytes).

    Sentences with digits are left out, of equal ones the first by its audio's path stays.
    """
    rows = spark.read.parquet(path).filter(~F.col("sentence").rlike(r"(?U)\d")).select("sentence", F.coalesce(F.col("audio.path"), F.lit("")).alias("path"), F.col("audio.bytes").alias("bytes"))
    first = rows.groupBy("sentence").agg(F.min(F.struct("path", "bytes")).alias("a"))
    return first.select(F.regexp_replace(F.element_at(F.split("a.path", "/"), -1), r"\.[^.]*$", "").alias("id"), F.col("sentence").alias("text"), F.col("a.bytes").alias("sound"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """The result files below a path, one row each; broken ones and summaries are left out."""
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    shape = "model string, sets map<string,struct<n:long,wer:double,cer:double,rtf:double>>"
    rows = files.filter("file <> 'summary.json'").select("file", F.from_json("value", shape).alias("r"))
    return rows.filter("r.model is not null").select("file", "r.*")


def devices(listing: DataFrame) -> DataFrame:
    """id, name, kind from a JSON listing (column value): monitors by class, by what they monitor, or by name."""
    kind = "array<struct<name:string,description:string,monitor_of_sink:string,monitor_source:string,properties:map<string,string>>>"
    rows = listing.select(F.inline(F.from_json("value", kind)))
    of = F.greatest(F.length(F.coalesce("monitor_of_sink", F.lit(""))), F.length(F.coalesce("monitor_source", F.lit("")))) > 0
    monitor = of | (F.coalesce(F.col("properties")["device.class"], F.lit("")) == "monitor") | F.col("name").endswith(".monitor")
    return rows.select(F.col("name").alias("id"), F.coalesce("description", "name").alias("name"), F.when(monitor, "monitor").otherwise("input").alias("kind"))
