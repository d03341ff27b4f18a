"""Readers, writers and tables about records."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import natural_key

SENSOR = "t double, ew double, ns double, ud double"


def read_sensor_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated sensor files with a header line: path, seq (order of lines in a file), t, ew, ns, ud. Short and non-numeric lines are passed over; a byte-order mark does not matter."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), place.alias("seq"), F.split(F.regexp_replace("value", "^﻿", ""), "\t").alias("f")).where(F.size("f") >= 4)
    cols = [F.expr(f"try_cast(trim(f[{j}]) AS double)").alias(n) for j, n in enumerate(("t", "ew", "ns", "ud"))]
    return lines.select("path", "seq", *cols).where("t IS NOT NULL AND ew IS NOT NULL AND ns IS NOT NULL AND ud IS NOT NULL")


def checked_sensors(df: DataFrame, key: str = "path") -> DataFrame:
    """Sensor samples as they are; an error if a file has fewer than two or a time that is not after the one before."""
    w = W.partitionBy(key)
    few, falls = F.count(F.lit(1)).over(w) < 2, F.col("t") <= F.lag("t").over(w.orderBy("seq"))
    reason = F.when(few, F.concat(F.lit("no usable samples: "), F.col(key).cast("string"))).when(falls, F.concat(F.lit("times do not rise: "), F.col(key).cast("string")))
    return df.withColumn("t", F.when(reason.isNotNull(), F.raise_error(reason).cast("double")).otherwise(F.col("t")))


def read_all_strings(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, every column text: of several paths the first that exists; none gives an empty table of ``columns``."""
    for path in paths:
        try:
            return spark.read.csv(path, header=True, inferSchema=False)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns or []) or "none string")


def read_events(spark: SparkSession, path: str, fields: str = "event string, frame_index long, reseed_id long") -> DataFrame:
    """JSON lines of events; a line that is none is the event ``malformed_event_line``."""
    df = spark.read.json(path, schema=f"{fields}, _bad string", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return df.withColumn("event", F.coalesce("event", F.lit("malformed_event_line"))).drop("_bad")


def concat_segments(df: DataFrame, key: str = "record_id", segment: str = "segment") -> DataFrame:
    """Samples of a record's segments on one clock: a segment that starts before the one before ended is moved to a median step after it.

    Each shift depends on the shifts before, so the record's segments (a row each) are folded in order; samples
    only add their segment's shift.
    """
    steps = df.withColumn("dt", F.col("t") - F.lag("t").over(W.partitionBy(key, segment).orderBy("t")))
    seg = steps.groupBy(key, segment).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.coalesce(F.percentile("dt", F.lit(0.5)), F.lit(0.0)).alias("step"))
    rows = seg.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(segment, "first", "last", "step"))).alias("rows"))
    kind = dict(df.dtypes)[segment]
    start = F.struct(F.lit(None).cast("double").alias("end"), F.array().cast(f"array<struct<{segment}:{kind},shift:double>>").alias("out"))

    def fold(h, r):
        shift = F.when(r["first"] <= h["end"], h["end"] + r["step"] - r["first"]).otherwise(F.lit(0.0))
        return F.struct((r["last"] + shift).alias("end"), F.concat(h["out"], F.array(F.struct(r[segment].alias(segment), shift.alias("shift")))).alias("out"))

    shifts = rows.select(key, F.explode(F.aggregate("rows", start, fold, lambda h: h["out"])).alias("o")).select(key, f"o.{segment}", "o.shift")
    return df.join(shifts, [key, segment]).withColumn("t", F.col("t") + F.col("shift"))


def stem(path: str) -> tuple:
    """A file's name without folder, ending and trailing part number."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.regexp_replace(name, r"-\d+$", "")


def pair_files(files: DataFrame, video: str = "(?i)\\.(avi|mp4|mov|mkv)$", sensor: str = "(?i)\\.txt$") -> DataFrame:
    """Of paths: record_id, videos, sensors and status, in natural order of record_id."""
    v = files.where(F.col("path").rlike(video)).groupBy(stem("path").alias("record_id")).agg(F.array_sort(F.collect_set("path")).alias("videos"))
    s = files.where(F.col("path").rlike(sensor)).groupBy(stem("path").alias("record_id")).agg(F.array_sort(F.collect_set("path")).alias("sensors"))
    j = v.join(s, "record_id", "full_outer")
    status = F.when(F.col("videos").isNull(), "missing_video").when(F.col("sensors").isNull(), "missing_strong_motion").when(F.size("sensors") > 1, "paired_split_sensor").otherwise("paired")
    return j.withColumn("status", status).orderBy(*natural_key(F.col("record_id")))


def pair_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer pairing of two tables of unique keys: key and status."""
    j = left.select(key, F.lit(True).alias("l")).join(right.select(key, F.lit(True).alias("r")), key, "full_outer")
    return j.select(key, F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").otherwise("paired").alias("status"))


def add_failures(history: DataFrame, new: DataFrame) -> DataFrame:
    """The failure history with new rows; exact repeats once, and rows without a time of attempt are ``legacy``."""
    return history.unionByName(new, allowMissingColumns=True).withColumn("attempt_utc", F.coalesce("attempt_utc", F.lit("legacy"))).dropDuplicates()


def unfinished(todo: DataFrame, done: DataFrame, key: str = "record_id", causal: int | None = None) -> DataFrame:
    """What is not done yet. Finished rows of another causal mode are an error."""
    if causal is not None and not done.where(F.col("causal") != causal).isEmpty():
        raise ValueError("finished rows are of another causal mode")
    return todo.join(done.select(key), key, "left_anti")


def manifest(pairs: DataFrame, peaks: DataFrame, root: str) -> DataFrame:
    """Pairs with their greatest peak, paths with the first occurrence of ``root`` cut."""
    redacted = lambda c: F.transform(c, lambda p: F.regexp_replace(p, "^" + root.replace(".", "\\."), "<root>"))
    p = peaks.groupBy("record_id").agg(F.max("pga").alias("pga"))
    return pairs.join(p, "record_id", "left").withColumns({"videos": redacted("videos"), "sensors": redacted("sensors")})


def write_run(tables: dict[str, DataFrame], folder: str, partition: str = "record_id", form: str = "parquet") -> None:
    """A run's tables, each in its own folder, in parts by record where they have one."""
    for name, df in tables.items():
        writer = df.write.format(form)
        (writer.partitionBy(partition) if partition in df.columns and form == "parquet" else writer).save(f"{folder}/{name}")


def config_hash(df: DataFrame, columns: list[str], out: str = "config_sha256") -> DataFrame:
    """Adds the SHA-256 of the columns as JSON in order of name."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256))


def check_blocks(window: int, step: int, future: tuple[int, int]) -> None:
    """A block of ``window`` samples that finalizes ``step`` sees [window - step, window - 1] ahead; anything else is a mistake."""
    if not 0 < step <= window or tuple(future) != (window - step, window - 1):
        raise ValueError(f"future context must be [{window - step}, {window - 1}]")


class ConfigError(ValueError):
    """A configuration that is incomplete or contradicts itself. ``faults`` lists all that is wrong with it."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(faults))
        self.faults = faults


#: The sections of a configuration.
SECTIONS = ("video", "tracker", "motion", "signal", "runtime", "scale", "pga")


def _setting(config: dict, path: str):
    """What stands at a dotted path, or None."""
    for name in path.split("."):
        config = config.get(name) if isinstance(config, dict) else None
    return config


def _numbers(value, count: int, kind: type) -> list:
    """``count`` numbers of a kind, or an error that says what was asked for."""
    listed = list(value) if isinstance(value, list | tuple) else [value]
    if len(listed) != count or any(isinstance(x, bool) or x is None for x in listed):
        raise ValueError
    out = [kind(x) for x in listed]
    if any(x != float(y) for x, y in zip(out, listed, strict=True)):
        raise ValueError
    return out


#: Settings that must hold: dotted path, how many numbers of which kind, whether it may be left out, what is asked of
#: them and of other settings, and that in words.
RULES = (
    ("tracker.window_len", 1, int, False, lambda x, _: x[0] >= 2, "a whole number from 2 on"),
    ("tracker.step", 1, int, False, lambda x, of: 1 <= x[0] <= (of("tracker.window_len") or x[0]), "a whole number from 1 to the window's length"),
    ("tracker.num_points", 1, int, False, lambda x, _: x[0] >= 1, "a whole number from 1 on"),
    ("tracker.source_timestamp_future_context_frames", 2, int, True, lambda x, of: _sees(of("tracker.window_len"), of("tracker.step"), x), "the two samples between which a block looks ahead: window less step, and window less one"),
    ("runtime.target_fps", 1, float, False, lambda x, _: x[0] > 0, "a number above 0"),
    ("runtime.max_queue_blocks", 1, int, False, lambda x, _: x[0] >= 1, "a whole number from 1 on"),
    ("signal.bandpass_hz", 2, float, False, lambda x, _: 0 <= x[0] < x[1], "two rising frequencies, none below 0"),
)


def _sees(window: int | None, step: int | None, future: list[int]) -> bool:
    try:
        check_blocks(window, step, tuple(future))
    except (TypeError, ValueError):
        return False
    return True


def config_faults(config: dict) -> list[str]:
    """All that is wrong with a configuration, rule by rule; nothing if it is fine."""
    if not isinstance(config, dict):
        return ["it maps no names to settings"]
    faults = [f"section {x} is not there" for x in SECTIONS if x not in config]
    whole = lambda path: int(v) if isinstance(v := _setting(config, path), int | float) and not isinstance(v, bool) else None
    for path, count, kind, optional, holds, words in RULES:
        value = _setting(config, path)
        if path.split(".")[0] not in config or (value is None and optional):
            continue
        try:
            fine = holds(_numbers(value, count, kind), whole)
        except (TypeError, ValueError):
            fine = False
        if not fine:
            faults.append(f"{path} is {value!r}, and should be {words}")
    return faults


def checked_config(config: dict) -> dict:
    """The configuration as it is, if no rule is broken."""
    if faults := config_faults(config):
        raise ConfigError(faults)
    return config


def read_config(spark: SparkSession, path: str) -> dict:
    """A checked configuration from a JSON file, or a YAML file (.yaml, .yml), on any file system that Spark reads."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        return checked_config(yaml.safe_load(text))
    return checked_config(json.loads(text))


def config_sha256(config: dict) -> str:
    """The SHA-256 of the configuration as JSON in order of name."""
    return hashlib.sha256(json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
