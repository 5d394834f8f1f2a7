"""Frame sequences, their metadata, manifests and messages as tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config import DEFAULT, Config
from ..functions.text import split_name

INI_KEYS = ("frameRate", "seqLength", "imWidth", "imHeight")
SCENE = (
    "sequence_id string, total_frames int, frame_rate int, frame_width int, frame_height int, altitude_m double, altitude_source string, weather string, "
    "weather_source string, scene_type string, time_of_day string, split string, frame_skip int, annotation_available boolean"
)


def find_root(sequence_id: str, data_root: str) -> str:
    """root/id, root/sequences/id, then the first root/*/sequences/id in order; none raises FileNotFoundError."""
    top = Path(data_root)
    for p in (top / sequence_id, top / "sequences" / sequence_id, *sorted(top.glob(f"*/sequences/{sequence_id}"))):
        if p.is_dir():
            return str(p)
    raise FileNotFoundError(f"sequence {sequence_id} not found below {data_root}")


def frame_folder(root: str) -> str:
    p = Path(root)
    return str(p / "img1" if (p / "img1").is_dir() else p)


@dataclass(frozen=True)
class Bundle:
    """Where the parts of a sequence are; ``ini`` and ``gt`` are None if there are none."""

    root: str
    image_dir: str
    ini: str | None
    gt: str | None


def bundle(sequence_id: str, data_root: str) -> Bundle:
    """The paths of a sequence; a folder without frames raises FileNotFoundError."""
    root = find_root(sequence_id, data_root)
    images = frame_folder(root)
    if not any(Path(images).glob("*.jpg")):
        raise FileNotFoundError(f"no frames in {images}")
    there = lambda p: str(p) if p.is_file() else None
    return Bundle(root, images, there(Path(root) / "seqinfo.ini"), there(Path(root) / "gt" / "gt.txt"))


def numbered(files: DataFrame, frame_skip: int = 1) -> DataFrame:
    """Rows (sequence_id, path, ...) with ``frame_id``: every n-th file of a sequence in path order; ids are file numbers less one."""
    if frame_skip <= 0:
        raise ValueError("frame_skip must be positive")
    place = F.row_number().over(W.partitionBy("sequence_id").orderBy("path"))
    kept = files.withColumn("position", place).where((F.col("position") - 1) % frame_skip == 0).drop("position")
    return kept.withColumn("frame_id", F.regexp_extract("path", r"(\d+)\.jpg$", 1).cast("int") - 1)


def discover(spark: SparkSession, data_root: str) -> DataFrame:
    """(sequence_id, root, kind, path) of all sequences below a root on any storage that Spark reads; kind is frame, ini or gt.

    A sequence lies in root/id, root/sequences/id or root/*/sequences/id; of several the first in this
    order counts, as with ``find_root``; frames are those in img1, if there is one.  One listing, and no
    content is read; the plan is the same for one sequence and for a million.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.jpg,seqinfo.ini,gt.txt}").load(data_root).select("path")
    top = spark._jvm.org.apache.hadoop.fs.Path(data_root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toUri().toString()
    start = F.length(F.regexp_replace(F.lit(top), "^file:/+", "file:/"))
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    files = files.withColumn("below", F.col("path").substr(start + 2, F.length("path")))
    layout = lambda k: F.regexp_extract("below", _LAYOUT, k)
    files = files.where(F.col("below").rlike(_LAYOUT)).select("path", layout(1).alias("above"), layout(2).alias("sequence_id"), layout(3).alias("inner"), layout(4).alias("file"))
    kind = F.when(F.col("file") == "seqinfo.ini", "ini").when((F.col("file") == "gt.txt") & (F.col("inner") == "gt/"), "gt").when(F.col("file").endswith(".jpg") & F.col("inner").isin("", "img1/"), "frame")
    files = files.withColumn("kind", kind).where("kind is not null and (kind <> 'ini' or inner = '')")
    order = F.when(F.col("above") == "", 0).when(F.col("above") == "sequences/", 1).otherwise(2)
    frame = F.when(F.col("kind") == "frame", F.struct(order.alias("order"), "above"))
    mine = W.partitionBy("sequence_id")
    files = files.withColumns({"first": F.min(frame).over(mine), "img1": F.max(F.when((F.col("kind") == "frame") & (F.col("inner") == "img1/"), F.struct("above"))).over(W.partitionBy("sequence_id", "above"))})
    files = files.where((F.col("first.above") == F.col("above")) & ((F.col("kind") != "frame") | (F.col("img1").isNull()) | (F.col("inner") == "img1/")))
    root = F.concat(F.lit(top), F.lit("/"), "above", "sequence_id")
    return files.select("sequence_id", root.alias("root"), "kind", "path")


#: above, sequence, inner folder and file of a path below the root
_LAYOUT = r"^((?:[^/]+/)?sequences/|)([^/]+)/((?:img1|gt)/|)([^/]+)$"


def all_frames(spark: SparkSession, data_root: str, frame_skip: int = 1) -> DataFrame:
    """(sequence_id, path, frame_id) of every sequence below a root."""
    return numbered(discover(spark, data_root).where("kind = 'frame'").select("sequence_id", "path"), frame_skip)


def all_annotations(spark: SparkSession, data_root: str) -> DataFrame:
    """Boxes of the ground-truth files of all sequences below a root: one scan of all files."""
    from ..operators import lifecycle

    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "gt.txt").text(data_root)
    lines = lines.select("value", F.regexp_replace(lines.metadataColumn("_metadata")["file_path"], "^file:/+", "file:/").alias("path"))
    known = discover(spark, data_root).where("kind = 'gt'").select("sequence_id", "path")
    return lifecycle.annotations(annotation_rows(lines.join(known, "path").select("sequence_id", "value")))


def readable(files: DataFrame) -> DataFrame:
    """``files`` (path, content, ...); a file that begins or ends like no JPEG, such as one cut short, raises (Spark leaves out files without a byte)."""
    c = F.col("content")
    whole = (F.hex(F.substring(c, 1, 2)) == "FFD8") & F.hex(F.substring(c, -64, 64)).contains("FFD9")
    wrong = F.raise_error(F.concat(F.lit("unreadable frame: "), "path")).cast("binary")
    return files.withColumn("content", F.when(whole, c).otherwise(wrong))


def frames(spark: SparkSession, root: str, sequence_id: str, frame_skip: int = 1, pixels: bool = False, checked: bool = False) -> DataFrame:
    """(sequence_id, frame_id, path[, content]) of a sequence's files; ``checked`` frames must be ``readable``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(frame_folder(root))
    kept = numbered(files.withColumn("sequence_id", F.lit(sequence_id)), frame_skip)
    kept = readable(kept) if pixels and checked else kept
    return kept.select("sequence_id", "frame_id", "path", *(["content"] if pixels else []))


def video_frames(index: DataFrame, frame_skip: int = 1, cfg: Config = DEFAULT) -> DataFrame:
    """Decoded frames (path, frame_idx, fps, ...) of video files as frame rows.

    The id decides which frames stay (``frame_idx % n = 0``), the file's stem is the sequence, an unknown rate is
    the default one.  Decoding is the caller's: any reader that yields these columns will do.
    """
    if frame_skip <= 0:
        raise ValueError("frame_skip must be positive")
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(float(cfg.vision.default_fps)))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    rows = index.where(F.col("frame_idx") % frame_skip == 0)
    return rows.withColumns({"sequence_id": stem, "frame_id": F.col("frame_idx"), "frame_rate": rate.cast("int"), "frame_skip": F.lit(frame_skip)}).drop("frame_idx", "fps")


def jpeg_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the frame header of a JPEG; None if it has none."""
    at = 2
    while content and at + 9 < len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + size
    return None


def with_size(files: DataFrame) -> DataFrame:
    """Rows with ``content`` and the frame's ``width`` and ``height``, null where the header cannot be read."""

    def run(batches):
        for b in batches:
            sizes = [jpeg_size(x) or (None, None) for x in b.column(b.schema.get_field_index("content")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1))], names=[*b.schema.names, "width", "height"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("width", IntegerType()), StructField("height", IntegerType())]))


def infer(sized: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Metadata of sequences without an ini file, from (sequence_id, path, width, height): frames counted, size of the first, default rate.

    A first frame of unknown size raises an error.
    """
    s = sized.groupBy("sequence_id").agg(F.count(F.lit(1)).cast("int").alias("total_frames"), F.min_by(F.struct("path", "width", "height"), "path").alias("f"))
    known = lambda c: F.coalesce(F.col(f"f.{c}"), F.raise_error(F.concat(F.lit("cannot read "), F.col("f.path"))).cast("int")).alias(f"frame_{c}")
    return s.select("sequence_id", "total_frames", F.lit(cfg.vision.default_fps).alias("frame_rate"), known("width"), known("height"))


def seqinfo_rows(lines: DataFrame) -> DataFrame:
    """(sequence_id, total_frames, frame_rate, frame_width, frame_height) from rows (sequence_id, n, value): the lines of many ini files.

    Only keys below a ``[Sequence]`` line, and above the next section, count; a sequence that lacks
    the section or an integer key raises an error that names it.
    """
    text = F.trim("value")
    section = F.last(F.when(text.rlike(r"^\[.*\]$"), text), ignorenulls=True).over(W.partitionBy("sequence_id").orderBy("n"))
    pairs = lines.select("sequence_id", section.alias("section"), F.trim(F.substring_index(text, "=", 1)).alias("key"), F.expr("try_cast(trim(substr(trim(value), instr(trim(value), '=') + 1)) AS int)").alias("number"))
    inside = F.col("section") == "[Sequence]"
    found = pairs.groupBy("sequence_id").agg(F.count_if(inside).alias("n"), *(F.max(F.when(inside & (F.col("key") == k), F.col("number"))).alias(k) for k in INI_KEYS))
    missing = F.concat_ws(", ", *(F.when(F.col(k).isNull(), F.lit(k)) for k in INI_KEYS))
    problem = F.when(F.col("n") == 0, F.lit("missing section [Sequence]")).when(missing != "", F.concat(F.lit("missing or not integer: "), missing))
    names = {"seqLength": "total_frames", "frameRate": "frame_rate", "imWidth": "frame_width", "imHeight": "frame_height"}
    checked = lambda k: F.when(problem.isNotNull(), F.raise_error(F.concat_ws(": ", "sequence_id", problem)).cast("int")).otherwise(F.col(k))
    return found.select("sequence_id", *(checked(k).alias(v) for k, v in names.items()))


#: Fixed value: the name that metadata files of the dataset go by.
META_FILE = "visdrone_sequence_meta.json"


def meta_path(data_root: str, configured: str | None = None) -> str | None:
    """The configured metadata file, else the nearest one in the data folder or a folder above it."""
    if configured:
        return configured
    top = Path(data_root)
    return next((str(d / META_FILE) for d in (top, *top.parents) if (d / META_FILE).is_file()), None)


def meta_lookup(spark: SparkSession, path: str | None) -> DataFrame:
    """(sequence_id, altitude_m, weather, scene_type, time_of_day) of a metadata file; values that are no objects are skipped.

    No file gives no rows; a file that is no object raises ValueError.
    """
    fields = "altitude_m double, weather string, scene_type string, time_of_day string"
    empty = spark.createDataFrame([], f"sequence_id string, {fields}")
    if path is None:
        return empty
    text = spark.read.text(path, wholetext=True)
    if not text.where(F.trim("value", F.lit(" \t\r\n")).startswith("{")).count():
        raise ValueError("sequence metadata must be an object")
    each = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("sequence_id", "meta")).where(F.col("meta").startswith("{"))
    return each.select("sequence_id", F.from_json("meta", fields).alias("m")).select("sequence_id", "m.*")


def seqinfo(spark: SparkSession, path: str) -> dict[str, int]:
    """The integer keys of a [Sequence] section; a missing section or key raises ValueError that names it."""
    lines = [r[0].strip() for r in spark.read.text(path).collect()]  # a few lines
    if "[Sequence]" not in lines:
        raise ValueError("missing section [Sequence]")
    pairs = dict(x.split("=", 1) for x in lines[lines.index("[Sequence]") + 1 :] if "=" in x)
    missing = [k for k in INI_KEYS if not pairs.get(k, "").strip().lstrip("-").isdigit()]
    if missing:
        raise ValueError(f"missing or not integer: {', '.join(missing)}")
    return {k: int(pairs[k]) for k in INI_KEYS}


def scenes(sequences: DataFrame, lookup: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """One scene row per sequence from (sequence_id, total_frames, frame_rate, frame_width, frame_height, path, annotated).

    lookup: (sequence_id, altitude_m, weather, scene_type, time_of_day); what it lacks comes from the defaults.
    """
    s, d = sequences, cfg.scene
    cols = {"altitude_m": "double", "weather": "string", "scene_type": "string", "time_of_day": "string"}
    if lookup is None:
        found = s.select("*", *(F.lit(None).cast(t).alias(f"l_{c}") for c, t in cols.items()))
    else:
        found = s.join(lookup.select("sequence_id", *(F.col(c).cast(t).alias(f"l_{c}") for c, t in cols.items())), "sequence_id", "left")
    return found.select(
        "sequence_id", "total_frames", F.coalesce("frame_rate", F.lit(cfg.vision.default_fps)).alias("frame_rate"), "frame_width", "frame_height",
        F.coalesce("l_altitude_m", F.lit(d.altitude_m)).alias("altitude_m"), F.when(F.col("l_altitude_m").isNotNull(), "lookup").otherwise("estimated").alias("altitude_source"),
        F.coalesce("l_weather", F.lit(d.weather)).alias("weather"), F.when(F.col("l_weather").isNotNull(), "lookup").otherwise(d.weather_source).alias("weather_source"),
        F.coalesce("l_scene_type", F.lit(d.scene_type)).alias("scene_type"), F.coalesce("l_time_of_day", F.lit(d.time_of_day)).alias("time_of_day"),
        split_name(F.col("path")).alias("split"), F.lit(cfg.vision.frame_skip).alias("frame_skip"), F.col("annotated").alias("annotation_available"),
    )


def manifest_ids(data) -> list[str]:
    """The ids of a manifest: a list or {"sequence_ids": [...]}; anything else raises ValueError."""
    ids = data.get("sequence_ids") if isinstance(data, dict) else data
    if not isinstance(ids, list):
        raise ValueError("a manifest is a list or an object with sequence_ids")
    return [str(x) for x in ids]


def manifest(path: str) -> list[str]:
    return manifest_ids(json.loads(Path(path).read_text()))


def manifest_rows(texts: DataFrame) -> DataFrame:
    """``texts`` (value, ...) with a row ``sequence_id`` for each id of each manifest text, parsed by Spark; a text that is none raises."""
    as_list, as_object = F.from_json("value", "array<string>"), F.from_json("value", "sequence_ids array<string>")["sequence_ids"]
    starts = lambda c: F.trim("value", F.lit(" \t\r\n")).startswith(c)
    wrong = F.raise_error(F.lit("a manifest is a list or an object with sequence_ids")).cast("array<string>")
    ids = F.coalesce(F.when(starts("["), as_list).when(starts("{"), as_object), wrong)
    return texts.withColumn("sequence_id", F.explode(ids)).drop("value")


def messages(spark: SparkSession, path: str, sequence_id: str, lines: bool = False) -> DataFrame:
    """Messages of a file that is one list; with ``lines``, of files with a list a line, which are split like any text."""
    if spark.read.text(path, wholetext=not lines).where(~F.trim("value", F.lit(" \t\r\n")).startswith("[")).head(1):
        raise ValueError("a message file is a list")
    schema = "message_id string, sender string, text string, timestamp long"
    return spark.read.schema(schema).json(path, multiLine=not lines).withColumn("sequence_id", F.lit(sequence_id)).where("message_id is not null")


def evaluation(spark: SparkSession, path: str, fields: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """predictions and ground_truths of a payload, each with its list position; fields: the rows' schema.  ``lines``: a payload a line."""
    one = spark.read.schema(f"predictions array<struct<{fields}>>, ground_truths array<struct<{fields}>>").json(path, multiLine=not lines)
    rows = lambda c: one.select(F.posexplode(c).alias("pos", "r")).select(F.col("pos").cast("long").alias("pos"), "r.*")
    return rows("predictions"), rows("ground_truths")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """The ``cases`` of a query evaluation, each with its list position; rows are kept as JSON texts, order-free to compare."""
    text = "first_attempt_cypher string, final_cypher string, expected_cypher string, expected_results array<string>, actual_results array<string>"
    one = spark.read.schema(f"cases array<struct<{text}>>").json(path, multiLine=True)
    return one.select(F.posexplode("cases").alias("pos", "c")).select(F.col("pos").cast("long").alias("pos"), "c.*")


def annotation_rows(lines: DataFrame) -> DataFrame:
    """Ground-truth lines (sequence_id, value) as columns; what is no line of ten integers is dropped."""
    names = ("frame", "target", "left", "top", "width", "height", "score", "category", "truncation", "occlusion")
    parts = lines.select("sequence_id", F.split(F.regexp_replace("value", r"\s|,\s*$", ""), ",").alias("p")).where(F.size("p") == len(names))
    rows = parts.select("sequence_id", *(F.expr(f"try_cast(get(p, {i}) AS int)").alias(n) for i, n in enumerate(names)))
    return rows.dropna(subset=list(names))


def annotations(spark: SparkSession, bundles: dict[str, str]) -> DataFrame:
    """Boxes of the ground-truth files of sequences (id -> path)."""
    from ..operators import lifecycle

    parts = [spark.read.text(path).select(F.lit(name).alias("sequence_id"), "value") for name, path in bundles.items()]  # one small file for each sequence
    return lifecycle.annotations(annotation_rows(reduce(DataFrame.unionByName, parts)))


def few_shot(text: str, start: str, end: str) -> str:
    """The part of a document between two headers; missing headers raise ValueError."""
    if start not in text:
        raise ValueError(f"header not found: {start}")
    rest = text[text.index(start) :]
    return rest[: rest.index(end)] if end in rest else rest
