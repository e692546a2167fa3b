"""Reading and writing the files of datasets, results and evaluations, with fixed schemas."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlogic.session import ship_package

INSTANCE = (
    "id string, description string, query_relation string, query_type string, label string, reasoning_steps string, detailed_relations string, "
    "ascii struct<simple:string,grid:string,panel:string>, terminology_used string, num_components int, num_relations int, "
    "is_directly_stated boolean, has_unique_layout boolean, ambiguous_stages int"
)
RESULT = "test_id string, model_output string, turn1_output string, error string"


def read_jsonl(spark: SparkSession, path: str, schema: str = INSTANCE) -> DataFrame:
    """One JSON object per line; blank lines are none; lines that don't parse have nulls. Never inferred, so a column of nulls stays."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_index(spark: SparkSession, path: str, schema: str = INSTANCE, key: str = "id") -> DataFrame:
    """Of rows with one id the last of the file, without a global sort: a maximum over (file, block, row in block)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), "f", "b", "k")
    last = parsed.groupBy(f"r.{key}").agg(F.max_by("r", F.struct("f", "b", "k")).alias("r"))
    return last.select("r.*")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A header line is skipped."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """(task, path, RESULT) of all result files under a folder, found by their names; a folder of such a name, as Spark writes it, is one too."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(globless(root)).select("value", F.col("_metadata.file_path").alias("path"))
    return raw.select(result_task(F.col("path")).alias("task"), "path", F.from_json("value", RESULT).alias("r")).where("task <> ''").select("task", "path", "r.*")


def result_task(path: Column) -> Column:
    """The task, as a capital, of a result file's path; '' for other files."""
    return F.upper(F.regexp_extract(path, r"(?i)task_([a-h])(?:_results)?\.jsonl(?:/[^/]*)?$", 1))


def result_file_of(path: Column) -> Column:
    """(task, folder, file) of a path below the results' root: a folder of a result file's name, as Spark writes it, is one file."""
    file = F.regexp_replace(path, r"(?i)(\.jsonl)/[^/]*$", "$1")
    return F.struct(result_task(path).alias("task"), F.regexp_extract(file, r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), file.alias("file"))


def result_names(spark: SparkSession, root: str) -> DataFrame:
    """(task, folder, file) of all result files under a folder; files are listed, not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(globless(root)).select("path")
    return found.select(result_file_of(below(spark, F.col("path"), root)).alias("f")).where("f.task <> ''").select("f.*").distinct()


def result_files(spark: SparkSession, root: str) -> DataFrame:
    """(task, folder, file, at, RESULT) of all result files under a folder: the folder below root ('' for root itself), the file below root, and the line's place
    in it, (part, block, line), which orders the lines of a file. Blank lines are none; lines that don't parse have nulls."""
    everything = lambda kind: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").load(globless(root))
    # A path is taken apart once a file: files are listed, not read.
    own = everything("binaryFile").select(F.col("_metadata.file_path").alias("part")).distinct()
    names = own.select("part", result_file_of(below(spark, F.col("part"), root)).alias("f")).where("f.task <> ''")
    place = F.struct(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = everything("text").select("value", place.alias("at"))
    named = lines.where(F.trim("value") != "").join(F.broadcast(names), F.col("at.part") == F.col("part"))
    return named.select("f.*", "at", F.from_json("value", RESULT).alias("r")).select("task", "folder", "file", "at", "r.*")


def discover_runs(results: DataFrame, root: str) -> DataFrame:
    """The folders right below root that have results."""
    own = F.split(below(results.sparkSession, F.col("path"), root), "/")
    return results.where(F.size(own) > 1).select(F.get(own, F.lit(0)).alias("run")).distinct()


def evaluated_runs(spark: SparkSession, root: str) -> list[str]:
    """The folders right below root that hold outputs/evaluation/evaluation_summary.json, in order."""
    return sorted({_child(spark, root, f) for f in listed(spark, f"{globless(root.rstrip('/'))}/*/outputs/evaluation/evaluation_summary.json")})


def _child(spark: SparkSession, root: str, path: str) -> str:
    """The name right below root on the way to path."""
    (at, store), (to, _) = _at(spark, root), _at(spark, path)
    folder = store.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    return store.makeQualified(to).toUri().getPath().removeprefix(folder).split("/", 1)[0]


def task_of(name):
    """The task of an evaluation's file name: E and G with their order."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^task_", ""), r"_evaluation(?:\.json)?$", "")
    letter = F.lower(F.substring_index(stem, "_", 1))
    order = F.regexp_extract(stem, "(answer_first|ascii_first)", 1)
    return F.when(letter.isin("e", "g") & (order != ""), F.concat_ws("_", letter, order)).otherwise(letter)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON, one object per line, nulls left out."""
    rows.write.mode("overwrite").json(path)


def write_text(rows: DataFrame, path: str) -> None:
    """S18."""
    rows.write.mode("overwrite").text(path)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def globless(name: str) -> str:
    """A file's name as a pattern that only it matches."""
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", name)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern matches, in order. Folders of pattern itself must be written with globless() if they hold signs of patterns."""
    at, store = _at(spark, pattern)
    return sorted(str(f.getPath().toString()) for f in store.globStatus(at) or [])


def move(spark: SparkSession, source: str, target: str) -> None:
    """A file or folder to another place of the same store, instead of what is there."""
    (at, store), (to, _) = _at(spark, source), _at(spark, target)
    store.delete(to, True)
    if not store.rename(at, to):
        raise OSError(f"could not move {source} to {target}")


def is_folder(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.getFileStatus(at).isDirectory()


def make_folder(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.delete(at, True)


def decoded(path: Column) -> Column:
    """A path of _metadata without its percent signs."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def below(spark: SparkSession, path: Column, root: str) -> Column:
    """What follows the folder root in a path of _metadata; null for paths elsewhere."""
    at, store = _at(spark, root)
    folder = store.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    own = F.regexp_replace(decoded(path), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.when(F.startswith(own, F.lit(folder)), F.substring(own, len(folder) + 1, 1 << 30))


def read_file(spark: SparkSession, path: str) -> str:
    """A small file's text, from any store that Spark reads."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def write_file(spark: SparkSession, path: str, content: str | bytes) -> None:
    """A small file, such as a summary, written by the driver to any store that Spark writes."""
    at, store = _at(spark, path)
    out = store.create(at, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def text_field(output: Column, name: str) -> Column:
    """A field of a model's JSON output as text; null if that is no JSON object or lacks it."""
    return F.try_variant_get(F.try_parse_json(output), f"$.{name}", "string")


def _members(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(data.as_buffer()), mode="r:*") as archive:
                    for member in archive:
                        if member.isfile() and re.search(pattern, member.name):
                            text = archive.extractfile(member).read().decode("utf-8", "replace")
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member.name]), pa.array([text], pa.string())], names=["archive", "member", "text"])

    return run


def read_tar(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(archive, member, text) of the members of tar archives, packed or not, whose names match; an archive is a task's, a member a batch. Fetching is left to whoever
    has a network."""
    ship_package(spark)
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInArrow(_members(pattern), "archive string, member string, text string")


def copy_without(spark: SparkSession, source: str, target: str, held_out: DataFrame) -> None:
    """A JSONL file's lines as they are, without those whose id is held out."""
    lines = spark.read.text(source).where(F.trim("value") != "").withColumn("id", F.get_json_object("value", "$.id"))
    lines.join(held_out.select("id").distinct(), "id", "left_anti").select("value").write.mode("overwrite").text(target)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, value): the lines of files, numbered from 0 in each, blank ones too. However many splits a file is read in: each split counts its lines, counts are
    added up over the splits before, and a line adds its place in its own."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a split
    placed = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(placed, ["file", "block"]).select(decoded(F.col("file")).alias("file"), (F.col("shift") + F.col("k")).alias("ord"), "value")


#: What becomes of a line that is blank, or that is no JSON object of the schema.
BLANKS, BAD = ("skip", "fail"), ("fail", "nulls", "drop")


def parsed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, ord, value, row, blank, bad): JSON lines with their places; bad: not blank, and no JSON object of the schema."""
    read = F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
    blank = F.trim("value") == ""
    own = numbered_lines(spark, path).select("*", F.explode(F.array(read)).alias("row"), blank.alias("blank"))
    return own.withColumn("bad", ~F.col("blank") & (F.col("row").isNull() | F.col("row.__bad").isNotNull()))


def checked_jsonl(spark: SparkSession, path: str, schema: str = INSTANCE, blanks: str = "skip", bad: str = "fail") -> DataFrame:
    """S1/S2 by the reader's mode: blank lines are skipped, or an error; lines that don't parse are an error, rows of nulls, or dropped. An error names the file and the line,
    numbered from 1, and no row goes without its check, even where rows are only counted."""
    if blanks not in BLANKS or bad not in BAD:
        raise ValueError(f"blanks is one of {BLANKS}, bad of {BAD}")
    rows = parsed_lines(spark, path, schema)
    at = F.concat("file", F.lit(", line "), (F.col("ord") + 1).cast("string"))
    raised = lambda name: F.raise_error(F.concat(F.lit(f"a {name} line: "), at)).cast("boolean")
    # One condition, so that no line is left out before it is checked.
    kept = rows.where(F.when(F.col("blank"), raised("blank") if blanks == "fail" else F.lit(False)).when(F.col("bad"), raised("bad") if bad == "fail" else F.lit(bad == "nulls")).otherwise(True))
    fields = [f"row.{quoted(f.name)}" for f in rows.schema["row"].dataType if f.name != "__bad"]
    return kept.select(*fields)


def quarantine(spark: SparkSession, path: str, sink: str, schema: str = INSTANCE) -> DataFrame:
    """The rows of the lines that parse. Those that don't go to a sink as JSON lines (file, line, value), the line numbered from 1; blank ones go nowhere."""
    rows = parsed_lines(spark, path, schema)
    rows.where("bad").select("file", (F.col("ord") + 1).alias("line"), "value").write.mode("overwrite").json(sink)
    return rows.where(~F.col("blank") & ~F.col("bad")).select(*(f"row.{quoted(f.name)}" for f in rows.schema["row"].dataType if f.name != "__bad"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def running_total(rows: DataFrame, value: Column, to: str, span: int = 100_000) -> DataFrame:
    """Rows (file, ord, ...) with the sum of value up to each, by file. A file is cut into spans of ord; each span adds up its own rows, and what came before is a sum over spans."""
    cut = rows.withColumns({"__v": value, "__span": F.floor(F.col("ord") / span)})
    spans = cut.groupBy("file", "__span").agg(F.sum("__v").alias("__own"))
    before = F.coalesce(F.sum("__own").over(Window.partitionBy("file").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a span
    placed = spans.select(F.col("file").alias("__file"), F.col("__span").alias("__at"), before.alias("__before"))
    own = cut.withColumn("__own", F.sum("__v").over(Window.partitionBy("file", "__span").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    joined = own.join(placed, own["file"].eqNullSafe(placed["__file"]) & own["__span"].eqNullSafe(placed["__at"]))
    return joined.withColumn(to, F.col("__before") + F.col("__own")).drop("__v", "__span", "__own", "__file", "__at", "__before")


def babi_stories(lines: DataFrame, span: int = 100_000) -> DataFrame:
    """(file, ord, passage, question, answer) of numbered lines (file, ord, value): number 1 begins a story; a line with tabs asks about
    the lines before it. A story is a group; a file is not, as stories are numbered span by span."""
    number = F.regexp_extract("value", r"^(\d+) ", 1).cast("int")
    text = F.regexp_replace("value", r"^\d+ ", "")
    told = running_total(lines.select("file", "ord", number.alias("number"), text.alias("text")), F.when(F.col("number") == 1, 1).otherwise(0), "story", span)
    before = Window.partitionBy("file", "story").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    with_passage = told.withColumn("passage", F.array_join(F.collect_list(F.when(~F.contains("text", F.lit("\t")), F.trim("text"))).over(before), " "))
    parts = F.split("text", "\t")
    words = F.array_join(F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda d: F.when(F.trim(d) == "n", "north").when(F.trim(d) == "s", "south").when(F.trim(d) == "e", "east").when(F.trim(d) == "w", "west").otherwise(F.trim(d))), " ")
    return with_passage.where(F.contains("text", F.lit("\t"))).select("file", "ord", "passage", F.trim(F.get(parts, F.lit(0))).alias("question"), words.alias("answer"))


@dataclass
class RunConfig:
    """What a run was made with."""

    run_id: str = "unknown"
    model_name: str = "unknown"
    dataset: str = ""
    seed: int = 42
    args: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> RunConfig:
        given = json.loads(text)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise TypeError(f"unknown keys: {sorted(unknown)}")
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)
