"""Strict readers. A schema that doesn't fit stops the job with the place; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet files below ``path``. With ``schema``, names, order and types must be exactly these; with ``columns`` these must be there."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    if schema is not None and [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"{path} has {df.schema.simpleString()}, expected {schema.simpleString()}")
    if columns is not None:
        absent = set(columns) - set(df.columns)
        if absent:
            raise ValueError(f"{path} has no column {', '.join(sorted(absent))}")
        df = df.select(*columns)
    return df


def jsonl(spark: SparkSession, path: str, schema: T.StructType, exact_keys: bool = True) -> DataFrame:
    """JSON lines of objects; blank lines are skipped. A line that is no object of the types stops the job with its file and text;
    with ``exact_keys`` so does one whose keys aren't exactly the schema's."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_file", F.input_file_name())
    parsed = lines.withColumn("_o", F.from_json("value", schema, {"mode": "FAILFAST"})).withColumn("_k", F.json_object_keys("value"))
    good = F.col("_o").isNotNull() & F.col("_k").isNotNull()
    if exact_keys:
        good = good & (F.array_sort("_k") == F.array(*[F.lit(k) for k in sorted(schema.fieldNames())]))
    where = F.concat(F.lit("bad line in "), F.col("_file"), F.lit(": "), F.substr(F.col("value"), F.lit(1), F.lit(120)))
    return parsed.where(F.when(good, F.lit(True)).otherwise(F.raise_error(where).cast("boolean"))).select("_o.*")


def csv(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",") -> DataFrame:
    """A CSV file whose header must be exactly the schema's names, in order."""
    first = spark.read.text(path).limit(1).collect()
    header = [c.strip('"') for c in first[0][0].split(separator)] if first else []
    if header != schema.fieldNames():
        raise ValueError(f"{path} has header {header}, expected {schema.fieldNames()}")
    return spark.read.option("header", True).option("sep", separator).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).schema(schema).csv(path)


def lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Lines that aren't blank or comments, trimmed: value."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith(comment))


def delimited_field(spark: SparkSession, path: str, field: int, separator: str = r"\|") -> DataFrame:
    """One field (from 1) of delimited lines, trimmed, blank ones left out: value."""
    return spark.read.text(path).select(F.trim(F.try_element_at(F.split("value", separator), F.lit(field))).alias("value")).where("value is not null and value <> ''")


def any_text(spark: SparkSession, paths: Sequence[str], text_field: str = "text") -> DataFrame:
    """Texts of .txt (a file a text), .jsonl and .parquet sources as one table: source, text."""
    parts = []
    for p in paths:
        if p.endswith(".txt"):
            d = spark.read.text(p, wholetext=True).select(F.col("value").alias("text"))
        elif p.endswith((".jsonl", ".json")):
            d = spark.read.schema(f"`{text_field}` string").json(p).select(F.col(text_field).alias("text"))
        elif p.endswith(".parquet"):
            d = spark.read.parquet(p).select(F.col(text_field).cast("string").alias("text"))
        else:
            raise ValueError(f"{p}: no reader for this kind of file")
        parts.append(d.select(F.lit(p.rsplit("/", 1)[-1]).alias("source"), "text"))
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def stepped_files(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """JSON lines of files named ``<run>/.../step-<n>.jsonl`` with run_id and checkpoint_step from the path."""
    d = spark.read.schema(schema).json(glob).withColumn("_f", F.input_file_name())
    return d.withColumn("run_id", F.regexp_extract("_f", r"/([^/]+)/[^/]+/step-\d+\.\w+$", 1)).withColumn("checkpoint_step", F.regexp_extract("_f", r"step-(\d+)\.\w+$", 1).cast("int")).drop("_f")


def run_parts(run_id: str = "run_id") -> list:
    """model, condition, lr and seed of a run id ``model__condition__lr-x__seed-n``; null where a part is missing."""
    p = lambda i: F.try_element_at(F.split(run_id, "__"), F.lit(i))
    return [p(1).alias("model"), p(2).alias("condition"), F.regexp_extract(run_id, r"__lr-([0-9.e-]+)", 1).try_cast("double").alias("lr"), F.regexp_extract(run_id, r"__seed-(\d+)", 1).try_cast("int").alias("seed")]


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Dense ids from 0 in the order of columns that identify a row, by running sums over sorted ranges."""
    from windrow.operators.prefix import running

    return running(df, [F.col(c) for c in order], {name: "1"}).withColumn(name, F.col(name) - 1)


def arrow_ipc(spark: SparkSession, path: str, schema: T.StructType, rows: int | None = None) -> DataFrame:
    """Rows of Arrow IPC files, streams or files proper, with exactly the columns of ``schema``; a file with others raises.

    Files are read on the executors, each by one task; ``rows`` cuts their batches into slices of that many, which are
    views of them, so that a consumer sees small batches.
    """
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    reader = pa.ipc.open_stream(content)
                except pa.ArrowInvalid:
                    reader = pa.ipc.open_file(content).read_all().to_reader()
                if reader.schema.names != names:
                    raise ValueError(f"{name}: columns {reader.schema.names}, expected {names}")
                for b in reader:
                    for at in range(0, b.num_rows, rows or max(1, b.num_rows)):
                        yield b.slice(at, rows or b.num_rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, schema)


def profiled_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """file, n_rows, n_bad (no JSON object), n_repeated (rows beyond the first of a key) and digest of each JSON-lines file below
    ``path``, at any depth; a digest is of the file's set of lines."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).where(F.trim("value") != "").select(F.input_file_name().alias("file"), "value")
    v = F.try_parse_json("value")
    sound = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    mark = F.conv(F.substring(F.md5("value"), 1, 15), 16, 10).cast("decimal(38,0)")
    rows = d.select("file", sound.alias("_ok"), F.try_variant_get(v, f"$.{key}", "string").alias("_key"), mark.alias("_mark"))
    keyed = rows.groupBy("file", "_key").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_ok")).alias("_bad"), F.sum("_mark").alias("_mark"))
    return keyed.groupBy("file").agg(F.sum("_n").alias("n_rows"), F.sum("_bad").alias("n_bad"), F.sum(F.when(F.col("_key").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("n_repeated"), F.sum("_mark").cast("string").alias("digest"))


def envelopes(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """file, state ('sound', 'no object' or 'empty') and the named top-level fields as text of each JSON file, one a file; files
    that can't be parsed stay, with their state."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    v = F.try_parse_json("value")
    sound = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    state = F.when(F.trim("value") == "", "empty").when(sound, "sound").otherwise("no object")
    return d.select("file", state.alias("state"), *[F.when(sound, F.try_variant_get(v, f"$.{f}", "string")).alias(f) for f in fields])
