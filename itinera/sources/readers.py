"""Readers (A1, A2, A5-A8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itinera.plans.tables import TableStore

STATION_SCHEMA = ("uic_code string, station_name string, station_name_normalized string, "
                  "city_name string, city_name_normalized string, latitude double, "
                  "longitude double, segment_drg string")
CONNECTION_SCHEMA = ("origin_uic string, destination_uic string, distance_km double, "
                     "duration_minutes int, line_code string, line_status string, "
                     "origin_name string, destination_name string, trip_count double, source string")
GTFS_COLUMNS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_short_name string, route_long_name string",
    "trips": "trip_id string, route_id string",
    "stop_times": "trip_id string, departure_time string, stop_id string, stop_sequence bigint",
}
GAZETTEER_SCHEMA = "cities array<string>, stations array<string>, aliases map<string,array<string>>"
LABELLED_SCHEMA = ("tokens array<string>, labels array<string>, metadata struct<sentenceID:string,"
                   "origin:string,destination:string,is_valid:int,difficulty:string,category:string>")


_CSV = {"header": True, "quote": '"', "escape": '"'}


def _csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, quotes doubled inside quotes; missing paths raise.

    A file is read in splits, also where ``multi_line`` allows line breaks inside quotes.
    """
    return _csv_records(spark, path) if multi_line else spark.read.options(**_CSV).csv(path)


def _csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files whose quoted values may hold line breaks, without reading a file in one task.

    A line starts a record if the quotes before it in the file are even. Splits
    are counted on their own, their parities are summed along the file (one row a
    split), and a window over each split places its lines; a record that runs
    into the next splits is put together from its lines. Files in which every
    line has an even count are read as usual, after one scan. Carriage returns before a
    line break go, as with the common reader. A quote inside a value that is not
    quoted is an error of the file and shifts what follows; an open quote takes
    the rest of the file.
    """
    lines = _raw_lines(spark, path).withColumn("line", F.regexp_replace("line", "\\r$", "")).withColumn(
        "odd", (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2)
    if lines.filter(F.col("odd") == 1).isEmpty():
        return spark.read.options(**_CSV).csv(path)
    store = TableStore(spark, "records")
    split, file = Window.partitionBy("path", "block").orderBy("row"), Window.partitionBy("path").orderBy("block")
    so_far = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    carried = lines.groupBy("path", "block").agg(F.sum("odd").alias("odd"), F.min("row").alias("first")).select(
        "path", "block", F.coalesce(F.sum("odd").over(so_far(file, -1)), F.lit(0)).alias("carried"), "first")
    starts = F.when((F.col("carried") + F.coalesce(F.sum("odd").over(so_far(split, -1)), F.lit(0))) % 2 == 0, F.col("row"))
    placed = (lines.join(carried, ["path", "block"]).withColumn("starts", starts)
              .withColumn("own", F.last("starts", True).over(so_far(split, 0)))
              .select("path", "block", "row", "line", "own", "first"))
    placed, _ = store.write(placed, "placed")
    open_before = placed.groupBy("path", "block").agg(F.max("own").alias("last")).select(
        "path", "block", F.last(F.when(F.col("last").isNotNull(), F.struct("block", "last")), True).over(so_far(file, -1)).alias("before"))
    own = F.col("own").isNotNull()
    record = (placed.join(open_before, ["path", "block"])
              .select("path", F.when(own, F.col("block")).otherwise(F.col("before.block")).alias("from_block"),
                      F.when(own, F.col("own")).otherwise(F.col("before.last")).alias("from_row"),
                      F.when((F.col("block") == 0) & (F.col("own") == F.col("first")), True).alias("head"),
                      F.struct("block", "row", "line").alias("part"))
              .groupBy("path", "from_block", "from_row")
              .agg(F.array_sort(F.collect_list("part")).alias("parts"), F.coalesce(F.max("head"), F.lit(False)).alias("head")))
    text = F.array_join(F.col("parts.line"), "\n")
    names = spark.read.options(**_CSV).option("multiLine", True).csv(path).columns  # reads one header
    schema = ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)
    parsed = F.from_csv(text, schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    return record.filter(~F.col("head") & (F.trim(text) != "")).select(parsed.alias("r")).select("r.*")


def _typed(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` by name, absent ones as null; extra columns are never parsed."""
    parts = [field.strip().rsplit(" ", 1) for field in schema.split(",")]
    return df.select(*[(F.trim(F.col(n)).cast(t) if t != "string" else F.col(n)) .alias(n)
                       if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in parts])


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``seq``: increasing in file order (files by path, then line by line), not dense.

    Spark packs splits by size, so its own row numbers do not follow the files.
    ``seq`` is the file's place in the sorted list of paths, the split's offset
    in the file and the row's number, in one decimal.
    """
    files = F.array(*[F.lit(f) for f in sorted(df.inputFiles())]).cast("array<string>")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number in its task
    path = F.array_position(files, F.col("_metadata.file_path"))
    seq = F.concat(F.lpad(path.cast("string"), 8, "0"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 14, "0"),
                   F.lpad(row.cast("string"), 10, "0"))
    return df.withColumn("seq", seq.cast("decimal(38,0)"))


def read_orders(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A1: (sentenceID, sentence); raises on missing columns or no rows."""
    raw = _csv_text(spark, path, multi_line)
    missing = {"sentenceID", "sentence"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}, found {raw.columns}")
    orders = raw.select("sentenceID", "sentence")
    if orders.isEmpty():
        raise ValueError(f"{path}: no data rows")
    return orders


def read_labelled_orders(spark: SparkSession, path: str) -> DataFrame:
    """Labelled orders with typed ``is_valid``; null texts become ''."""
    raw = _csv_text(spark, path)
    text = ["sentenceID", "sentence", "origin", "destination", "difficulty", "category", "notes"]
    out = raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns
                       else F.lit("").alias(c) for c in text],
                     F.col("is_valid").cast("int").alias("is_valid"))
    return out


# Where a byte sequence stops being UTF-8, on bytes read as characters 0 to 255. As the coding
# synchronizes itself, up to three bytes round a place decide it, so nothing is carried along the text.
_NOT_UTF8 = "|".join([
    r"[\xC0\xC1\xF5-\xFF]",                          # never allowed
    r"[\xC2-\xDF](?![\x80-\xBF])",                    # cut off after one byte
    r"\xE0(?![\xA0-\xBF][\x80-\xBF])",                # cut off or overlong
    r"[\xE1-\xEC\xEE\xEF](?![\x80-\xBF]{2})",
    r"\xED(?![\x80-\x9F][\x80-\xBF])",                # cut off or a surrogate
    r"\xF0(?![\x90-\xBF][\x80-\xBF]{2})",
    r"[\xF1-\xF3](?![\x80-\xBF]{3})",
    r"\xF4(?![\x80-\x8F][\x80-\xBF]{2})",             # cut off or above the last code point
    r"(?<![\xC2-\xF4])(?<![\xE0-\xF4][\x80-\xBF])(?<![\xF0-\xF4][\x80-\xBF]{2})[\x80-\xBF]",  # no sequence to continue
])


def first_invalid_byte(text) -> Column:
    """1-based byte at which ``text`` (binary, or a string of raw bytes) stops being UTF-8; 0 if all is valid, null for null.

    A sequence that is cut off, overlong, a surrogate or too large counts from its first byte.
    """
    raw = (F.col(text) if isinstance(text, str) else text).cast("binary")
    found = F.regexp_instr(F.decode(raw, "ISO-8859-1"), F.lit(_NOT_UTF8))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.lit(0)).otherwise(found)


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as raw bytes, in splits: (path, size, block, row, line); ``row`` grows within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                        F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"), F.col("value").alias("line"))


def invalid_utf8_files(spark: SparkSession, path: str) -> DataFrame:
    """A2: files that are not UTF-8, as (path, length, first_bad_byte), the byte counted from 1.

    Files are read in splits, line by line: no sequence holds a line break, so a
    line decides for itself. The first pass keeps the first bad line of each file,
    the second counts the bytes before it; texts are not shuffled. A leading byte
    order mark, which the line reader drops, shows as bytes that no line accounts
    for. Empty and valid files have no row; a genuine U+FFFD is valid.
    """
    place = F.struct("block", "row")
    bad = (_raw_lines(spark, path).withColumn("at", first_invalid_byte("line")).filter(F.col("at") > 0)
           .groupBy("path").agg(F.min_by(F.struct("block", "row", "at"), place).alias("bad")))
    bad, _ = TableStore(spark, "utf8").write(bad, "bad")
    used = (F.octet_length("line") + 1).cast("bigint")  # with its line break
    earlier = F.struct("block", "row") < F.struct("bad.block", "bad.row")
    return (_raw_lines(spark, path).join(bad, "path")
            .groupBy("path", "size", F.col("bad.at").alias("at"))
            .agg(F.sum(used).alias("all"), F.coalesce(F.sum(F.when(earlier, used)), F.lit(0)).alias("before"))
            .select("path", F.col("size").alias("length"),
                    (F.col("before") + F.col("at") + F.when(F.col("size") - F.col("all") >= 2, 3).otherwise(0))
                    .cast("bigint").alias("first_bad_byte")))


def read_gtfs(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A5: one timetable table with only the columns in use; ``stops`` gets ``seq``."""
    df = _typed(_csv_text(spark, f"{folder}/{table}.txt"), GTFS_COLUMNS[table])
    return with_file_order(df) if table == "stops" else df


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations with ``seq``."""
    return with_file_order(_typed(_csv_text(spark, path), STATION_SCHEMA))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Connections; older files without class or counts get nulls."""
    return _typed(_csv_text(spark, path), CONNECTION_SCHEMA)


def read_city_map(spark: SparkSession, path: str) -> DataFrame:
    """City mapping rows (city_name_normalized, station_name, uic_code, seq)."""
    return with_file_order(_typed(_csv_text(spark, path),
                                  "city_name_normalized string, station_name string, uic_code string"))


def read_names_csv(spark: SparkSession, path: str, column: str = "city") -> DataFrame:
    """One CSV column as gazetteer names (name, kind, seq)."""
    raw = _csv_text(spark, path)
    if column not in raw.columns:
        return spark.createDataFrame([], "name string, kind string, seq bigint")
    return with_file_order(raw.select(F.col(column).alias("name"), F.lit("city").alias("kind")))


def read_gazetteer_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(names, aliases) from JSON documents with cities, stations and aliases."""
    doc = spark.read.schema(GAZETTEER_SCHEMA).option("multiLine", True).json(path)
    kind = lambda col, name, base: doc.select(F.posexplode(col).alias("pos", "name")).select(
        "name", F.lit(name).alias("kind"), (F.col("pos") + F.lit(base)).cast("bigint").alias("seq"))
    names = kind("cities", "city", 0).unionByName(kind("stations", "station", 1 << 40))
    aliases = doc.select(F.explode("aliases").alias("canonical_norm", "alias")) \
        .select("canonical_norm", F.explode("alias").alias("alias"))
    return names, aliases


def read_gazetteer_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A7 for dictionaries of any size: (names, aliases) as ``write_gazetteer_rows`` wrote them."""
    return (spark.read.schema("name string, kind string, seq bigint").json(f"{path}/names"),
            spark.read.schema("canonical_norm string, alias string").json(f"{path}/aliases"))


def read_token_examples(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Token examples; check rows with ``labels.label_problems``."""
    return spark.read.schema(LABELLED_SCHEMA).option("multiLine", not json_lines).json(path)
