"""Column profile of parquet tables, chunk by chunk, reading no more than the footers leave open.

Every row group of every file is one unit of work, and each of its column chunks is answered by the
cheapest part of the file that suffices:

* the footer, which has exact row and null counts, and for numbers exact extrema, so that a chunk
  without values, or whose minimum equals its maximum, is known;
* the dictionary page, which has the distinct values, where all data pages refer to it;
* the pages, where values must be counted group by group.  They are read in dictionary form: places
  in the dictionary are counted together with the group, and only the distinct ones are decoded.

What leaves a unit is already combined, as Arrow batches, and Spark sums it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.sources.footers import dictionary_values

CHUNK_SCHEMA = "dataset_id string, grp string, column_name string, value string, n bigint, origin string"
FACT_SCHEMA = "dataset_id string, column_name string, value string, rows bigint, nulls bigint, low string, high string, whole boolean, origin string"

#: Every Unicode white space character, and the four separators that count as such in Python.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def _source(uri: str):
    import pyarrow.fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(unquote(urlparse(uri).path))
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _texts(values):
    """Values as text: times as ``yyyy-mm-dd hh:mm:ss.ffffff``, so that their order is that of the text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_timestamp(values.type):
        return pc.strftime(values.cast(pa.timestamp("us", values.type.tz)), "%Y-%m-%d %H:%M:%S")
    if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
        return pa.array([None if v is None else v.decode("utf-8", "replace") for v in values.to_pylist()], pa.string())
    return values.cast(pa.string())


class _Unit:
    """One row group, with what its footer knows of each column."""

    def __init__(self, uri: str, row_group: int, opener=_source):
        import pyarrow.parquet as pq

        self.raw = opener(uri)
        self.file = pq.ParquetFile(self.raw)
        self.number = row_group
        self.meta = self.file.metadata.row_group(row_group)
        self.created_by = self.file.metadata.created_by or ""
        self.rows = self.meta.num_rows
        self.types = {f.name: f.type for f in self.file.schema_arrow}
        self.place = {self.meta.column(i).path_in_schema: self.meta.column(i) for i in range(self.meta.num_columns)}

    def statistics(self, name: str):
        chunk = self.place.get(name)
        return chunk.statistics if chunk is not None and chunk.statistics is not None and chunk.statistics.has_null_count else None

    def extrema(self, name: str):
        """(least, greatest) as an Arrow array if the footer's are exact, else None.

        Those of byte arrays may have been cut short by the writer, and those of floating-point
        numbers leave out what has no order.
        """
        import pyarrow as pa

        stats = self.statistics(name)
        if stats is None or not stats.has_min_max or self.place[name].physical_type not in ("INT32", "INT64", "BOOLEAN"):
            return None
        return pa.array([stats.min, stats.max], self.types[name])

    def constant(self, name: str):
        """(known, text) if the footer proves that the chunk holds one value only."""
        stats = self.statistics(name)
        if stats is not None and stats.null_count == self.rows:
            return True, None
        ends = self.extrema(name)
        if stats is None or stats.null_count or ends is None or ends[0] != ends[1]:
            return False, None
        return True, _texts(ends)[0].as_py()

    def dictionary(self, name: str):
        """Distinct present values from the dictionary page, or None."""
        chunk = self.place.get(name)
        return None if chunk is None else dictionary_values(self.raw, chunk, self.types[name], self.created_by)

    def read(self, names: Sequence[str]):
        import pyarrow.parquet as pq

        strings = [n for n in names if self.place[n].physical_type == "BYTE_ARRAY"]
        return pq.ParquetFile(self.raw, read_dictionary=strings).read_row_group(self.number, columns=list(names))


def _places(column):
    """(code per row with -1 for null, distinct values) of a column, decoding nothing."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_dictionary(column.type):
        column = column.dictionary_encode()
    return pc.fill_null(column.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False), column.dictionary


def chunk_counts(dataset: str, uri: str, row_group: int, group: str | None, columns: Sequence[str], opener=_source):
    """Arrow batches (CHUNK_SCHEMA) with the value counts of one row group."""
    import numpy as np
    import pyarrow as pa

    unit = _Unit(uri, row_group, opener)
    if unit.rows == 0:
        return

    def batch(name, groups, values, counts, origin):
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([dataset] * n, pa.string()), groups, pa.array([name] * n, pa.string()), values, pa.array(counts, pa.int64()), pa.array([origin] * n, pa.string())],
            names=["dataset_id", "grp", "column_name", "value", "n", "origin"])

    one_group, group_value = (True, None) if group is None else unit.constant(group)
    open_columns = []
    for name in columns:
        text = lambda values: pa.array(values, pa.string())
        known, value = unit.constant(name)
        if one_group and known:
            yield batch(name, text([group_value]), text([value]), [unit.rows], "footer")
            continue
        stats = unit.statistics(name)
        single = unit.dictionary(name) if one_group and stats is not None else None
        if single is not None and len(single) == 1:
            # one value and nothing else: its number is what the footer does not count as null
            found = [(_texts(single)[0].as_py(), unit.rows - stats.null_count), (None, stats.null_count)]
            found = [x for x in found if x[1]]
            yield batch(name, text([group_value] * len(found)), text([v for v, _ in found]), [n for _, n in found], "dictionary")
            continue
        open_columns.append(name)
    if not open_columns:
        return
    table = unit.read(open_columns if one_group else list(dict.fromkeys([group, *open_columns])))
    group_codes, group_values = (np.zeros(unit.rows, np.int64), None) if one_group else _places(table.column(group))
    for name in open_columns:
        codes, values = _places(table.column(name))
        width = len(values) + 1
        keys, counts = np.unique((group_codes + 1) * width + codes + 1, return_counts=True)
        at, of = keys % width - 1, keys // width - 1
        pick = lambda source, i: _texts(source.take(pa.array(i, mask=i < 0)))
        groups = pa.array([group_value] * len(keys), pa.string()) if one_group else pick(group_values, of)
        yield batch(name, groups, pick(values, at), counts, "pages")


def chunk_facts(dataset: str, uri: str, row_group: int, columns: Sequence[str], opener=_source):
    """Arrow batches (FACT_SCHEMA) about whole chunks: one row of counts and extrema each, and their distinct values.

    Row and null counts and extrema of integers, dates and times come from the footer.  Distinct
    values come from the dictionary page, which also gives the extrema of text; only chunks without
    a footer's counts, or whose dictionary proves nothing, have their pages read.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    unit = _Unit(uri, row_group, opener)
    if unit.rows == 0:
        return
    for name in columns:
        stats, ends = unit.statistics(name), unit.extrema(name)
        known, value = unit.constant(name)
        if known:
            distinct, origin = pa.array([value] if value is not None else [], pa.string()), "footer"
        else:
            values, origin = (unit.dictionary(name) if stats is not None else None), "dictionary"
            if values is None:
                values, origin = unit.read([name]).column(name), "pages"
                values = pc.unique(values.combine_chunks().dictionary_decode() if pa.types.is_dictionary(values.type) else values)
            values = pc.drop_null(values)
            if ends is None and len(values):
                ends = pa.array([pc.min(values).as_py(), pc.max(values).as_py()], values.type)
            distinct = _texts(values)
        nulls = stats.null_count if stats is not None else unit.read([name]).column(name).null_count
        n = len(distinct)
        low, high = (x.as_py() for x in _texts(ends)) if ends is not None else (None, None)
        whole = pa.types.is_integer(unit.types[name])
        fill = lambda head, rest, kind: pa.array([head] + [rest] * n, kind)
        yield pa.RecordBatch.from_arrays(
            [fill(dataset, dataset, pa.string()), fill(name, name, pa.string()), pa.concat_arrays([pa.nulls(1, pa.string()), distinct.combine_chunks() if isinstance(distinct, pa.ChunkedArray) else distinct]),
             fill(unit.rows, None, pa.int64()), fill(nulls, None, pa.int64()), fill(low, None, pa.string()), fill(high, None, pa.string()), fill(whole, None, pa.bool_()), fill(origin, None, pa.string())],
            names=["dataset_id", "column_name", "value", "rows", "nulls", "low", "high", "whole", "origin"])


def _units(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(dataset_id, path, row_group): the row groups of all files, found by tasks; no list of files reaches the driver."""
    def row_groups(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            found = [(d, p, i) for d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in range(pq.ParquetFile(_source(p)).num_row_groups)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.int32())],
                                             names=["dataset_id", "path", "row_group"])

    files = None
    for name, path in paths.items():
        # only the paths are asked for, so no content is read here
        own = spark.read.format("binaryFile").load(path).select(F.lit(name).alias("dataset_id"), "path")
        files = own if files is None else files.unionByName(own)
    lanes = 4 * spark.sparkContext.defaultParallelism
    return files.repartition(lanes).mapInArrow(row_groups, "dataset_id string, path string, row_group int").repartition(lanes)


def value_counts(spark: SparkSession, paths: Mapping[str, str] | str, columns: Sequence[str], group: str | None = None) -> DataFrame:
    """(dataset_id, grp, column_name, value, n): how often each value occurs, by group, over parquet tables.

    ``paths`` maps names to folders or files.  Values come as text; a null value is a row with
    ``value`` null.
    """
    columns = list(columns)

    def count(batches):
        for batch in batches:
            for d, p, i in zip(*(batch.column(c).to_pylist() for c in range(3))):
                yield from chunk_counts(d, p, i, group, columns)

    counted = _units(spark, {"": paths} if isinstance(paths, str) else paths).mapInArrow(count, CHUNK_SCHEMA)
    return counted.groupBy("dataset_id", "grp", "column_name", "value").agg(F.sum("n").alias("n"))


def column_facts(spark: SparkSession, paths: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """One row per table and column: rows_total, nulls, distinct_values, min_value, max_value, and chunks by what answered them.

    Values are those present (not null), as text; the extrema of whole numbers are those of the
    numbers.  Every column must be in every table.
    """
    columns = list(columns)
    text = lambda c: F.when(~F.col("whole"), F.col(c))
    number = lambda c: F.when(F.col("whole"), F.col(c).cast("decimal(38,0)"))

    def facts(batches):
        for batch in batches:
            for d, p, i in zip(*(batch.column(c).to_pylist() for c in range(3))):
                yield from chunk_facts(d, p, i, columns)

    key = ["dataset_id", "column_name"]
    found = _units(spark, paths).mapInArrow(facts, FACT_SCHEMA)
    # by value first, so that repeats go before anything is gathered by column
    once = found.groupBy(*key, "value").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min(text("low")).alias("low"), F.max(text("high")).alias("high"), F.min(number("low")).alias("least"), F.max(number("high")).alias("most"),
        *[F.count(F.when(F.col("origin") == o, 1)).alias(f"by_{o}") for o in ("footer", "dictionary", "pages")])
    return once.groupBy(*key).agg(
        F.sum("rows").alias("rows_total"), F.sum("nulls").alias("nulls"), F.count("value").alias("distinct_values"), F.coalesce(F.min("least").cast("string"), F.min("low")).alias("min_value"), F.coalesce(F.max("most").cast("string"), F.max("high")).alias("max_value"),
        *[F.sum(f"by_{o}").alias(f"by_{o}") for o in ("footer", "dictionary", "pages")])


def is_missing(value: Column) -> Column:
    """Null, empty, or nothing but white space of any Unicode kind."""
    return value.isNull() | value.rlike(BLANK)


def profile_columns(counts: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """One row per table, group and column from ``value_counts``.

    rows_total, nulls, blanks, missing_share, present, distinct_values (of present values, exact),
    min_value and max_value (as text, code-point order), and with ``patterns`` (dataset_id,
    column_name, value_pattern) also violations.  A group without present values has null extremes and a
    missing share of 1; an empty table gives no rows.
    """
    value, n = F.col("value"), F.col("n")
    missing = is_missing(value)
    keys = ["dataset_id"] if "dataset_id" in counts.columns else []
    if patterns is None:
        counts = counts.withColumn("value_pattern", F.lit(None).cast("string"))
    else:
        # a row per checked column
        counts = counts.join(F.broadcast(patterns.select(*keys, "column_name", "value_pattern")), [*keys, "column_name"], "left")
    bad = F.col("value_pattern").isNotNull() & ~missing & ~F.expr("value rlike concat('(?U)', value_pattern)")
    return counts.groupBy(*keys, "grp", "column_name").agg(
        F.sum("n").alias("rows_total"),
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("nulls"),
        F.sum(F.when(value.isNotNull() & missing, n).otherwise(0)).alias("blanks"),
        (F.sum(F.when(missing, n).otherwise(0)) / F.sum("n")).alias("missing_share"),
        F.sum(F.when(~missing, n).otherwise(0)).alias("present"),
        F.count(F.when(~missing, 1)).alias("distinct_values"),
        F.min(F.when(~missing, value)).alias("min_value"),
        F.max(F.when(~missing, value)).alias("max_value"),
        F.sum(F.when(bad, n).otherwise(0)).alias("violations"),
    )


def shape(value: Column) -> Column:
    """The make-up of a value: runs of digits, capital and small letters each become one sign; null stays null."""
    for runs, sign in (("[0-9]+", "9"), ("[A-Z]+", "A"), ("[a-z]+", "a")):
        value = F.regexp_replace(value, runs, sign)
    return value


def load_shifts(counts: DataFrame) -> DataFrame:
    """(dataset_id, grp, column_name, before, shift): how far the shapes of a load's values are from those of the load before.

    ``shift`` is half the sum of absolute differences of the shares of shapes, null being a shape of
    its own: 0 for equal mixtures, 1 for none in common.  Loads are taken in numeric order; the
    first has no row.
    """
    key = ["dataset_id", "column_name"]
    shapes = counts.groupBy(*key, F.col("grp").cast("long").alias("load"), F.coalesce(shape(F.col("value")), F.lit("\x00")).alias("shape")).agg(F.sum("n").alias("n"))
    loads = shapes.groupBy(*key, "load").agg(F.sum("n").alias("total"))
    order = Window.partitionBy(*key).orderBy("load")  # a row per load
    chain = loads.withColumns({"before": F.lag("load").over(order), "total_before": F.lag("total").over(order)}).filter("before is not null")
    shared = shapes.join(chain, [*key, "load"]).select(*key, "load", "shape", (F.col("n") / F.col("total")).alias("now"), F.lit(0.0).alias("then"))
    older = shapes.withColumnRenamed("load", "before").join(chain, [*key, "before"]).select(*key, "load", "shape", F.lit(0.0).alias("now"), (F.col("n") / F.col("total_before")).alias("then"))
    both = shared.unionByName(older).groupBy(*key, "load", "shape").agg((F.abs(F.sum("now") - F.sum("then")) / 2).alias("gap"))
    gaps = both.groupBy(*key, "load").agg(F.sum("gap").alias("shift"))
    return gaps.join(chain.select(*key, "load", "before"), [*key, "load"]).select("dataset_id", F.col("load").cast("string").alias("grp"), "column_name", F.col("before").cast("string").alias("before"), "shift")


def as_calendar_date(value: Column) -> Column:
    """A date written as year-month-day, day/month/year or yyyymmdd; null if it is none."""
    v = F.trim(value)
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd")),
        F.when(v.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(v, "dd/MM/yyyy")),
        F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd")),
    )


#: Tolerances of the load checks.
NULL_RATE, PATTERN, RANGE, DISTRIBUTION, STATED = 0.12, 0.055, 0.025, 0.3, 0.0101


def load_findings(counts: DataFrame, baseline: DataFrame, manifest: DataFrame) -> DataFrame:
    """(load_id, column_name, finding) where a load departs from its baseline or its manifest.

    ``counts`` is ``value_counts``; ``baseline`` and ``manifest`` have at
    most a few rows per column and per load.  A load without manifest row has no ``stated``
    finding; a column without baseline row none of the others; shares over nothing are no finding.
    """
    value, n = F.col("value"), F.col("n")
    missing = is_missing(value)
    # the baseline has one row per checked column, so its size does not grow with the data
    known = counts.join(F.broadcast(baseline), ["dataset_id", "column_name"], "left")
    fits = ~missing & F.col("value_pattern").isNotNull() & F.expr("value rlike concat('(?U)', value_pattern)")
    day = as_calendar_date(value)
    outside = day.isNull() | (day < F.col("min_value").cast("date")) | (day > F.col("max_value").cast("date"))
    total = lambda cond: F.sum(F.when(cond, n).otherwise(F.lit(0)))
    per = known.groupBy("dataset_id", "grp", "column_name").agg(
        F.sum("n").alias("rows_total"),
        total(missing).alias("missing"),
        total(~missing).alias("present"),
        F.count(F.when(~missing, 1)).alias("distinct_values"),
        total(~missing & ~fits).alias("violations"),
        total(fits & outside).alias("outside"),
        *[F.first(c).alias(c) for c in ("null_rate", "value_pattern", "min_distinct_share")],
    )
    share = F.col("missing") / F.col("rows_total")
    some = F.col("present") > 0
    checks = F.array_compact(F.array(
        F.when(F.abs(share - F.col("null_rate")) > NULL_RATE, F.lit("null_rate")),
        F.when(some & F.col("value_pattern").isNotNull() & F.col("column_name").isin("date_value", "group_value")
               & (F.col("violations") / F.col("present") > PATTERN), F.lit("pattern")),
        F.when(some & (F.col("column_name") == "date_value") & (F.col("outside") / F.col("present") > RANGE), F.lit("range")),
        F.when(some & (F.col("distinct_values") / F.col("present") < F.col("min_distinct_share")), F.lit("distinct")),
    ))
    direct = per.select("grp", "column_name", F.explode(checks).alias("finding"))

    code = F.regexp_extract(value, r"([A-Z]{2})[-_ ]?[0-9]{4}", 1)
    seen = (known.filter(fits & F.col("category_shares").isNotNull() & (code != ""))
            .groupBy("grp", "column_name", code.alias("code"))
            .agg(F.sum("n").alias("n"), F.first("category_shares").alias("category_shares")))
    mix = seen.groupBy("grp", "column_name").agg(
        F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("seen"),  # at most 676 codes
        F.sum("n").alias("all"), F.first("category_shares").alias("category_shares"),
    ).withColumn("want", F.from_json("category_shares", "map<string,double>"))
    codes = F.array_union(F.map_keys("seen"), F.map_keys("want"))
    gap = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.abs(
        F.coalesce(F.try_element_at("seen", c), F.lit(0)) / F.col("all") - F.coalesce(F.try_element_at("want", c), F.lit(0.0)))) / 2
    shifted = mix.filter(gap > DISTRIBUTION).select("grp", "column_name", F.lit("distribution").alias("finding"))

    checked = per.filter(F.col("column_name").isin("label_value", "date_value", "group_value"))
    loads = checked.groupBy("dataset_id", "grp").agg(
        F.max("rows_total").alias("true_rows"), F.avg(share).alias("true_mean"), F.max(share).alias("true_max"))
    stated = loads.join(manifest.select("dataset_id", F.col("load_id").cast("string").alias("grp"), "row_count",
                                        "missingness_mean", "missingness_max"), ["dataset_id", "grp"])
    wrong = F.array_compact(F.array(
        F.when(F.col("row_count") != F.col("true_rows"), F.lit("row_count")),
        F.when(F.abs(F.col("missingness_mean") - F.col("true_mean")) > STATED, F.lit("missingness_mean")),
        F.when(F.abs(F.col("missingness_max") - F.col("true_max")) > STATED, F.lit("missingness_max")),
    ))
    lies = stated.select("grp", F.explode(wrong).alias("column_name"), F.lit("stated").alias("finding"))
    return (direct.unionByName(shifted).unionByName(lies)
            .select(F.col("grp").cast("int").alias("load_id"), "column_name", "finding"))
