"""Queries of the general problems: change feed (1) and column profile (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.changefeed import FeedSpec, apply_changes, fold_changes
from kinfold.operators.quality import column_facts, load_findings, load_shifts, profile_columns, value_counts
from kinfold.session import Scratch, read_table

ADJUDICATION_PAYLOAD = (
    "left_record_key", "right_record_key", "decision", "confidence", "reviewer_id",
    "adjudicated_at", "protocol_version", "superseded_event_id",
)
PROFILED = ("label_value", "date_value", "group_value")
ALL_COLUMNS = ("record_key", *PROFILED, "updated_at")


def _feed(payload) -> FeedSpec:
    return FeedSpec(key=["event_id"], position=["log_epoch", "log_seq"], op="op", payload=list(payload), changed="changed_fields")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = _feed(["left_record_key", "right_record_key"])
    live = apply_changes(read_table(spark, sf_dir, "adjudication_feed"), spec)
    return live.select(
        "event_id",
        F.least("left_record_key", "right_record_key").alias("left_record_key"),
        F.greatest("left_record_key", "right_record_key").alias("right_record_key"),
    )


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the adjudications as they stand."""
    table = apply_changes(read_table(spark, sf_dir, "adjudication_feed"), _feed(ADJUDICATION_PAYLOAD))
    return table.withColumn("adjudicated_us", F.unix_micros("adjudicated_at")).drop("adjudicated_at")


def p1_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose last life event is a delete, kept to ward off late changes."""
    state = fold_changes(read_table(spark, sf_dir, "adjudication_feed"), _feed([]))
    return state.filter(~F.col("__life.live")).select(
        "event_id", F.col("__life.p0").alias("deleted_epoch"), F.col("__life.p1").alias("deleted_seq"))


def _paths(sf_dir: str) -> dict[str, str]:
    return {name: f"{sf_dir}/{name}.parquet" for name in ("source_a", "source_b")}


def _counts(spark: SparkSession, sf_dir: str, columns) -> DataFrame:
    """Value counts by load, written once: several parts of a query start from them."""
    return Scratch(spark, "profile").keep(value_counts(spark, _paths(sf_dir), columns, "load_id"), "counts")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_findings(
        _counts(spark, sf_dir, PROFILED),
        read_table(spark, sf_dir, "column_baseline"),
        read_table(spark, sf_dir, "load_manifest"),
    )


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of both sources, load by load."""
    profile = profile_columns(_counts(spark, sf_dir, ALL_COLUMNS), read_table(spark, sf_dir, "column_baseline"))
    return profile.select(
        "dataset_id", F.col("grp").cast("int").alias("load_id"), "column_name", "rows_total", "nulls", "blanks",
        F.round("missing_share", 6).alias("missing_share"), "present", "distinct_values", "min_value", "max_value", "violations")


def p5_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each load's values are from those of the load before, by their shapes."""
    return load_shifts(_counts(spark, sf_dir, ALL_COLUMNS)).select(
        "dataset_id", F.col("grp").cast("int").alias("load_id"), "column_name", F.col("before").cast("int").alias("load_before"), F.round("shift", 6).alias("shift"))


def p5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sources as whole tables, from footers and dictionary pages."""
    return column_facts(spark, _paths(sf_dir), (*ALL_COLUMNS, "load_id")).drop("by_footer", "by_dictionary", "by_pages")


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column chunks by the part of the file that answered for them."""
    return column_facts(spark, _paths(sf_dir), (*ALL_COLUMNS, "load_id")).select("dataset_id", "column_name", "by_footer", "by_dictionary", "by_pages")


QUERIES = {"p1_found": p1_found, "p1_table": p1_table, "p1_tombstones": p1_tombstones, "p5_found": p5_found, "p5_profile": p5_profile, "p5_shifts": p5_shifts,
           "p5_columns": p5_columns, "p5_chunks": p5_chunks}

_FOLD = """
with f as (select *, lower(op[1:1]) as o, (log_epoch::hugeint * 1000000000000 + log_seq) as pos,
             list_transform(string_split(coalesce(changed_fields, ''), ','), lambda x: trim(x)) as named from adjudication_feed),
last_life as (select event_id, max(pos) as life, max(pos) filter (where o = 'i') as born
              from f where o in ('i', 'd') group by event_id),
alive as (select event_id, born from last_life where life = born)
"""


def _newest(column: str) -> str:
    sets = f"(o = 'i' or changed_fields is null or list_contains(named, '{column}'))"
    return f"(max(row(pos, {column})) filter (where o in ('i','u') and pos >= born and {sets}))[2]"


_BLANK_SQL = r"'^[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]*$'"
_MISSING_SQL = f"(v is null or regexp_matches(v, {_BLANK_SQL}))"
_CELLS = """cells as (
  select 'source_a' as dataset_id, load_id, 'label_value' as column_name, label_value as v from source_a
  union all select 'source_a', load_id, 'date_value', date_value from source_a
  union all select 'source_a', load_id, 'group_value', group_value from source_a
  union all select 'source_b', load_id, 'label_value', label_value from source_b
  union all select 'source_b', load_id, 'date_value', date_value from source_b
  union all select 'source_b', load_id, 'group_value', group_value from source_b"""

_ALL_CELLS = _CELLS + """
  union all select 'source_a', load_id, 'record_key', record_key from source_a
  union all select 'source_b', load_id, 'record_key', record_key from source_b
  union all select 'source_a', load_id, 'updated_at', strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') from source_a
  union all select 'source_b', load_id, 'updated_at', strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') from source_b)"""

ORACLE = {
    "p1_found": _FOLD + f""", s as (select event_id, {_newest('left_record_key')} as l, {_newest('right_record_key')} as r
        from f join alive using (event_id) group by event_id)
        select event_id, least(l, r) as left_record_key, greatest(l, r) as right_record_key from s""",
    "p1_table": _FOLD + "select event_id, " + ", ".join(
            f"epoch_us({_newest(c)}) as adjudicated_us" if c == "adjudicated_at" else f"{_newest(c)} as {c}" for c in ADJUDICATION_PAYLOAD)
        + " from f join alive using (event_id) group by event_id",
    "p1_tombstones": _FOLD + """select event_id, (life // 1000000000000)::integer as deleted_epoch,
        (life % 1000000000000)::bigint as deleted_seq from last_life where born is null or life > born""",
    "p5_profile": "with " + _ALL_CELLS + """
select dataset_id, load_id, column_name, count(*) as rows_total, count(*) filter (where v is null) as nulls,
  count(*) filter (where v is not null and """ + _MISSING_SQL + """) as blanks,
  round(count(*) filter (where """ + _MISSING_SQL + """) / count(*), 6) as missing_share,
  count(*) filter (where not """ + _MISSING_SQL + """) as present,
  count(distinct v) filter (where not """ + _MISSING_SQL + """) as distinct_values,
  min(v) filter (where not """ + _MISSING_SQL + """) as min_value, max(v) filter (where not """ + _MISSING_SQL + """) as max_value,
  count(*) filter (where not """ + _MISSING_SQL + """ and value_pattern is not null and not regexp_matches(v, value_pattern)) as violations
from cells left join (select dataset_id, column_name, value_pattern from column_baseline) using (dataset_id, column_name)
group by dataset_id, load_id, column_name""",
    "p5_shifts": "with " + _ALL_CELLS + r""", s as (select dataset_id, column_name, load_id, coalesce(regexp_replace(regexp_replace(regexp_replace(v, '[0-9]+', '9', 'g'), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), chr(0)) as shape, count(*) as n from cells group by all),
  l as (select *, lag(load_id) over (partition by dataset_id, column_name order by load_id) as load_before from (select dataset_id, column_name, load_id, sum(n) as total from s group by all)),
  k as (select l.*, b.total as total_before from l join l b on b.dataset_id = l.dataset_id and b.column_name = l.column_name and b.load_id = l.load_before),
  x as (select k.dataset_id, k.column_name, k.load_id, shape, n / total as d from s join k using (dataset_id, column_name, load_id)
    union all select k.dataset_id, k.column_name, k.load_id, shape, -n / total_before from s join k on s.dataset_id = k.dataset_id and s.column_name = k.column_name and s.load_id = k.load_before),
  g as (select dataset_id, column_name, load_id, abs(sum(d)) / 2 as gap from x group by dataset_id, column_name, load_id, shape)
  select dataset_id, load_id, column_name, any_value(load_before) as load_before, round(sum(gap), 6) as shift from g join k using (dataset_id, column_name, load_id) group by dataset_id, load_id, column_name""",
    "p5_columns": "with " + _ALL_CELLS + """
select dataset_id, column_name, count(*) as rows_total, count(*) filter (where v is null) as nulls, count(distinct v) as distinct_values, min(v) as min_value, max(v) as max_value
from cells group by 1, 2
union all select 'source_a', 'load_id', count(*), count(*) - count(load_id), count(distinct load_id), min(load_id)::varchar, max(load_id)::varchar from source_a
union all select 'source_b', 'load_id', count(*), count(*) - count(load_id), count(distinct load_id), min(load_id)::varchar, max(load_id)::varchar from source_b""",
    "p5_found": "with " + _CELLS + """),
m as (select c.*, b.null_rate, b.value_pattern, b.min_value, b.max_value, b.min_distinct_share, b.category_shares,
  """ + _MISSING_SQL + """ as gone, not """ + _MISSING_SQL + """ and b.value_pattern is not null and regexp_matches(v, b.value_pattern) as fits
  from cells c left join column_baseline b using (dataset_id, column_name)),
d as (select *, case when regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_strptime(v, '%Y-%m-%d')
   when regexp_matches(v, '^[0-9]{2}/[0-9]{2}/[0-9]{4}$') then try_strptime(v, '%d/%m/%Y')
   when regexp_matches(v, '^[0-9]{8}$') then try_strptime(v, '%Y%m%d') end as day from m),
s as (select dataset_id, load_id, column_name, count(*) as n, count(*) filter (where gone) as miss,
  count(*) filter (where not gone) as here, count(*) filter (where not gone and not fits) as bad,
  count(*) filter (where fits and (day is null or day < min_value::timestamp or day > max_value::timestamp)) as out_n,
  count(distinct v) filter (where not gone) as dist, any_value(null_rate) as null_rate, any_value(value_pattern) as vp,
  any_value(min_distinct_share) as mds from d group by all),
codes as (select load_id, column_name, regexp_extract(v, '([A-Z]{2})[-_ ]?[0-9]{4}', 1) as code, count(*) as n,
  any_value(category_shares) as js from m where fits and category_shares is not null group by 1, 2, 3),
tot as (select load_id, column_name, sum(n) as t, any_value(js) as js from codes group by 1, 2),
want as (select t.load_id, t.column_name, k.code, (json_extract(t.js, '$.' || k.code))::double as w
  from tot t, unnest(json_keys(t.js)) as k(code)),
gap as (select load_id, column_name, sum(abs(coalesce(n, 0) / t - coalesce(w, 0))) / 2 as g
  from codes full join want using (load_id, column_name, code) join tot using (load_id, column_name) group by 1, 2),
loads as (select dataset_id, load_id, max(n) as n, avg(miss / n) as mean_m, max(miss / n) as max_m from s group by 1, 2),
lm as (select l.*, k.row_count, k.missingness_mean, k.missingness_max from loads l join load_manifest k using (dataset_id, load_id))
select load_id, column_name, 'null_rate' as finding from s where abs(miss / n - null_rate) > 0.12
union all select load_id, column_name, 'pattern' from s where column_name <> 'label_value' and here > 0 and bad / here > 0.055
union all select load_id, column_name, 'range' from s where column_name = 'date_value' and here > 0 and out_n / here > 0.025
union all select load_id, column_name, 'distinct' from s where here > 0 and dist / here < mds
union all select load_id, column_name, 'distribution' from gap where g > 0.3
union all select load_id, 'row_count', 'stated' from lm where row_count <> n
union all select load_id, 'missingness_mean', 'stated' from lm where abs(missingness_mean - mean_m) > 0.0101
union all select load_id, 'missingness_max', 'stated' from lm where abs(missingness_max - max_m) > 0.0101""",
}
