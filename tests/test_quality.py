"""Profiles against plain Python counts; which chunks are read is checked on files made for it."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kinfold.sources.footers import HEADER_BYTES, pages
from kinfold.operators.quality import _source, as_calendar_date, chunk_counts, chunk_facts, column_facts, load_findings, load_shifts, profile_columns, value_counts


@pytest.fixture
def table(tmp_path):
    def write(columns, row_group_size=4, files=2):
        folder = tmp_path / "t.parquet"
        folder.mkdir()
        n = len(next(iter(columns.values())))
        step = max(1, -(-n // files))
        for i in range(0, max(n, 1), step):
            pq.write_table(pa.table({k: v[i:i + step] for k, v in columns.items()}), folder / f"p{i}.parquet", row_group_size=row_group_size)
        return str(folder)

    return write


def test_counts_and_profile(spark, table):
    v = ["a", None, "", "  ", "a", "b", "a", "\x1c", "c", "c", None, "x" * 100_000]
    g = [1] * 6 + [2] * 6
    path = table({"g": pa.array(g, pa.int32()), "v": pa.array(v), "w": pa.array([7] * 12), "extra": pa.array(range(12))})
    counts = value_counts(spark, path, ["v", "w"], "g")
    got = {(r["grp"], r["column_name"], r["value"]): r["n"] for r in counts.collect()}
    want = pd.DataFrame({"g": g, "v": v}).groupby(["g", "v"], dropna=False).size()
    assert {(k[0], k[2]): n for k, n in got.items() if k[1] == "v"} == {(str(a), None if pd.isna(b) else b): n for (a, b), n in want.items()}
    assert got["1", "w", "7"] == 6
    p = {(r["grp"], r["column_name"]): r for r in profile_columns(counts).collect()}
    assert (p["1", "v"]["rows_total"], p["1", "v"]["nulls"], p["1", "v"]["blanks"], p["1", "v"]["distinct_values"]) == (6, 1, 2, 2)
    assert p["2", "v"]["max_value"] == "x" * 100_000 and p["2", "w"]["missing_share"] == 0


class Watched:
    """A file that notes which of its bytes are read."""

    def __init__(self, uri):
        self.raw, self.read_bytes = _source(uri), set()
        self.closed = False

    def seek(self, at, whence=0):
        return self.raw.seek(at, whence)

    def tell(self):
        return self.raw.tell()

    def size(self):
        return self.raw.size()

    def read(self, n=-1):
        at = self.raw.tell()
        data = self.raw.read(n)
        self.read_bytes |= set(range(at, at + len(data)))
        return data

    def readable(self):
        return True

    def seekable(self):
        return True

    def flush(self):
        pass

    def close(self):
        self.closed = True


def only_file(path):
    import os

    return "file://" + os.path.join(path, os.listdir(path)[0])


def rows_of(batches, *names):
    return [tuple(r[n] for n in names) for b in batches for r in b.to_pylist()]


def test_footers_answer_where_they_can(table):
    path = table({"g": pa.array([3, 3, 3]), "all_null": pa.array([None] * 3, pa.string()), "one": pa.array([5, 5, 5]), "s": pa.array(["q", None, "q"]), "t": pa.array(["q", "q", "r"])}, files=1)
    columns = ["all_null", "one", "s", "t"]
    out = {(c, v): (n, origin) for c, v, n, origin in rows_of(chunk_counts("d", only_file(path), 0, "g", columns), "column_name", "value", "n", "origin")}
    assert out == {("all_null", None): (3, "footer"), ("one", "5"): (3, "footer"), ("s", "q"): (2, "dictionary"), ("s", None): (1, "dictionary"), ("t", "q"): (2, "pages"), ("t", "r"): (1, "pages")}


@pytest.mark.parametrize("compression", ["none", "snappy", "zstd", "gzip"])
@pytest.mark.parametrize("version", ["1.0", "2.0"])
def test_pages_stay_unread_where_a_dictionary_suffices(tmp_path, compression, version):
    n = 40_000
    values = {"none": pa.nulls(n, pa.string()), "s": pa.array([None if i % 10 == 0 else f"value number {i * 7919 % 500}" for i in range(n)]), "i": pa.array([i * 7919 % 300 - 100 for i in range(n)], pa.int32()),
              "t": pa.array([i % 50 * 1_000_003 for i in range(n)], pa.timestamp("us", "UTC")), "free": pa.array([f"{i}-{i * i}" for i in range(n)])}
    file = tmp_path / "f.parquet"
    pq.write_table(pa.table(values), file, compression=compression, data_page_version=version, use_dictionary=["s", "i", "t"], data_page_size=4096)
    uri, seen = f"file://{file}", []
    got = {}
    for name in values:
        watch = []
        rows = rows_of(chunk_facts("d", uri, 0, [name], lambda u: watch.append(Watched(u)) or watch[0]), "value", "rows", "nulls", "low", "high", "origin")
        got[name] = (rows[0][1:], {r[0] for r in rows[1:]})
        seen.append(watch[0].read_bytes)
    text = lambda c: {str(x) for x in values[c].drop_null().to_pylist()}
    assert got["s"] == ((n, n // 10, min(text("s")), max(text("s")), "dictionary"), text("s"))
    assert got["i"] == ((n, 0, "-100", "199", "dictionary"), text("i"))
    assert got["t"][0][4] == "dictionary" and len(got["t"][1]) == 50 and got["t"][0][2] == "1970-01-01 00:00:00.000000"
    assert got["free"][0][4] == "pages" and got["free"][1] == text("free") and got["none"] == ((n, n, None, None, "footer"), set())
    meta = pq.ParquetFile(file).metadata.row_group(0)
    own = set(range(meta.column(0).data_page_offset, meta.column(0).data_page_offset + meta.column(0).total_compressed_size))
    assert own and not own & seen[0]  # a chunk that the footer answers is not touched
    # of one that its dictionary answers, only that page and the other pages' headers
    if compression == "none" and version == "1.0":
        heads = [c for k, _, c, _ in pages(open(file, "rb"), meta.column(1)) if k == 0]
        assert len(heads) > 5 and not any(c + HEADER_BYTES in seen[1] for c in heads[:-1])


def test_unknown_writers_are_not_trusted(tmp_path):
    from kinfold.sources.footers import dictionary_values

    pq.write_table(pa.table({"s": ["a", "b"]}), tmp_path / "f.parquet")
    chunk = pq.ParquetFile(tmp_path / "f.parquet").metadata.row_group(0).column(0)
    with open(tmp_path / "f.parquet", "rb") as file:
        assert dictionary_values(file, chunk, pa.string(), "parquet-cpp-arrow version 1").to_pylist() == ["a", "b"]
        assert dictionary_values(file, chunk, pa.string(), "some other writer") is None


def test_facts_of_whole_tables(spark, table):
    v = ["a", None, "", "b"] * 3
    path = table({"v": pa.array(v), "n": pa.array([9, 10, -2, 11] * 3), "x": pa.array([1.5, float("nan"), None, 2.0] * 3), "none": pa.nulls(12, pa.string())}, row_group_size=3)
    got = {r["column_name"]: tuple(r)[2:] for r in column_facts(spark, {"t": path}, ["v", "n", "x", "none"]).collect()}
    assert got["v"][:5] == (12, 3, 3, "", "b") and got["n"][:5] == (12, 0, 4, "-2", "11") and got["none"] == (12, 12, 0, None, None, 4, 0, 0)
    assert got["x"][:3] == (12, 3, 3) and sum(got["v"][5:]) == 4


def test_shifts_between_loads(spark):
    rows = [("d", "1", "c", "ab12", 8), ("d", "1", "c", None, 2), ("d", "2", "c", "zz9", 5), ("d", "2", "c", "??", 5), ("d", "10", "c", "q7", 1)]
    df = spark.createDataFrame(rows, "dataset_id string, grp string, column_name string, value string, n long")
    assert sorted((r["grp"], r["before"], round(r["shift"], 6)) for r in load_shifts(df).collect()) == [("10", "2", .5), ("2", "1", .5)]
    assert load_shifts(df.limit(0)).collect() == []


def test_empty_table(spark, table):
    path = table({"g": pa.array([], pa.int32()), "v": pa.array([], pa.string())})
    assert value_counts(spark, path, ["v"], "g").collect() == [] == column_facts(spark, {"t": path}, ["v"]).collect()


def test_calendar_dates(spark):
    df = spark.createDataFrame([("2020-02-29",), ("29/02/2021",), ("20201301",), ("20201231",), ("x",), (None,)], "v string")
    assert [str(r[0]) for r in df.select(as_calendar_date(df["v"])).collect()] == ["2020-02-29", "None", "None", "2020-12-31", "None", "None"]


def test_findings(spark):
    base = spark.createDataFrame(
        [("s", "date_value", 0.1, r"^\d{4}-\d{2}-\d{2}$", "1930-01-01", "2019-12-31", None, None), ("s", "label_value", 0.0, None, None, None, 0.75, None),
         ("s", "group_value", 0.0, r"^grp-[A-Z]{2}-\d{4}$", None, None, None, '{"QU": 0.5, "VE": 0.5}')],
        "dataset_id string, column_name string, null_rate double, value_pattern string, min_value string, max_value string, min_distinct_share double, category_shares string")
    counts = spark.createDataFrame(
        [("s", "1", "date_value", "2000-01-01", 9), ("s", "1", "date_value", "2000-13-01", 1), ("s", "1", "label_value", "a", 10), ("s", "1", "group_value", "grp-ZA-0001", 10),
         ("s", "2", "date_value", None, 5), ("s", "2", "date_value", "2000-01-01", 5), ("s", "2", "label_value", "a", 10), ("s", "2", "group_value", "grp-QU-0001", 5), ("s", "2", "group_value", "grp-VE-0001", 5)],
        "dataset_id string, grp string, column_name string, value string, n long")
    stated = spark.createDataFrame([("s", 1, 10, 0.0, 0.0), ("s", 2, 11, 0.1667, 0.4)], "dataset_id string, load_id int, row_count long, missingness_mean double, missingness_max double")
    assert {tuple(r) for r in load_findings(counts, base, stated).collect()} == {
        (1, "date_value", "range"), (1, "label_value", "distinct"), (1, "group_value", "distribution"), (2, "date_value", "null_rate"), (2, "label_value", "distinct"),
        (2, "row_count", "stated"), (2, "missingness_max", "stated")}
