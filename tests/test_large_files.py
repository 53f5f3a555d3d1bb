import random

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import parquet as pq

from augsearch.sources import collection, large_files


def cell_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def folder(tmp_path):
    r = random.Random(0)
    words = ["plain", 'with ""quotes""', "two\nlines", "comma, here", "", "--", "\n\n", "é😀"]
    lines = ["id,text,mixed,late"]
    for i in range(400):
        text = r.choice(words)
        quoted = f'"{text}"' if any(c in text for c in ',\n"') else text
        lines.append(f'{i},{quoted},{i if i < 300 else i + 0.5},{"" if i < 350 else "x" if i == 399 else 7}')
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.tsv").write_text("n\tdate\n" + "".join(f"{i}\t2020-01-0{i % 9 + 1}\n" for i in range(500)) + "last\t")
    table = pa.table({"k": list(range(3000)), "s": [f"v{i % 17}" if i % 5 else None for i in range(3000)], "f": np.arange(3000) / 3})
    pq.write_table(table, tmp_path / "c.parquet", row_group_size=250)
    (tmp_path / "small.csv").write_text("x\n1\n")
    return str(tmp_path)


@pytest.mark.parametrize("column_types", ["all", "string"])
def test_ranges_give_what_whole_files_give(spark, folder, column_types):
    whole = cell_rows(collection.cells(spark, folder, column_types))
    assert len({r[0] for r in whole}) >= 2
    for split in (97, 1000, 5000):
        assert cell_rows(collection.cells(spark, folder, column_types, split_bytes=split)) == whole


def test_no_task_has_a_whole_file(spark, folder):
    files = spark.createDataFrame([("file:///x", "x", 3 << 30)], "path string, table_id string, length long")
    cut = large_files.ranges(files, 64 << 20)
    rows = cut.collect()
    assert len(rows) == 48 and max(r.end - r.start for r in rows) <= 64 << 20 and sum(r.end - r.start for r in rows) == 3 << 30
    assert cut.rdd.getNumPartitions() == 48


def test_records_of_any_range(tmp_path):
    data = b'a,b\n1,"x\ny"\n2,"q""\n"\n3,\n\n4,z'
    (tmp_path / "t.csv").write_bytes(data)
    for size in range(1, len(data) + 1):
        parts, quotes = [], 0
        for start in range(0, len(data), size):
            end = min(start + size, len(data))
            with large_files.opened(f"file:{tmp_path}/t.csv") as f:
                parts.append(large_files.records(f, start, end, len(data), quotes % 2 == 1))
            quotes += data[max(0, start - 1) : max(0, end - 1)].count(b'"')
        assert b"".join(parts) == data, size


def test_types_of_ranges():
    assert large_files.merged(["null", "int64", "int64"]) == "int64" and large_files.merged(["int64", "double", "null"]) == "double"
    assert large_files.merged(["bool", "int64"]) == "string" and large_files.merged(["null"]) == "null" and large_files.merged(["date32[day]", "timestamp[s]"]) == "timestamp[s]"


def test_schemas_from_footers(spark, folder):
    plan = collection.parquet_schemas(spark, folder)
    assert [(r.col_ord, r.col_name) for r in plan.collect()] == [(0, "k"), (1, "s"), (2, "f")]
    assert "ReadSchema: struct<path:string>" in plan._jdf.queryExecution().executedPlan().toString()
