"""Every query of the engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from shardlight import queries

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", [*queries.ORACLE_SQL])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    got = plain([r.asDict() for r in df.collect()], sorted(names))
    assert got == plain(want, sorted(names)) and got


def test_pages_as_images(spark):
    rows = queries.carve_pages(spark, SF).collect()
    assert rows and {r["format"] for r in rows} <= {"xml", "html", "json", "rtf", "pdf"}


def test_text_walkers_spread_the_keys_of_a_small_file(spark, monkeypatch):
    seen = []
    whole = queries.carve.carve_values
    monkeypatch.setattr(queries, "TASK_KEYS", 10)
    monkeypatch.setattr(queries.carve, "carve_values", lambda rows, *more: seen.append(rows) or whole(rows, *more))
    got = queries.text_walkers(spark, SF).count()
    keys = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert got == 4 * keys and seen[0].rdd.getNumPartitions() == -(-keys // 10) > 4
