"""The operators' queries with SQL against DuckDB, on the small tables and on tables with planted cases."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from tidemark.llm import queries


def compare(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = queries.queries()[name](spark, str(folder))
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    found = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert rows == sorted(found, key=repr)
    return got.columns, rows


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, folder, name):
    assert compare(spark, folder, name)[1]


def test_embeddings_with_links(spark, tmp_path):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((40, 32))
    data = [Row(vec_id=1000 - i, embedding=(base[i % 40] + 0.06 * (i % 5) * rng.standard_normal(32)).tolist(), label=i % 3) for i in range(600)]
    data += [Row(vec_id=2000 + i, embedding=v, label=1) for i, v in enumerate((None, [], [0.0] * 32, [1.0, None], [float("nan")] * 32, [float("inf")] + [0.0] * 31, base[0].tolist(), base[0].tolist()))]
    data.append(Row(vec_id=3000, embedding=base[0].tolist(), label=None))
    # One id for vectors that are far apart, near others, equal, and in two labels.
    data += [Row(vec_id=4000 + i % 3, embedding=(base[i] * (-1 if i < 3 else 1)).tolist(), label=i % 2) for i in range(12)]
    data += [Row(vec_id=4000, embedding=base[3].tolist(), label=1), Row(vec_id=4001, embedding=(-base[2]).tolist(), label=0)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    columns, rows = compare(spark, tmp_path, "op2_embedding_dedup")
    at = sorted(columns).index("n_links")
    assert sum(r[at] for r in rows) > 1000


def test_simhash_query(spark, sf_dir):
    from tests.llm.test_operators import brute_fingerprint

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op3_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {r["doc_id"]: r["fingerprint"] for r in got.collect()} == {k: f"{brute_fingerprint(t):016x}" for k, t in texts.items()}
