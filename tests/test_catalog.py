"""Every catalogue query against its SQL on the small tables."""

import datetime
import decimal

import duckdb
import pytest

from paperloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR).toArrow()
    if name not in catalog.ORACLE:
        assert got.num_rows > 0
        return
    cur = db.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    cols = sorted(got.column_names)
    assert cols == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.to_pylist()), key=str) == want


def test_rare_terms(spark):
    """Terms by document, those under five times in all documents too."""
    got = catalog.QUERIES["document_terms"](spark, DIR)
    assert got.columns == ["doc_id", "term", "n"]
    assert got.groupBy("term").sum("n").filter("`sum(n)` < 5").count() > 0


def test_large_part_keys(spark, tmp_path):
    """Keys whose names have more than three letters, beside a null and the edges: as the SQL has them."""
    keys = [None, 0, 1, 25, 26, 701, 702, 18277, 18278, 18279, 475253, 475254, 1_200_000, 2**31, 2**53 + 1, 2**62]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE["cell_addresses"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["cell_addresses"](spark, str(tmp_path)).select("p_partkey", "letters", "number").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
