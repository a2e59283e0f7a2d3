"""Driver contract: entry runs; every oracle belongs to a query; quick oracle checks."""
import duckdb
import pytest

import __spark_entry__ as E

QUICK = ["flagship", "target_prefix", "entity_remarks", "txn_mode", "strip_html", "topk_codes",
         "calibration", "temporal_split", "split_stats", "tfidf_vocab"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["target", "n_rows", "total_cents", "entity_hits"]
    assert df.count() > 0


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_oracle_agrees(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "pages", "embeddings", "events", "documents",
              "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    df = E.queries()[name](spark, sf_small)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, rel.fetchall())
