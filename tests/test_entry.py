import duckdb
import pytest

import __spark_entry__ as entry
from factlens.plans import statements

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["snapshot_diff", "time_sliced_bfs", "node_merge", "candidate_entities", "vector_topk", "stored_window_snapshot", "stored_neighbors_2hop", "stored_bfs", "interval_overlap_all", "interval_overlap_own", "as_of_latest", "graph_stats", "neighbors_2hop", "neighbors_bag", *statements.ORACLES])
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "embeddings", "events", "customer", "nation", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    norm = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v) for v in r) for r in rows)
    assert norm(tuple(r) for r in got.select(cols).collect()) == norm(want)
