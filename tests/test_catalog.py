"""The registry, and on small tables every query with SQL against DuckDB."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_queries_are_named_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert said.returncode == 0 and int(said.stdout.split()[-1]) > 60, said.stderr[-500:]


def cells(rows):
    out = []
    for r in rows:
        line = []
        for k in sorted(r):
            v = r[k]
            line.append("" if v is None else str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
        out.append(tuple(line))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", ["trace_rerun_kind", "trace_freshness", "graph_closure", "graph_prune", "feature_source_reach", "refine_backward_source", "lineage_tuples", "cell_symbol_edges", "metric_tuples", "kb_match_spans", "mining_sample", "source_hashes", "symbol_deferred", "process_relations", "leakage_seeded", "flow_cross_cells", "mining_validate", "lineage_gold_tuples"])
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from quillspark.plans import catalog

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    got = [r.asDict() for r in catalog.QUERIES[name](spark, DATA).collect()]
    assert sorted(got[0]) == sorted(names) and cells(got) == cells(rows)
