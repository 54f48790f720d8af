import os

import pytest

from grovemill import catalog

SF = "/root/testdata/sf0.001"
SOME = ["project_label_features", "cat_hash_bucket", "bins_equal_width_nan", "bins_equal_frequency", "bins_entropy", "bins_variance", "discretize_numeric", "loss_gradient_hinge", "loss_node_estimate_logloss", "hist_partials", "hist_grouping_sets", "split_numeric_nan", "split_cat_ordered", "split_class_entropy", "split_class_gini", "split_cat_random", "tree_fit_subtrees", "model_saved_and_loaded", "delimited_scan", "runner_fit", "label_rules", "forest_vote", "bag_poisson", "tree_fit_depth3", "gbt_deviance_history", "var_importance", "forest_fit", "topk_importance", "median_upper", "kth_element", "loss_node_estimate_laplacian"]


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("lineitem", "part", "orders", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_delimited_scan_sums_rows_by_hash(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    flags = "case when id % 7 = 0 then null else substr('ANR', cast(id % 3 as int) + 1, 1) end as l_returnflag"
    texts = "case when id % 5 = 0 or id % 3 = 1 and id % 7 > 0 then null else concat('s', id % 40) end as l_linestatus"
    spark.range(0, 2000, 1, 3).selectExpr(flags, texts, "id * 7.5D as l_extendedprice", "id % 50 + 0.25D as l_quantity").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    seen, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (seen.append(self), collect(self))[1])
    got = catalog.queries()["delimited_scan"](spark, f"file://{tmp_path}")
    monkeypatch.undo()
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(catalog.oracle_sql()["delimited_scan"]).fetchall(), key=str)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[-1]
    # Read from below: up to the first exchange by key stand the rows, which are summed up by hash, of flags alone.
    rows = plan[plan.rindex("Exchange hashpartitioning(l_returnflag") :]
    assert "HashAggregate" in rows and "Sort" not in rows and "mode" not in rows.split("\n")[0]


def test_the_entry_stands_without_the_corpus_package(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def broken(name, *args):
        if name == "grovemill.llm.queries" or name == "corpus_pipeline":
            raise ImportError("a missing dependency")
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())
