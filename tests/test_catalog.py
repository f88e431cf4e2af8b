from types import SimpleNamespace

import pytest

from quernel import catalog
from quernel.catalog import ORACLE_SQL, QUERIES
from quernel.sources import scratch

#: Queries whose filter must let some rows through and hold others back, with the query that has all of them.
CUT = {"fts_and": None, "fts_not": None, "hybrid_threshold": "hybrid_merge", "hybrid_since": "hybrid_merge", "hybrid_exclude": "hybrid_merge"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(CUT))
def test_filters_cut(name, spark, sf_dir):
    n = QUERIES[name](spark, sf_dir).count()
    assert n > 0
    if CUT[name]:
        assert n < QUERIES[CUT[name]](spark, sf_dir).count()


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_incremental_refresh_stays_in_the_shared_folder(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_scratch", lambda _: f"file://{tmp_path}/index")
    found = QUERIES["incremental_refresh"](spark, sf_dir)
    assert found.inputFiles() and all(str(tmp_path) in f for f in found.inputFiles())
    assert found.count()


def test_scratch_is_in_the_checkpoint_folder():
    session = lambda conf, master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)), sparkContext=SimpleNamespace(master=master))
    assert catalog._scratch(session({"spark.checkpoint.dir": "hdfs://shared/"}, "yarn")).startswith("hdfs://shared/quernel/index-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session({}, "yarn"))
