import corpus_pipeline
import pytest
import __spark_entry__
from pyspark.sql import functions as F

from .test_corpus_operators import LIBRARY, brute_components, brute_fingerprint
from .conftest import SMALL


@pytest.mark.parametrize("which", ["docs", "odd", "nothing", "clashing"])
def test_stages(request, spark, which):
    frame = request.getfixturevalue(which)
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.stored(stage(spark, kept, SMALL))
        assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
        if name == "near-duplicates":
            rows = [(r.doc_id, brute_fingerprint(r.text)) for r in before.collect()]
            roots = brute_components([f for _, f in rows], 3)
            groups = {}
            for i, f in rows:
                groups.setdefault(roots[f], []).append(i)
            first = sorted(str(min((i for i in g if i is not None), default=None)) for g in groups.values())
            assert sorted(str(r.doc_id) for r in kept.collect()) == first
    final = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert sorted(r.ids for r in final.collect()) == sorted(LIBRARY.encode(r.text or "") for r in kept.collect())


def test_repeated_and_unnamed_rows_keep_one_each(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "x y z w v"), (3, "k l m n"), (3, "k l m n"), (3, "o p q r s"), (9, "a b c d")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.near_duplicates(spark, frame, SMALL).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(9, "a b c d"), (None, "x y z w v"), (3, "k l m n"), (3, "o p q r s")]))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", ["op1_top_k", "op3_url_filter", "op7_quality_rules"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    found = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = con.execute(__spark_entry__.oracle_sql()[name]).df()[columns].itertuples(index=False)
    clean = lambda rows: sorted(str([None if x != x else x for x in r]) for r in rows)
    assert clean(tuple(r) for r in found.select(columns).toPandas().itertuples(index=False)) == clean(map(tuple, expected))
    assert found.filter(F.lit(True)).count() > 0
