from pyspark.sql import functions as F

import __spark_entry__ as E
from tonality.functions import labels as L
from tonality.functions import text as X
from tonality.operators import rank
from tonality.operators.lookup import demojize
from tonality.sources import tables as S

from table_dirs import SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 6 and df.columns == ["split", "label_numeric", "sentiment_label", "rows", "clean_chars"]
    assert sum(r.rows for r in rows) == S.table(spark, SF001, "documents").count()


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 45


def test_top_k_is_take_ordered(spark):
    lex = S.emoji_lexicon(spark, SF001)
    df = rank.top_k(lex.select("Emoji", "Occurrences"), ["Occurrences"], 10, tie_break=["Emoji"])
    assert "TakeOrderedAndProject" in _plan(df)


def test_lookup_is_broadcast(spark):
    d = demojize(S.symbols(spark, SF001), "symbol", S.symbol_names(spark, SF001))
    assert "BroadcastHashJoin" in _plan(d)


def test_expressions_stay_in_jvm_and_prune(spark):
    r = S.reviews(spark, SF001)
    df = r.select(X.clean_ascii("verified_reviews").alias("c"), L.label_rating("rating", "ge4").alias("y"))
    p = _plan(df)
    assert "Python" not in p and "ArrowEval" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_filter_pushed_to_scan(spark):
    df = S.table(spark, SF001, "orders").where(F.col("o_orderkey") < 100).select("o_orderkey")
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)]" in _plan(df)


def test_splits_read_documents_once_and_move_no_text(spark):
    from tonality.plans.pipelines import text_info

    info = text_info(S.reviews(spark, SF001))
    plan = _plan(info)
    assert plan.count("documents.parquet") == 1
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_no_size_switch_in_the_sources():
    import tonality.sources.tables as tables

    assert "getsize" not in open(tables.__file__).read()


def test_cluster_conf_sizes_partitions():
    from tonality.session import cluster_conf
    c = cluster_conf(100 * (1 << 40), 8000)          # 100 TB on 8000 cores
    assert int(c["spark.sql.shuffle.partitions"]) == 409600
    assert cluster_conf(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"
    assert cluster_conf(1 << 30, 8, image_rows=True)["spark.sql.execution.arrow.maxRecordsPerBatch"] == "64"


def test_word_lists_are_cleaned_once(spark):
    for name in ("encode_tokens", "bag_of_words"):
        plan = _plan(E.queries()[name](spark, SF001))
        assert "token-bundle" in plan and "regexp_replace" not in plan, name
