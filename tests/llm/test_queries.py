import pytest

import __spark_entry__
from loomgraph.llm import queries as Q
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    compare(spark, SF, Q.queries()[name], Q.oracle_sql()[name])


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name in ("op2_audio", "op5_near_dup", "op9_langid", "op8_phrases", "op10_ann"):
            got = []
            for n in ("3", "7"):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                got.append(sorted(map(tuple, Q.queries()[name](spark, SF).collect())))
            assert got[0] == got[1], name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
