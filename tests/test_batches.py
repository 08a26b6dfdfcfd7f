import pytest

from loomgraph.plans import queries as Q

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["section_chunks", "picked_blocks", "html_text", "concept_positions"])
def test_whole_texts_travel_in_small_batches(spark, name):
    spark.conf.set(SETTING, "10000")
    Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(SETTING)) <= 1000
