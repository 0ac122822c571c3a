"""Layout invariance: the same rows with one shuffle partition and tiny
file splits as with the default layout."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.test_oracle import _rows

NAMES = ["line_index", "shuffle", "split_head", "pack_blocks", "stall_counter", "running_cost", "rerank",
         "bleu", "chrf", "read_lines_roundtrip", "paired_randomization", "keep_last_k", "lm_dataset"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_under_another_layout(spark, name):
    q = E.queries()[name]
    df = q(spark, SF_SMALL)
    base = _rows(df.toPandas())
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        other = _rows(q(spark, SF_SMALL).toPandas())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert base == other
