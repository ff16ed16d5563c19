import random

from pyspark.sql import functions as F

from vozlake.functions.blocks import longest_blocks
from vozlake.operators import scoring
from vozlake.sinks.json_array import read_json_array, write_json_array

SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def covered(blocks):
    return {i + k: j + k for i, j, n in blocks for k in range(n)}


def test_short_lists_have_the_blocks_of_long_ones():
    rng = random.Random(3)
    for _ in range(300):
        words = "abcdefgh"[: rng.choice([2, 3, 8])]
        one, other = ([rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(2))
        assert covered(longest_blocks(one, other)) == covered(longest_blocks(one, other, short=0))


def test_python_workers_get_small_batches(spark, tmp_path):
    pairs = spark.range(300).select("id", F.expr("repeat('a b ', 50)").alias("ref"), F.expr("repeat('a c ', 50)").alias("hyp"))
    spark.conf.unset(SIZE)
    assert scoring.operations(pairs, ["id"]).count() == 300 * 100 and spark.conf.get(SIZE) == "1m"
    spark.conf.unset(SIZE)
    write_json_array(pairs, F.struct("id"), str(tmp_path / "a"), ["id"])
    assert spark.conf.get(SIZE) == "4m" and read_json_array(spark, str(tmp_path / "a"), "struct<id:long>").count() == 300
