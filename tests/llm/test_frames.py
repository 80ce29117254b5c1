from pyspark.sql import functions as F

from staygrid.llm.frames import least_by


def test_least_by_hash(spark):
    rows = spark.range(3000).withColumn("turn", F.xxhash64("id"))
    ordered = [r.id for r in rows.orderBy("turn", "id").collect()]
    for n in (0, 1, 7, 2999, 3000, 5000):
        assert sorted(r.id for r in least_by(rows, "turn", n).collect()) == sorted(ordered[:n])
    same = spark.range(50).withColumn("turn", F.lit(-5).cast("long"))
    assert sorted(r.id for r in least_by(same, "turn", 3).collect()) == [0, 1, 2]
    assert least_by(rows.limit(0), "turn", 5).collect() == []
