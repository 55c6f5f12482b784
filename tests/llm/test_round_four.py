"""Filter audit: the ranges of texts come of one pass, however long the prefix that near copies share."""

from lodestead.llm import audit


def test_ranges_of_near_copies_take_no_more_runs(spark):
    store = spark._jsparkSession.sharedState().statusStore()

    def runs(length):
        frame = spark.createDataFrame([("x" * length + f" {k:03}",) for k in range(60)] + [("y" * length,)] * 40, "text string")
        before = store.executionsCount()
        levels, total = audit.long_ranges(frame, 100)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        assert total == 60 * (length + 4) + 40 * length
        assert levels[-1][0] * audit.GROWTH > length  # told apart behind what they share
        return store.executionsCount() - before

    assert runs(2_000) == runs(6)
