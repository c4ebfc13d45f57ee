"""What goes through the driver as a broadcast is small by its real size, not by its planned one."""

import random

from tidelane.llm import minhash


def broadcast_rows(spark, since: int) -> list[int]:
    """Rows of the broadcasts of all executions from number ``since`` on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    listed = store.executionsList()
    for i in range(since, listed.size()):
        number = listed.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            metrics = node.metrics().iterator()
            while node.name() == "BroadcastExchange" and metrics.hasNext():
                metric = metrics.next()
                shown = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and shown.isDefined():
                    out.append(int(shown.get().replace(",", "")))
    return out


def test_near_dedup_broadcasts_only_what_is_measured_to_be_small(spark):
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(300)]
    rows = [(2 * i + j, t + " end" * j) for i, t in enumerate(texts) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    name, limit = "spark.sql.autoBroadcastJoinThreshold", 60_000
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
        assert spark.conf.get(name) == str(limit)
    finally:
        spark.conf.set(name, before)
    assert found == {i: i - i % 2 for i in range(600)}
    assert max(broadcast_rows(spark, since), default=0) <= limit / 16  # a row has 16 bytes at least
