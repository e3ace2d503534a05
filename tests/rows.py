"""What a query made Spark do: rows that its joins put out, read from the metrics of its plans."""


def joined_rows(spark, run, kind: str = "Join") -> int:
    """The most rows that one join, or node of another kind, put out while ``run`` was called."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    most, found = 0, store.executionsList(before, 100_000)
    for k in range(found.size()):
        i = found.apply(k).executionId()
        values, nodes = store.executionMetrics(i), store.planGraph(i).allNodes()
        for n in range(nodes.size()):
            node = nodes.apply(n)
            if kind in node.name():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most
