"""What the tests of operators share."""


def shuffled_rows(spark):
    """Rows that all stages of this session have shuffled so far."""
    gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    every = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(every.apply(k).shuffleWriteRecords() for k in range(every.length()))
