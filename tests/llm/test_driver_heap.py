"""A driver's heap that garbage has grown is given back between writes."""

import gc

from strataflow.llm.common import HEAP, materialize


def test_heap_shrinks_after_a_write(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    runtime = jvm.java.lang.Runtime.getRuntime()
    held = []
    while runtime.totalMemory() <= 1.1 * HEAP * runtime.maxMemory():
        held.append(gateway.new_array(jvm.long, 1 << 20))
    held.clear()
    gc.collect()
    assert runtime.totalMemory() > HEAP * runtime.maxMemory()
    assert materialize(spark.range(3), "heap").count() == 3
    assert runtime.totalMemory() <= HEAP * runtime.maxMemory()
