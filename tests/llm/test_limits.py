"""What the driver holds of a sketch."""

from __future__ import annotations

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa

from emberlog.llm import sketches


def test_driver_never_holds_a_sketch_whole(spark):
    bits = 1 << 26
    rows = spark.createDataFrame([(k,) for k in range(0, 3000, 7)], "key long").repartition(3)

    def values(batch: pa.RecordBatch):
        yield batch.column(0).to_numpy().view(np.uint64)
        yield batch.column(0).to_numpy().view(np.uint64)

    rows = sketches.sketch_rows(rows, lambda: sketches.SeenTwice(bits), values)
    tracemalloc.start()
    found = sketches.merged(rows, sketches.SeenTwice(bits), bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < bits // 8

    def tested(batches):
        test = sketches.SeenTwice(bits)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(test.test(found.value, own)))

    assert spark.range(3000).mapInArrow(tested, "id long").count() == len(range(0, 3000, 7))


def test_a_sent_bitmap_needs_nothing_of_the_package():
    whole = np.zeros(8 * sketches.BLOCK // 8, np.uint8)
    whole[sketches.BLOCK // 8 * 3 + 5] = 9
    whole[-1] = 255
    step = sketches.BLOCK // 8
    blocks = {k: sketches._pack(whole[k * step : (k + 1) * step]) for k in (3, 7)}
    sent = pickle.dumps(sketches._Bitmap(sketches._joined(blocks, 8)))
    assert b"emberlog" not in sent and len(sent) < 1000
    assert (pickle.loads(sent) == whole).all()
