"""What streams past a block is dealt over several tasks where it may be the whole of a large table."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tastemark.operators import cosine_join
from tastemark.operators.similarity import Recipe, neighbours


def dense(spark, n=150, width=6):
    rnd = random.Random(4)
    return spark.createDataFrame([(r, c, rnd.gauss(0, 1)) for r in range(n) for c in range(width)], "row long, col long, value double")


def test_lists_do_not_depend_on_the_slices_and_a_task_streams_less(spark, monkeypatch):
    cells = dense(spark)
    lists = lambda: sorted(tuple(r) for r in neighbours(cells, 5, block_rows=40).withColumn("sim", F.round("sim", 8)).collect())
    most, real = [], cosine_join._dealt
    monkeypatch.setattr(cosine_join, "_dealt", lambda stream, blocks: most.append(stream.where("kind = 1").groupBy("block").count().agg(F.max("count")).first()[0]) or real(stream, blocks))
    one = lists()
    whole, most[:] = max(x for x in most if x), []
    monkeypatch.setattr(cosine_join, "STREAM_CELLS", 200)
    assert lists() == one and len(one) == 150 * 5
    assert max(x for x in most if x) < whole / 2


def test_prefixes_of_a_dense_block_need_little_more_than_its_cells():
    import tracemalloc

    rnd, n, width = np.random.default_rng(2), 20_000, 16
    lists = lambda x, kind: pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), pa.array(x, kind))
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.arange(n)), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), pa.array(np.ones(n))), lists(np.zeros(n * width, np.int32), pa.int32()),
        lists(np.tile(np.arange(width), n), pa.int64()), lists(rnd.normal(size=n * width), pa.float64()),
    ], names=["row", "norm", "src", "col", "v"])
    block = cosine_join.Block([cosine_join.Cells(batch)], [Recipe("")], 5)
    tracemalloc.start()
    row, own, src, col = block.prefix()  # no floors yet: every cell is told
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.all() and len(row) == n * width and set(col.tolist()) == set(range(width))
    assert peak < 180 * n * width
