from collections import Counter

import pytest

from seqloom.operators import layout as L


@pytest.mark.parametrize("partitions", [1, 4])
def test_null_and_repeated_keys_keep_every_row_once(spark, partitions):
    rows = [(s, k, i) for i, (s, k) in enumerate([("train", 1), ("train", 1), ("train", 1), ("train", None), ("train", None), (None, 4),
                                                  (None, 4), (None, None), ("val", 7)])]
    df = spark.createDataFrame(rows, "split string, order_key long, body long").repartition(partitions)
    sh = L.contiguous_shards(df, ["order_key"], n_max=2)
    assert sh.columns == ["split", "order_key", "body", "row", "shard"]
    got = sh.collect()
    assert sorted((r["body"], r["split"], r["order_key"]) for r in got) == sorted((i, s, k) for s, k, i in rows)
    for split, n in (("train", 5), (None, 3), ("val", 1)):
        mine = [r for r in got if r["split"] == split]
        assert sorted(r["row"] for r in mine) == list(range(n))
        assert Counter(r["shard"] for r in mine) == ({0: n - n // 2, 1: n // 2} if n > 1 else {0: 1})
