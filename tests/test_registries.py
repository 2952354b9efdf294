"""Registries between batches: equal to one batch, after a restart and after a crash in between."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.operators import founding
from lumenlake.streaming.registries import FounderRegistry
from tests.test_founding import people, plain

SCHEMA = "`group` string, item string, vector array<double>"


def items(n, seed):
    groups = np.random.default_rng(seed).integers(0, 3, size=n)
    return [(f"g{g}" if g else None, f"{i:05d}", v) for i, (g, v) in enumerate(zip(groups, people(n, 5, 1.2, seed)))]


def assigned(registry):
    return sorted(((r.grp, r.item, r.number, None if r.score is None else round(r.score, 9)) for r in registry.assigned.read().collect()), key=str)


def expected(rows, least):
    """Numbers by group from the plain fold."""
    found = plain(sorted(rows, key=lambda r: (r[0] or "", r[1])), least)
    numbers = {}
    for g, i, f, _ in sorted(found, key=lambda r: (r[0] or "", r[1])):
        if f == i:
            numbers[g, i] = sum(k[0] == g for k in numbers)
    return sorted(((g, i, numbers.get((g, f)), s) for g, i, f, s in found), key=str)


@pytest.mark.parametrize("small", [8_192, 15])
def test_a_stream_in_batches_equals_one_fold(spark, tmp_path, small):
    rows = [*items(90, 3), ("g1", "00090", None), ("g2", "00091", [1.0])]
    registry = FounderRegistry(spark, f"file://{tmp_path}/registry", 0.6, founding.FoundingParams(small=small, slice_rows=16, chunk=4), buckets=2)
    source = tmp_path / "in"
    for a, b in ((0, 40), (40, 70), (70, 92)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        registry.run(stream, f"file://{tmp_path}/checkpoint").awaitTermination()  # a new query each time: it goes on from the checkpoint
    assert assigned(registry) == expected(rows, 0.6)
    assert registry.founders.read().count() == len({(g, n) for g, _, n, _ in assigned(registry) if n is not None})


def test_a_batch_that_died_between_the_tables_is_run_again(spark, tmp_path, monkeypatch):
    rows = items(60, 4)
    registry = FounderRegistry(spark, f"file://{tmp_path}/registry", 0.6, buckets=2)
    first, second = (spark.createDataFrame(part, SCHEMA) for part in (rows[:30], rows[30:]))
    registry.handle(first, 0)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(registry.assigned, "upsert", lost)
        with pytest.raises(RuntimeError):
            registry.handle(second, 1)
    assert registry.founders.read().where(F.col("batch") == 1).count() > 0
    registry.handle(second, 1)
    assert assigned(registry) == expected(rows, 0.6)
