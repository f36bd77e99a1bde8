"""Tables in the shared folder and how long they stay."""

import os

import pytest

from tallyloom.operators import measures as M
from tallyloom.operators import shared


def place(path):
    return path.removeprefix("file:")


def test_scratch_tables_go_with_their_block(spark):
    d = spark.createDataFrame([(g, float(v)) for g in (1, 2, None) for v in range(9)], "g int, v double")
    with shared.scratch(spark) as outer:
        kept = shared.cut(d)
        with shared.scratch(spark) as inner:
            got = {r.g: r.quantiles for r in M.quantiles(d, "v", [0.5, 0.25], ["g"]).collect()}
            assert got == {g: [4.0, 2.0] for g in (1, 2, None)} and len(os.listdir(place(inner))) > 0
        assert inner.startswith(outer) and not os.path.exists(place(inner)) and kept.count() == 27
    assert not os.path.exists(place(outer))
    assert shared.cut(d).count() == 27 and shared.fresh_path(spark).startswith(shared.shared_dir(spark))


def test_scratch_tables_go_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), shared.scratch(spark) as folder:
        shared.cut(spark.range(3))
        assert os.path.exists(place(folder))
        raise ZeroDivisionError
    assert not os.path.exists(place(folder)) and shared.SCRATCH.get() is None
    shared.remove(spark, folder)
