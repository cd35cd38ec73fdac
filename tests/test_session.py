import os

import pytest

from retenta.session import scratch, stage


def test_scratch_tables_go_and_lasting_ones_stay(spark):
    with scratch(spark):
        inner = stage(spark.range(5), "inner")
        kept = stage(inner.filter("id > 1"), "kept", lasting=True)
        paths = [df.inputFiles()[0].removeprefix("file:") for df in (inner, kept)]
        assert inner.count() == 5
    assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 3
    outside = stage(spark.range(2))
    assert outside.count() == 2


def test_scratch_is_cleared_after_an_error_too(spark):
    with pytest.raises(ZeroDivisionError), scratch(spark):
        path = stage(spark.range(3), "lost").inputFiles()[0].removeprefix("file:")
        raise ZeroDivisionError
    assert not os.path.exists(path)
