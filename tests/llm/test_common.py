from __future__ import annotations

import numpy as np
import pytest

from tintero.llm.common import bit_filter, may_hold


def test_the_filter_holds_every_key_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = bit_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"), "key", 20)
    other = rng.integers(-(2**63), 2**63 - 1, 20_000)
    assert may_hold(table, keys.view(np.uint64)).all() and may_hold(table, other.view(np.uint64)).mean() < 0.02
    assert not may_hold(bit_filter(spark.createDataFrame([], "key long"), "key"), keys.view(np.uint64)).any()


def test_a_cluster_without_a_shared_folder_is_refused():
    from tintero.sources.store import shared_folder

    class Fake:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():  # noqa: N802
                return None

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Fake)
