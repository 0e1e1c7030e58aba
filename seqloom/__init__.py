"""seqloom: a Spark-native engine that turns annotated genomes into token corpora.

Every public operator is a lazy ``DataFrame -> DataFrame`` function built from the
DataFrame API; Catalyst plans it, AQE re-plans it at the exchanges.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions that run inside tasks (Arrow and pandas batches) travel with the task,
    so executors need no copy of this package on their path."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
