

def _ship_by_value() -> None:
    """Functions and classes of this package that run inside Python tasks
    (scorers, the top-k cell scorer) are pickled by value, so executors do
    not need the package installed; only pandas/numpy must be there."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001  (older cloudpickle: package must be installed)
        pass


_ship_by_value()
