"""tessera: a Spark-native engine for preparing, augmenting and auditing
labelled text corpora.

Layout:
  functions/  Column -> Column building blocks (cleaning, keyed randomness,
              noise, array helpers)
  operators/  DataFrame -> DataFrame operators (vocabularies, encoders, BPE,
              corpus shaping, augmentation, copy detection, metrics)
  sources/    readers and writers (CSV / text corpora, vocabulary files)
  plans/      the registered queries over the driver tables
  streaming/  Structured Streaming variants of the stateless encoders
"""

__version__ = "0.1.0"


def _ship_with_closures() -> None:
    """Pickle this package's functions and classes by value, so Python
    workers (e.g. for the Arrow-batched UDFs) need no installed copy."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to imports
        pass


_ship_with_closures()
