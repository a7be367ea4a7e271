"""Operators of a training-data pipeline; nothing outside this package imports it."""

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
