"""Operators for large text corpora: mixing, sharding, tokens, search, filters and dedup."""

import sys

from pyspark import cloudpickle

# Functions travel with their jobs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["peerlight"])
