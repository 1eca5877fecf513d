"""Spark-first analytics over collections of 3-D shapes.

Landmarks, meshes, clouds and shape models are DataFrames; the work is
declared with DataFrame and SQL expressions and NumPy is used only inside
tasks, one specimen at a time.
"""

import sys

from pyspark import cloudpickle

# Executors get the package's functions with the tasks and need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
