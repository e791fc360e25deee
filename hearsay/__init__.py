"""Discussion analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns) and leaves the
physical strategy to Catalyst.  See README.md for the module map.
"""

__version__ = "0.1.0"
