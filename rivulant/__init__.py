"""rivulant: corpus, build-log and run analytics as PySpark DataFrame operators.

Every operator takes DataFrames and plain parameters and returns a lazy
DataFrame; Catalyst chooses the physical plan.  Rules, rename tables, rubrics
and tolerances are data handed to the operators.
"""

__version__ = "0.1.0"
