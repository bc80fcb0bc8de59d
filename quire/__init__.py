"""quire: Spark-native corpus, retrieval, audit and redaction jobs.

Subpackages: ``sources`` (tables, files, derived inputs), ``functions``
(column helpers and fixed values), ``operators`` (the jobs), ``streaming``
(stream jobs and batch twins), ``plans`` (registered queries and their
oracle SQL). Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
