"""vigil: equipment-health analytics on Spark.

Subpackages: ``sources`` (readers, sinks, ingest normalisation), ``functions``
(business rules as Column expressions), ``operators`` (DataFrame -> DataFrame
operators), ``plans`` (registered queries, oracle SQL, whole jobs) and
``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
