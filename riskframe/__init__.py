"""riskframe: daily environmental-risk tables on Spark.

Operators are ``DataFrame -> DataFrame`` functions in ``operators``,
``functions``, ``sources`` and ``streaming``; ``plans.jobs`` composes them
into the E1–E8 jobs; ``plans.q_*`` registers the queries exposed by
``__spark_entry__``.
"""
