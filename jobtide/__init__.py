"""jobtide: the job-offer data product as PySpark DataFrame / SQL / Structured Streaming jobs.

Layout: ``functions`` (column expressions), ``operators`` (DataFrame jobs), ``sources``,
``sinks``, ``streaming`` and ``plans`` (adapters, q_* queries, end-to-end runs).
"""

__version__ = "0.1.0"
