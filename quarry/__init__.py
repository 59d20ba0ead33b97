"""quarry: tenant-scoped ingestion, data-quality and operational analytics on Spark.

Everything here builds DataFrame plans; nothing is collected to the driver
except bounded scalars (a rule count, a size probe). Subpackages:

* ``sources`` / ``sinks``   – readers and writers (files, JDBC, Kafka, ...)
* ``functions``             – column-level helpers (predicates, PII, periods)
* ``operators``             – transforms, quality rules, profiling, analytics
* ``plans``                 – end-to-end pipeline and quality-check plans
* ``streaming``             – Structured Streaming ingest and stateful jobs
"""

from quarry.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
