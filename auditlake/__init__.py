"""auditlake: documentation-corpus audits as Spark DataFrame jobs."""

__version__ = "0.1.0"
