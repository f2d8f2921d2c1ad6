"""runlens: document-job analytics expressed as Spark DataFrame plans.

Each operator is a pure ``DataFrame -> DataFrame`` function built from
Spark SQL built-ins, so Catalyst can push filters into the Parquet scan,
prune columns and pick the join strategy. Python runs only inside the two
documented hooks (the per-document extractor and the envelope projector).
"""

__version__ = "0.1.0"
