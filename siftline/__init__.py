"""Record linkage, deduplication, review rules and audit reports as PySpark DataFrame operators."""
