"""Evidence-ledger analytics on PySpark: manifests, event logs, run state, lineage, bundles and decisions as DataFrames."""

__version__ = "0.1.0"
