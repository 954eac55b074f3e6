"""Release-evidence ledger analytics as Spark DataFrame operators."""
