"""hashloom: provenance analytics over run ledgers, written as Spark DataFrame operators."""
