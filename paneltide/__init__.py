"""Panel screening and walk-forward validation as Spark DataFrame operators."""
