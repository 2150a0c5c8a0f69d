"""Scalar functions as SQL text that Spark (through ``expr``) and the oracle share."""
