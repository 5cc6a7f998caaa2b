"""Spark-first analytics over sequences: mapping long noisy reads onto contigs."""
