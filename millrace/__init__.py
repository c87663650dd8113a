"""Spark-first analytics operators: declare the plan, let Catalyst and AQE run it."""
