"""riskflow: Spark-native operators for card-transaction risk analytics.

Every operator is a plain function ``DataFrame -> DataFrame`` (or ``-> Column``) so the
batch jobs, the Structured Streaming jobs and the registered queries share one code path.
"""

__all__ = ["session"]
