"""fleetlane: analytics for fleets of batch text jobs, built on Spark DataFrames.

Every operator is a function ``DataFrame(s) -> DataFrame`` made of Spark's own
expressions, so Catalyst plans it and the work stays on the executors.
"""

__version__ = "0.1.0"
