"""Trajectory analytics on Spark: episodes, steps, predictions, scores and comparisons as DataFrame transforms."""
