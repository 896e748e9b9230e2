"""Trained parts: confidence calibration and vector clustering, with Spark's own learners."""
