"""Operators over DataFrames: joins, windows, sampling, estimates, detectors, simulators."""
