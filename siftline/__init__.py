"""Siftline: Spark operators for labelled, grouped, time-ordered flow records."""
