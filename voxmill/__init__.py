"""Feedback analytics on Spark: collect, clean, itemise, categorise, analyse, report."""
