"""Whole plans: corpus preparation, corpus scoring, sinks, and the registered queries."""
