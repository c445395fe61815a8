"""Spark jobs for sports-event features, betting-market quotes and training data."""
