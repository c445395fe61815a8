"""Training-data operators: thirteen document, vector and conversation jobs on Spark.

Nothing else in the library imports this subpackage.
"""
