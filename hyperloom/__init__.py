"""Hypergraph structure analytics and corpus preparation on PySpark DataFrames."""
