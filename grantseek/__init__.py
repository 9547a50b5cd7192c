"""Permission-aware document retrieval as plain functions from DataFrames to DataFrames."""
