"""Analytics on labelled network-flow and event streams, written for Spark DataFrames."""
