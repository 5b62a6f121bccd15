"""roadloom: transport-network demand and resilience analytics on Spark DataFrames."""
