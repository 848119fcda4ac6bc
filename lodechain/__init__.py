"""lodechain: behaviour-chain analytics and corpus preparation on Spark DataFrames."""
