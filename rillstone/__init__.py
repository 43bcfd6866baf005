"""Analytics on Spark DataFrames: cubes over rollups, datasets, log ingestion,
replicated state, and the data-pipeline operators of ``rillstone.operators``."""
