"""Full-text search over DataFrames, with operators for training-data pipelines in wordloom.llm."""
