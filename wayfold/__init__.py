"""wayfold: movement timelines on Spark DataFrames."""
