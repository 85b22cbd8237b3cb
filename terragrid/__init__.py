"""terragrid: multi-view geospatial reconstruction data as Spark DataFrames."""
