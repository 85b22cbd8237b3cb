"""DataFrame operators: rasters, robust statistics, sparse models, depth maps, fits, metadata."""
