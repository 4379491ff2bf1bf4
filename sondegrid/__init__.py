"""sondegrid: Spark-first analytics for elevation points, grids and data catalogs."""
