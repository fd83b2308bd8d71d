"""pixelmill: raster analytics and vectorisation on PySpark."""
