"""Part of the raster-to-vector engine."""
