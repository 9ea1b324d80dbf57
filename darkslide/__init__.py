"""darkslide: media-catalog culling and identity analytics as PySpark jobs."""
