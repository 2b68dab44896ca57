"""Chart-georeferencing analytics on Spark."""
