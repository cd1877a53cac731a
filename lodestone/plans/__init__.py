"""Settings, caches and the driver-side composition of queries."""
