"""bindery: a versioned registry of file bundles, expressed as Spark jobs."""
