"""Patient table readers, sinks and generators."""
