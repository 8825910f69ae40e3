"""Document analytics on Spark: layout, scripts, page plans, manifests, numbers, streams."""
