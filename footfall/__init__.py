"""Web analytics on Spark: page views and click events in, audience answers out."""
