"""sightline: site-readiness analytics over crawled pages, as Spark DataFrame jobs."""
