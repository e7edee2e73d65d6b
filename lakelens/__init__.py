"""lakelens: analytics over tables and document collections, planned by Spark."""
