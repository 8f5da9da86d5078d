"""Sources and sinks: fixture tables, the labelled corpus, CSV/Parquet I/O, materialised stages, registry."""
