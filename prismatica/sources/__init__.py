"""Sources and sinks of corpora, metadata and catalogs."""
