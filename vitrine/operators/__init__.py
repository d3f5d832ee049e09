"""DataFrame operators: ingest, search, recommendation, taste, curation, profiles."""
