"""Multi-table jobs: catalog, lifecycle, definitions, request audit, ingest."""
