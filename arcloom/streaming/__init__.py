"""Graph documents as a stream: each micro-batch is one idempotent ingest."""
