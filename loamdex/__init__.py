"""loamdex: document analytics on Spark (chunks, vectors, audits, change streams)."""
