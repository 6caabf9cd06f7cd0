"""graphmill: evidence-backed knowledge graphs as PySpark DataFrame jobs."""
