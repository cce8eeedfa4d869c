"""Text-overlap and document-similarity engine on PySpark DataFrames."""
