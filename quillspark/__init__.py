"""quillspark: notebook-lineage and corpus analytics expressed as Spark DataFrames."""
