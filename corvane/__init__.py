"""Corvane: content analytics over news, forum and web tables, expressed as Spark DataFrame plans."""
