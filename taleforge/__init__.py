"""taleforge: document, dialogue and corpus analytics expressed as Spark DataFrame plans."""
