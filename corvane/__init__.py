"""corvane: source-code and corpus analytics expressed as Spark plans."""
