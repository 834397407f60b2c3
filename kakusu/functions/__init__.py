"""Column builders: the catalogue of patterns, spans, context, conflicts."""
