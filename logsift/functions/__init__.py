"""Column expressions: masking, identity, references, severity."""
