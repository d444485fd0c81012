"""Where classes, schemas and triples come from."""
