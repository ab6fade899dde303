"""What may be run: metric definitions, catalog versions, approved joins and steps."""
