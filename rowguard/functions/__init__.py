"""Values, types and validators as column expressions."""
