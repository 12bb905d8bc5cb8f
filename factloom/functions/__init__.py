"""Column functions: scalar expressions without shuffles."""
