"""Views of the supplied tables in the operators' roles."""
