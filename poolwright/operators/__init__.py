"""DataFrame operators over candidate pools."""
