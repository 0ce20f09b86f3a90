"""DataFrame operators over nodes and edges."""
