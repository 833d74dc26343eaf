"""Tables and graph files as relations."""
