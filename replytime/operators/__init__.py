"""DataFrame operators of the study."""
