"""Survey sources and the stand-in wave."""
