"""DataFrame operators of ribosome-profiling analysis."""
