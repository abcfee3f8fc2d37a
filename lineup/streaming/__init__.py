"""streaming of the roster analytics library."""
