"""operators of the roster analytics library."""
