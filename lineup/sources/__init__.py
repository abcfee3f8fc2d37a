"""sources of the roster analytics library."""
