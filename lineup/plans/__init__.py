"""plans of the roster analytics library."""
