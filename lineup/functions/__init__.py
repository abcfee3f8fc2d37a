"""functions of the roster analytics library."""
