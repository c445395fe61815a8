"""Jobs composed of the library's operators."""
