"""Running counts over streams."""
