"""Plan building blocks that are not tied to the booking model."""
