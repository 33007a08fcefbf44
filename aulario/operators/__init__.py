"""Booking operators, one module per family of questions."""
