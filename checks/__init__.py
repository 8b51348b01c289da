"""Binding of the operators to the driver's tables, with an independent SQL answer for each."""
