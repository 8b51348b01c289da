"""Panel analytics on Spark: entity x period snapshots to events, journeys, features and model reports."""
