"""Configuration, simulation loops and the query catalog."""
