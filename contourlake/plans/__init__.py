"""Query plans over the fixture tables."""
