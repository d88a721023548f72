"""Signal-processing leaves in numpy behind a backend, as vectorised UDFs."""
