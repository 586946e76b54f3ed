"""Query plans: fixture adapters over the driver tables and the query registry."""
