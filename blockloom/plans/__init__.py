"""Query plans: what is registered with the driver."""
