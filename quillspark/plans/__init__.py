"""Planning on the driver, and the registered queries."""
