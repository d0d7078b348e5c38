"""Planning of searches, and the registered queries."""
