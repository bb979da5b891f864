"""Object-centric event-log analytics as declarative PySpark plans."""
