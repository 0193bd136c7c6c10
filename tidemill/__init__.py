"""tidemill: an event-time analytics engine expressed as PySpark plans."""

__version__ = "0.1.0"
