"""Session, trial and event-time analytics as DataFrame-to-DataFrame functions on Spark."""
