"""Extensions for streams of events and for incremental syncs."""
