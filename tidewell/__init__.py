"""tidewell: cycle, corpus, search and monitoring analytics as DataFrame functions."""
