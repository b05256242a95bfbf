"""Sources and sinks: test-table panel roles, extract readers, tagged result tables."""
