"""Sources and sinks, and the domain's views of the test tables."""
